"""Problem 3: content-defined splitting of oversized texts.

A rolling hash over the characters marks landmarks, wherever the same
characters occur. From each cut the next landmark between the least and the
greatest piece size is taken and snapped to the nearest natural boundary, so
that an edit moves the cuts near it and leaves the others.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WINDOW = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Ends of paragraphs, lines and sentences; a cut is made after the match.
_STRONG = re.compile(r"\n\s*|[.!?…][\"'»”’)\]]*\s+(?=[^a-zß-öø-ÿ\s])")
_WEAK = re.compile(r"\s+")


def rolling_hash(text: str) -> np.ndarray:
    """A hash of the 32 characters before each place (fewer at the start), mixed to 64 bits."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        n = len(a)
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _INVERSE)]))[:n]
        total = np.concatenate([[np.uint64(0)], np.cumsum((a + np.uint64(1)) * down)])
        back = np.maximum(np.arange(n + 1) - _WINDOW, 0)
        h = (total - total[back]) * up
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def cuts(text: str, least: int, most: int, every: int = 256) -> list[int]:
    """Ends of the pieces' cores; the last is len(text).

    A landmark is a place whose hash is divisible by `every`; where none lies
    in reach, the place with the least hash there is one. The tail stays
    whole when it fits.
    """
    n = len(text)
    h = rolling_hash(text)
    marks = np.flatnonzero(h % np.uint64(every) == 0)
    strong = [m.end() for m in _STRONG.finditer(text)]
    weak: list[int] | None = None
    out, s = [], 0
    while n - s > most:
        lo, hi = s + least, s + most
        i = int(np.searchsorted(marks, lo))
        at = int(marks[i]) if i < len(marks) and marks[i] <= hi else lo + int(np.argmin(h[lo : hi + 1]))
        cut = _nearest(strong, at, lo, hi)
        if cut is None:
            if weak is None:
                weak = [m.end() for m in _WEAK.finditer(text)]
            cut = _nearest(weak, at, lo, hi)
        if cut is None:
            cut = at
            while cut > lo and unicodedata.combining(text[cut]):
                cut -= 1
        out.append(cut)
        s = cut
    return [*out, n]


def _nearest(places: list[int], at: int, lo: int, hi: int) -> int | None:
    i, j = bisect_left(places, lo), bisect_right(places, hi)
    if i == j:
        return None
    k = bisect_left(places, at, i, j)
    near = places[max(i, k - 1) : min(j, k + 1)]
    return min(near, key=lambda p: (abs(p - at), p))


def pieces(text: str, limit: int = 1000, overlap: int = 200, least: int = 300) -> list[tuple[int, int, int]]:
    """(start, core start, end) of each piece; text[start:end] is the piece.

    The cores make up the text; a piece starts up to `overlap` characters
    before its core, at the start of a sentence, line or word, if there is
    one, and has at most `limit` characters.
    """
    if len(text) <= limit:
        return [(0, 0, len(text))]
    ends = cuts(text, least, limit - overlap)
    out, s = [], 0
    for e in ends:
        start = s
        if s and overlap:
            lo = max(0, s - overlap)
            start = next((lo + m.end() for m in _STRONG.finditer(text[lo:s]) if lo + m.end() < s), None)
            if start is None:
                start = next((lo + m.end() for m in _WEAK.finditer(text[lo:s]) if lo + m.end() < s), lo)
        out.append((start, s, e))
        s = e
    return out


_OUT = "chunk_id bigint, piece_no int, start_char int, core_char int, end_char int, content string, section_header string, page_number int"


def _cut(limit: int, overlap: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, spans, text = [], [], [], []
            for i, x in enumerate(b.column("content").to_pylist()):
                for k, p in enumerate(pieces(x, limit, overlap, least)):
                    row.append(i), no.append(k), spans.append(p), text.append(x[p[0] : p[2]])
            at = pa.array(row, pa.int32())
            own = [pa.array([p[k] for p in spans], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), pa.array(no, pa.int32()), *own, pa.array(text, pa.string()), b.column("section_header").take(at), b.column("page_number").take(at)],
                names=["chunk_id", "piece_no", "start_char", "core_char", "end_char", "content", "section_header", "page_number"],
            )

    return run


def split_oversized(chunks: DataFrame, limit: int = 1000, overlap: int = 200, least: int = 300) -> DataFrame:
    """The pieces of all chunks longer than `limit` characters (code points, outer spaces included).

    Rows (chunk_id, piece_no from 0, start_char, core_char, end_char, content,
    section_header, page_number). Null and shorter content gives no row;
    repeated ids count once, the least (content, section_header, page_number)
    winning should they differ; rows without id are kept apart by content. A
    text without any boundary is cut at a landmark. Extra columns are ignored.
    """
    if not 0 <= overlap < limit or not 0 < least <= limit - overlap:
        raise ValueError("sizes must satisfy 0 <= overlap < limit and 0 < least <= limit - overlap")
    long = chunks.where(F.length("content") > limit).select("id", "content", "section_header", "page_number")
    key = F.when(F.col("id").isNull(), F.sha2("content", 256))
    once = long.groupBy("id", key.alias("_k")).agg(F.min(F.struct("content", "section_header", "page_number")).alias("x")).select("id", "x.*")
    return once.mapInArrow(_cut(limit, overlap, least), _OUT)


def oversized_ids(chunks: DataFrame, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """(chunk_id) of the chunks that the split has cut."""
    return split_oversized(chunks, limit, overlap).where("piece_no = 1 and chunk_id is not null").select("chunk_id")
