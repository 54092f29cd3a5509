"""Problem 5: near-duplicate texts by bit-sliced comparison.

Candidates are made without loss. The shingles of each distinct text are put
into one order, rare ones first; two texts similar enough share one of the
first shingles of both (a prefix filter), and these are the buckets. Postings
are range-partitioned by (bucket, size, text), so that a hot bucket is spread
over tasks. Each carries a 256-bit signature, the parity of the shingles that
fall on each bit: a shingle that only one of two texts has changes one bit,
so the Hamming distance is never above the number of such shingles, which the
sizes and the least similarity bound. Within a bucket the partners of a text
are a stretch of the sizes from its own up to what may still follow its
shingle. Stretches are cut into words of 64 lanes; signatures are stored as
vertical bit planes, many distances at once are counted with carry-save
adders, and a block is abandoned as soon as all its counters exceed the
radius. Buckets that cross a partition border are compared tile by tile.
Pairs left are asked for 1,024 bits of parities, then verified exactly on the
whole texts. Copies of a text are one class throughout.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.components import connected_components
from skerry.plans.shared import materialise, release, stacked

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
WORDS, WIDE = 4, 16
_SIGNATURE = [f"w{k}" for k in range(WORDS)]
_WORDS = re.compile(r"[^\W_]+")


@dataclass
class Settings:
    """Shingles of `shingle` words, similarity at least `least`, texts of at least `words` words.

    The order of shingles follows counts in about `sample` texts; any order is
    without loss, a good one makes small buckets. Words of 64 lanes with
    `dense` partners are compared in bit planes. Postings are shuffled in
    `passes` turns, so that the disk holds one part at a time; a task sorts
    about `rows` of them. The ids of up to `broadcast` pairs are broadcast.
    """

    shingle: int = 3
    least: float = 0.5
    words: int = 30
    dense: int = 40
    sample: int = 20_000
    rows: int = 500_000
    passes: int = 4
    broadcast: int = 1_000_000


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORDS.findall(text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


_SOME = np.uint64(0xA24BAED4963EE407)


@cache
def _letters() -> np.ndarray:
    """A 64-bit value of each of the first 65,536 characters that is a letter or digit, 0 for the others."""
    return np.where([chr(i).isalnum() for i in range(1 << 16)], _mix(_mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * _SOME)), np.uint64(0))


def _made_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumprod(np.full(n, base, np.uint64)), np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)]))


_kept_powers = cache(_made_powers)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base to the powers 1, 2, ... and to 0, -1, ...: at least n of each, modulo 2^64.

    With them the polynomials of all stretches of an array are one product and
    one sum: places count from its start, and a stretch's start is taken back.
    """
    return (_kept_powers if n <= 1 << 20 else _made_powers)(int(base), 1 << max(n - 1, 1).bit_length())


def word_hashes(texts: list[str], chars: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and how many words each text has.

    About `chars` characters are hashed at a time, by a polynomial over mixed values of each word's characters.
    """
    values = _letters()
    low = [t.lower() if t else "" for t in texts]
    length = np.fromiter(map(len, low), np.int64, len(low)) + 1
    out, counts = [], np.zeros(len(low), np.int64)
    for part in _chunks(length, chars):
        a = np.frombuffer("\n".join(["", *low[part], ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        if a.max() <= 0xFFFF:
            x = values.take(a)
        else:
            x, far = values[np.minimum(a, 0xFFFF)], np.flatnonzero(a > 0xFFFF)
            x[far] = np.where([chr(i).isalnum() for i in a[far].tolist()], _mix(_mix((a[far].astype(np.uint64) + np.uint64(1)) * _SOME)), np.uint64(0))
        word = x != 0
        first = np.flatnonzero(word[1:] > word[:-1]) + 1
        if not len(first):
            continue
        power, back = _powers(_BASES[0], len(x))
        x *= power[: len(x)]
        out.append(_mix(np.add.reduceat(x, first) * back[first]))
        ends = np.cumsum(length[part])
        counts[part] = np.diff(np.searchsorted(first, ends, side="right"), prepend=0)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def _shingles(texts: list[str], s: Settings) -> tuple[np.ndarray, ...]:
    """(row, key1, key2) of the texts with enough words, and (text, shingle) hashes of their places, repeats included."""
    h, n = word_hashes(texts)
    enough = n >= max(s.words, s.shingle)
    rows = np.flatnonzero(enough)
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64)
    with np.errstate(over="ignore"):
        h, n = h[np.repeat(enough, n)], n[rows]
        ends = np.cumsum(n)
        keys = []
        for base in _BASES:
            power, back = _powers(base, len(h))
            keys.append(_mix(np.add.reduceat(h * power[: len(h)], ends - n) * back[ends - n]).view(np.int64))
        x = np.zeros(len(h), np.uint64)
        for k in range(s.shingle):
            x[: len(h) - s.shingle + 1] += _mix(h[k : len(h) - s.shingle + 1 + k] * np.uint64(2 * k + 3))
        whole = np.ones(len(h), bool)
        for k in range(1, s.shingle):
            whole[ends - k] = False
        return rows, keys[0], keys[1], np.repeat(np.arange(len(n)), n - s.shingle + 1), _mix(x[whole])


Common = tuple[np.ndarray, np.ndarray]


def counter(common: Common) -> Callable[[np.ndarray], np.ndarray]:
    """Gives the counts of shingles, 0 of those that common lacks: looked for from where the shingles of equal highest bits begin."""
    known, counts = common
    shift = np.uint64(62 - max(len(known), 1).bit_length())
    start = np.searchsorted(known >> shift, np.arange((1 << 64 - int(shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def often(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        slot = (x >> shift).view(np.int64)
        at, end = start[slot], start[slot + 1]
        rows = np.flatnonzero(at < end)
        at, end, y = at[rows], end[rows], x[rows]
        while len(rows):
            hit = known[at] == y
            out[rows[hit]] = counts[at[hit]]
            more = np.flatnonzero(~hit & (at + 1 < end))
            rows, at, end, y = rows[more], at[more] + 1, end[more], y[more]
        return out

    return often


def _within_texts(text: np.ndarray, often: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The order by (text, often up to 8,191, x), mostly by one sort of packed keys."""
    often = np.minimum(often, 8191)
    if int(text[-1]) < 1 << 11:
        key = (text.astype(np.uint64) << np.uint64(53)) | (often.astype(np.uint64) << np.uint64(40)) | (x >> np.uint64(24))
        order = np.argsort(key)
        key, y = key[order], x[order]
        if not ((key[1:] == key[:-1]) & (y[1:] != y[:-1])).any():
            return order
    return np.lexsort((x, often, text))


def sketch(texts: list[str], s: Settings, often: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, key1, key2, size, (n, WIDE) signature words, prefix length, prefix shingles) of the texts with enough words.

    often tells how often shingles were counted.
    """
    rows, k1, k2, text, x = _shingles(texts, s)
    if not len(rows):
        z = np.zeros(0, np.int64)
        return z, z, z, z, np.zeros((0, WIDE), np.int64), z, z
    order = _within_texts(text, often(x), x)
    text, x = text[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    text, x = text[new], x[new]
    size = np.bincount(text, minlength=len(rows))
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    with np.errstate(over="ignore"):
        bit = ((x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(54)).astype(np.int64)
    wide = np.zeros((len(rows), WIDE), np.uint64)
    np.bitwise_xor.at(wide.reshape(-1), text * WIDE + (bit >> 6), np.uint64(1) << (bit & 63).view(np.uint64))
    length = np.minimum(size - _ceil(s.least * size) + 1, size)
    return rows, k1, k2, size, wide.view(np.int64), length, x[_ranges(starts, length)[1]].view(np.int64)


def folded(wide: np.ndarray) -> np.ndarray:
    """WORDS words of parities made from the WIDE ones."""
    return np.bitwise_xor.reduce(wide.reshape(len(wide), WIDE // WORDS, WORDS), axis=1)


def _ceil(x: np.ndarray) -> np.ndarray:
    """Whole numbers not below x, where x may be too large by rounding."""
    return np.ceil(x - 1e-6).astype(np.int64)


def _listed(s: Settings) -> Batches:
    """The different shingles of each text, counted for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = counter((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        whole = Settings(s.shingle, 0.0, s.words)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                x, n = np.unique(sketch(b.slice(lo, 2000).column("content").to_pylist(), whole, none)[-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n)], names=["shingle", "n"])

    return run


def _common(rows: DataFrame, n: int, s: Settings) -> Common:
    """Shingles of several texts of a sample of about n rows, ordered, and their counts; at most a million."""
    rate = min(1.0, s.sample / max(n, 1))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate * (1 << 20)).select("content").distinct()
    counts = picked.mapInArrow(_listed(s), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n")).limit(1_000_000).toArrow()
    x, often = got.column("shingle").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(x)
    return x[order], often[order]


def _cut(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of an array, cut at `ends`, as binary values."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _blobs(x: np.ndarray) -> pa.Array:
    """The rows of an array as binary values."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _sketched(s: Settings, shared) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counter(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                rows, k1, k2, size, wide, length, x = sketch(part.column("content").to_pylist(), s, often)
                sig = folded(wide)
                # Of the copies within a batch one carries the buckets, of 32 bits, each with its place.
                first = np.zeros(len(rows), bool)
                first[np.unique(k1, return_index=True)[1]] = True
                x = x[np.repeat(first, length)] >> 32
                n = length[first]
                at, place = _ranges(np.zeros(len(n), np.int64), n)
                cell = (x.view(np.uint64) % np.uint64(s.passes)).astype(np.int64) * len(rows) + np.flatnonzero(first)[at]
                code = ((x << 32) | place)[np.argsort(cell.astype(np.uint16) if s.passes * len(rows) < 1 << 16 else cell, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=s.passes * len(rows)))])
                lists = []
                for k in range(s.passes):
                    e = ends[k * len(rows) : (k + 1) * len(rows) + 1]
                    lists.append(_cut(code[e[0] : e[-1]], (e - e[0]) * code.itemsize))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows, pa.int64())), pa.array(k1), pa.array(k2), pa.array(size.astype(np.int32)), *(pa.array(np.ascontiguousarray(sig[:, k])) for k in range(WORDS)), _blobs(wide), *lists],
                    names=["id", "k1", "k2", "size", *_SIGNATURE, "wide", *(f"codes{k}" for k in range(s.passes))],
                )

    return run


_SWAPS = [(np.uint64(j), np.uint64(m)) for j, m in ((32, 0x00000000FFFFFFFF), (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))]


def planes(words: np.ndarray) -> np.ndarray:
    """(n, words) signatures as bit planes of ceil(n / 64) words each: squares of 64 by 64 bits are transposed, halves at a time."""
    n, k = words.shape
    blocks = -(-n // 64)
    x = np.zeros((k, 64, blocks), np.uint64)
    full = np.zeros((blocks * 64, k), np.uint64)
    full[:n] = words
    x[:] = full.reshape(blocks, 64, k).transpose(2, 1, 0)
    for j, mask in _SWAPS:
        y = x.reshape(k, 32 // int(j), 2, int(j), blocks)
        low, high = y[:, :, 0], y[:, :, 1]
        t = ((low >> j) ^ high) & mask
        high ^= t
        low ^= t << j
    return x.reshape(64 * k, blocks)


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry and sum of three vertical bits."""
    u, carry = a ^ b, a & b
    carry |= u & c
    u ^= c
    return carry, u


_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def within(queries: np.ndarray, base: np.ndarray, q: np.ndarray, w: np.ndarray, alive: np.ndarray, radius: np.ndarray, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which lanes of blocks lie within a radius.

    A block is a query q[i] (column of the (bits, n) masks `queries`, all ones
    for a set bit) against the 64 lanes of word w[i] of the planes `base`;
    only the lanes set in alive[i] count. Distances are kept in vertical
    counters: sixteen planes at a time go through carry-save adders, whose
    carry of weight 16 is added to a ripple counter. A block is abandoned as
    soon as the counters of all its live lanes exceed the radius. Returns the
    places of the blocks left and their lanes as words; `counts` collects
    (blocks, abandoned early, planes counted).
    """
    at, early, work = np.arange(len(q)), 0, 0
    low = [np.zeros(len(q), np.uint64) for _ in range(4)]
    high: list[np.ndarray] = []
    for p in range(0, len(queries), 16):
        work += 16 * len(at)
        d = [base[p + k].take(w) ^ queries[p + k].take(q) for k in range(16)]
        for level in range(4):
            up = []
            for k in range(0, len(d), 2):
                carry, low[level] = _adder(low[level], d[k], d[k + 1])
                up.append(carry)
            d = up
        carry = d[0]
        for k in range(len(high)):
            high[k], carry = high[k] ^ carry, high[k] & carry
        if 1 << len(high) <= p // 16 + 1:
            high.append(carry)
        if p % 32 == 16 or p + 16 == len(queries):
            lanes = alive & _at_most([*low, *high], radius)
            left = lanes != 0
            if p + 16 == len(queries):
                alive, at = lanes[left], at[left]
            elif left.mean() < 0.75:
                early += int((~left).sum())
                low, high = [x[left] for x in low], [x[left] for x in high]
                at, q, w, alive, radius = at[left], q[left], w[left], alive[left], radius[left]
        if not len(at):
            break
    if counts is not None:
        counts[:] = [a + b for a, b in zip(counts, (early + len(at), early, work))] if counts else [early + len(at), early, work]
    return at, alive


def _at_most(digits: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Lanes whose number, of vertical binary digits, is at most the block's `most`."""
    less, same = np.where(most >= 1 << len(digits), _ALL, np.uint64(0)), np.full(len(most), _ALL)
    for k in range(len(digits) - 1, -1, -1):
        one = np.negative((most >> k & 1).astype(np.uint64))
        less |= same & one & ~digits[k]
        same &= ~(digits[k] ^ one)
    return less | same


@dataclass
class Postings:
    """Rows of buckets by (bucket, size): shingle `bucket` is at `pos` of the text's order."""

    bucket: np.ndarray
    key: np.ndarray
    size: np.ndarray
    pos: np.ndarray
    words: np.ndarray

    def take(self, at) -> Postings:
        at = np.flatnonzero(at) if at.dtype == bool else at
        return Postings(self.bucket[at], self.key[at], self.size[at], self.pos[at], self.words.take(at, axis=0))

    def reach(self, s: Settings) -> np.ndarray:
        """The largest partner, were the bucket's shingle the first that both texts share: enough must follow it."""
        return np.floor((self.size - self.pos) * ((1 + s.least) / s.least) - self.size + 1e-6).astype(np.int64)


def _most(n: np.ndarray, s: Settings) -> np.ndarray:
    """The most shingles that only one of two similar texts may have, whose sizes make n."""
    return n - 2 * _ceil(n * (s.least / (1 + s.least)))


def _apart(p: Postings, i: np.ndarray, j: np.ndarray, reach: np.ndarray, s: Settings) -> np.ndarray:
    """Of the pairs of rows i, j of a bucket, j the larger and within the reach of i, those that may be similar enough, as (n, 2) keys, smaller first."""
    ok = np.flatnonzero(p.size[i] <= reach[j])
    i, j = i[ok], j[ok]
    # Whole rows are taken several times as fast by take as by an index.
    x = np.bitwise_count(p.words.take(i, axis=0) ^ p.words.take(j, axis=0)).view(np.uint32)[:, 0]
    x = (x & np.uint32(0xFF00FF)) + (x >> np.uint32(8) & np.uint32(0xFF00FF))
    ok = np.flatnonzero((x & np.uint32(0xFFFF)) + (x >> np.uint32(16)) <= _most(p.size[i] + p.size[j], s))
    i, j = p.key[i[ok]], p.key[j[ok]]
    ok = i != j
    return np.stack([np.minimum(i, j)[ok], np.maximum(i, j)[ok]], 1)


def _once(out: list[np.ndarray]) -> np.ndarray:
    """The different rows of (n, 2) arrays, in order."""
    x = np.concatenate(out)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    return x[np.concatenate([np.ones(min(len(x), 1), bool), (x[1:] != x[:-1]).any(1)])]


def _ranges(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each of the numbers lo, lo + 1, ... (n of them) is in, and the numbers."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + lo[at]


def _chunks(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose sums of n are about `most`."""
    total = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield slice(lo, hi)
        lo = hi


def compare(p: Postings, s: Settings, start: np.ndarray | None = None, counts: list[int] | None = None) -> np.ndarray:
    """Pairs of different keys that may be similar enough, as (n, 2), smaller key first; rows sorted by bucket and size.

    Partners of a row are the following ones of its bucket up to its reach
    (from `start` on, if given): a stretch of lanes. Words of 64 lanes of
    which at least s.dense are asked for are counted in bit planes, thin ends
    row by row.
    """
    n = len(p.key)
    out = [np.zeros((0, 2), np.int64)]
    if n < 2:
        return out[0]
    rank = np.cumsum(np.concatenate([[0], p.bucket[1:] != p.bucket[:-1]])).astype(np.int64) << 32
    reach = p.reach(s)
    end = np.searchsorted(rank + p.size, rank + np.maximum(reach, -1), side="right")
    first = np.arange(n) + 1 if start is None else np.maximum(np.arange(n) + 1, start)
    ask = np.flatnonzero(end > first)
    first, end = first[ask], end[ask]
    cells = (end - 1) // 64 - first // 64 + 1
    planes_, masks = None, None
    for part in _chunks(cells, 1 << 14):
        at, word = _ranges(first[part] // 64, cells[part])
        row = ask[part][at]
        lo, hi = np.maximum(first[part][at], word * 64), np.minimum(end[part][at], word * 64 + 64)
        thick = hi - lo >= s.dense
        if thick.any():
            if planes_ is None:
                planes_, masks = planes(p.words), np.where(_bits(p.words), _ALL, np.uint64(0)) if n < 1 << 16 else None
            r, w, a, b = row[thick], word[thick], (lo - word * 64)[thick].astype(np.uint64), (word * 64 + 64 - hi)[thick].astype(np.uint64)
            alive = (_ALL << a) & (_ALL >> b)
            most = p.size[r] + p.size[np.minimum(w * 64 + 63, n - 1)]
            most = np.where(rank[np.minimum(w * 64 + 63, n - 1)] == rank[r], np.minimum(most, p.size[r] + reach[r]), p.size[r] + reach[r])
            # The bound for a sum of sizes may be above that for the next one: whole for all lanes only before it is cut to the sum's own.
            radius = np.floor(most * ((1 - s.least) / (1 + s.least)) + 1e-6).astype(np.int64)
            known, q = np.unique(r, return_inverse=True)
            m = masks[:, known] if masks is not None else np.where(_bits(p.words[known]), _ALL, np.uint64(0))
            left, lanes = within(m, planes_, q, w, alive, radius, counts)
            i, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(len(lanes), 8), axis=1, bitorder="little"))
            out.append(_apart(p, r[left[i]], w[left[i]] * 64 + lane, reach, s))
        thin = ~thick
        for some in _chunks((hi - lo)[thin], 1 << 20):
            at, j = _ranges(lo[thin][some], (hi - lo)[thin][some])
            out.append(_apart(p, row[thin][some][at], j, reach, s))
        if len(out) > 64:
            out = [_once(out)]
    return _once(out)


def _bits(words: np.ndarray) -> np.ndarray:
    """(bits, n) of (n, words) signatures."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little").T.astype(bool)


_SCAN = "a bigint, b bigint, bucket int, pid int, size int, pos int, " + ", ".join(f"{w} bigint" for w in _SIGNATURE)


def _postings(t: pa.RecordBatch | pa.Table, key: str) -> Postings:
    col = lambda name: t.column(name).to_numpy()
    return Postings(col("bucket"), col(key), col("size").astype(np.int64), col("pos").astype(np.int64), np.stack([col(w).view(np.uint64) for w in _SIGNATURE], 1))


def _order(bucket: np.ndarray, size: np.ndarray, key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Rows by bucket and size, those of copies once."""
    code = (bucket.astype(np.int64) << 32) | size
    order = np.argsort(code)
    c = code[order]
    same = np.zeros(len(c) + 1, bool)
    same[1:-1] = c[1:] == c[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    if not len(tied):
        return order
    rows, of = order[tied], np.cumsum(~same[:-1][tied])
    k, p = key[rows], pos[rows]
    mixed = (_mix(k.view(np.uint64)) ^ p.astype(np.uint64)) & np.uint64((1 << 40) - 1)
    # One sort of packed numbers brings rows of copies together; should others fall among them, whole keys are sorted.
    by = np.argsort((of.astype(np.uint64) << np.uint64(40)) | mixed) if of[-1] < 1 << 24 else np.lexsort((p, k, of))
    m, again = mixed[by], (of[by][1:] == of[by][:-1]) & (k[by][1:] == k[by][:-1]) & (p[by][1:] == p[by][:-1])
    if of[-1] < 1 << 24 and ((m[1:] == m[:-1]) & (of[by][1:] == of[by][:-1]) & ~again).any():
        by = np.lexsort((p, k, of))
        again = (of[by][1:] == of[by][:-1]) & (k[by][1:] == k[by][:-1]) & (p[by][1:] == p[by][:-1])
    order[tied] = rows[by]
    new = np.ones(len(c), bool)
    new[tied[1:][again]] = False
    return order[new]


def _sorted(p: Postings) -> Postings:
    """By bucket and size, rows of copies once."""
    return p.take(_order(p.bucket, p.size, p.key, p.pos))


_POSTING = np.dtype([("bucket", np.int32), ("size", np.int32), ("pos", np.int32), ("key", np.int64), ("words", np.uint64, (WORDS,))])
# Texts of so many shingles send their WIDE words along, once a part: from there on 256 bits tell little.
_LONG = 140
_WIDER = np.dtype([("key", np.int64), ("size", np.int64), ("wide", np.uint64, (WIDE,))])
Bounds = tuple[np.ndarray, np.ndarray]


def _bounds(sketches: DataFrame, parts: int, rate: float, s: Settings) -> list[Bounds]:
    """For each turn, the (bucket and size, key) at which its parts begin, of about equal rows by a sample of texts."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if parts < 2:
        return [none] * s.passes
    t = sketches.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 20)) < rate * (1 << 20)).select("k1", "size", *(f"codes{k}" for k in range(s.passes))).toArrow()
    out = []
    for k in range(s.passes):
        at, code = _codes(t.column(f"codes{k}"))
        place, key = _place(code, t.column("size").to_numpy()[at]), t.column("k1").to_numpy()[at]
        order = np.lexsort((key, place))[np.linspace(0, len(at), parts + 1)[1:-1].astype(np.int64)] if len(at) else np.zeros(0, np.int64)
        out.append((place[order], key[order]))
    return out


def _codes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The codes in all values of a column, and the row of each."""
    n, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        if len(part):
            _, ends, values = part.buffers()
            ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(part.type) else np.int32)[part.offset : part.offset + len(part) + 1]
            n.append(np.diff(ends.astype(np.int64)) // 8)
            if ends[-1] > ends[0]:
                code.append(np.frombuffer(values, np.int64, int(ends[-1] - ends[0]) // 8, int(ends[0])))
    n = np.concatenate(n)
    return np.repeat(np.arange(len(n)), n), code[1] if len(code) == 2 else np.concatenate(code)


def _place(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bucket and size in one number, in their order."""
    return (code >> 32 << 32) | size


def part_of(place: np.ndarray, key: np.ndarray, bounds: Bounds) -> np.ndarray:
    """How many bounds are at or below each (place, key)."""
    low, high = (np.searchsorted(bounds[0], place, side) for side in ("left", "right"))
    part = low.copy()
    tied = np.flatnonzero(high > low)
    for a in np.unique(low[tied]):
        rows = tied[low[tied] == a]
        part[rows] = a + np.searchsorted(bounds[1][a : high[rows[0]]], key[rows], "right")
    return part


def _dealt(s: Settings, shared, turn: int, most: int = 400_000) -> Batches:
    """Postings of a turn, about `most` at a time, as one value for each part they belong to, and the long texts among them."""

    def deal(held: list[tuple[np.ndarray, ...]], longs: list[np.ndarray], bounds: Bounds) -> pa.RecordBatch:
        code, size, key, words = (np.concatenate(x) for x in zip(*held))
        wider = np.concatenate(longs)
        part = part_of(_place(code, size), key, bounds)
        order = np.argsort(part.astype(np.uint16) if len(bounds[0]) < 1 << 16 else part, kind="stable")
        part, code, size, key = part[order], code[order], size[order], key[order]
        rows = np.empty(len(order), _POSTING)
        rows["bucket"], rows["pos"], rows["size"], rows["key"], rows["words"] = code >> 32, code & ((1 << 31) - 1), size, key, words.take(order, axis=0)
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        known = part[starts]
        blobs = _cut(rows, np.append(starts, len(rows)) * _POSTING.itemsize)
        wider = wider[np.argsort(wider["key"], kind="stable")]
        of = np.flatnonzero(size >= _LONG)
        # The places of long texts in `wider`, once for each part.
        pairs = np.unique(part[of] * len(wider) + np.searchsorted(wider["key"], key[of]))
        m = np.searchsorted(pairs, np.append(known, known[-1] + 1) * len(wider)) if len(wider) else np.zeros(len(known) + 1, np.int64)
        wides = _cut(wider[pairs % max(len(wider), 1)], m * _WIDER.itemsize)
        return pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), blobs, wides], names=["part", "rows", "wider"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, held, longs = shared.value[turn], [], []
        for b in batches:
            at, code = _codes(b.column(f"codes{turn}"))
            size, key, words = b.column("size").to_numpy(), b.column("k1").to_numpy(), np.stack([b.column(w).to_numpy() for w in _SIGNATURE], 1).view(np.uint64)
            long = np.flatnonzero(size >= _LONG)
            wider = np.empty(len(long), _WIDER)
            wider["key"], wider["size"] = key[long], size[long]
            wider["wide"] = np.frombuffer(b"".join(b.column("wide").take(pa.array(long)).to_pylist()), np.uint64).reshape(-1, WIDE)
            # Texts of any length: as many postings as there is room for.
            for lo in range(0, len(code), most):
                i = at[lo : lo + most]
                held.append((code[lo : lo + most], size[i], key[i], words.take(i, axis=0)))
                longs = longs if longs and longs[-1] is wider else [*longs, wider]
                if sum(len(x) for x, *_ in held) >= most:
                    yield deal(held, longs, bounds)
                    held, longs = [], []
        if held:
            yield deal(held, longs, bounds)

    return run


def _wide_apart(pairs: np.ndarray, wider: np.ndarray, s: Settings) -> np.ndarray:
    """The pairs of keys without those of two long texts whose WIDE words differ in more bits than their sizes allow.

    Should two texts share a key, either may stand for both; such keys are left alone.
    """
    wider = np.unique(wider)
    twice = wider["key"][1:][wider["key"][1:] == wider["key"][:-1]]
    wider = wider[~np.isin(wider["key"], twice)] if len(twice) else wider
    if not len(wider):
        return pairs
    at = np.minimum(np.searchsorted(wider["key"], pairs), len(wider) - 1)
    both = np.flatnonzero((wider["key"][at] == pairs).all(1))
    wide = np.ascontiguousarray(wider["wide"])
    keep = np.ones(len(pairs), bool)
    for lo in range(0, len(both), 1 << 14):
        some = both[lo : lo + (1 << 14)]
        i, j = at[some].T
        n = wider["size"][i] + wider["size"][j]
        keep[some] = np.bitwise_count(wide.take(i, axis=0) ^ wide.take(j, axis=0)).sum(1) <= _most(n, s)
    return pairs[keep]


def _scan(s: Settings) -> Batches:
    """Candidate pairs (a, b) of the parts' buckets; the rows of a part's first and last bucket also go out, as (a, null, ...)."""

    def row_batch(p: Postings, pid: int) -> pa.RecordBatch:
        n = len(p.key)
        return pa.RecordBatch.from_arrays(
            [pa.array(p.key), pa.nulls(n, pa.int64()), pa.array(p.bucket), pa.array(np.full(n, pid, np.int32)), pa.array(p.size.astype(np.int32)), pa.array(p.pos.astype(np.int32)), *(pa.array(np.ascontiguousarray(p.words[:, k]).view(np.int64)) for k in range(WORDS))],
            names=["a", "b", "bucket", "pid", "size", "pos", *_SIGNATURE],
        )

    def pair_batch(p: np.ndarray) -> pa.RecordBatch:
        n = len(p)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), *[pa.nulls(n, pa.int32())] * 4, *[pa.nulls(n, pa.int64())] * WORDS], names=["a", "b", "bucket", "pid", "size", "pos", *_SIGNATURE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for part, *blobs in zip(*(b.column(c).to_pylist() for c in ("part", "rows", "wider"))):
                held.setdefault(part, []).append(blobs)
        for part in sorted(held):
            blobs, wides = zip(*held.pop(part))
            x, wider = np.frombuffer(b"".join(blobs), _POSTING), np.frombuffer(b"".join(wides), _WIDER)
            del blobs, wides
            order = _order(*(np.ascontiguousarray(x[c]) for c in ("bucket", "size", "key", "pos")))
            bucket = x["bucket"][order]
            # Rows alone in their bucket, and not of one that another part may hold too, have no partner.
            met = (bucket == bucket[0]) | (bucket == bucket[-1])
            met[1:] |= bucket[1:] == bucket[:-1]
            met[:-1] |= bucket[1:] == bucket[:-1]
            x = x.take(order[met])
            rows = Postings(bucket[met], *(x[c].astype(np.int64) for c in ("key", "size", "pos")), np.ascontiguousarray(x["words"]))
            del x, order, bucket, met
            ends = (rows.bucket == rows.bucket[0]) | (rows.bucket == rows.bucket[-1])
            yield row_batch(rows.take(ends), part)
            found = _wide_apart(compare(rows, s), wider, s)
            for lo in range(0, len(found), 100_000):
                yield pair_batch(found[lo : lo + 100_000])

    return run


def _tile(s: Settings) -> Callable[[pa.Table], pa.Table]:
    """Pairs between the rows of a bucket that two partitions hold; sizes of the lower one come first."""

    def run(t: pa.Table) -> pa.Table:
        rows, pid = _postings(t, "a"), t.column("pid").to_numpy()
        low, high = rows.take(pid == t.column("lo")[0].as_py()), rows.take(pid == t.column("hi")[0].as_py())
        low, high = low.take(np.argsort(low.size, kind="stable")), high.take(np.argsort(high.size, kind="stable"))
        both = Postings(*(np.concatenate([x, y]) for x, y in zip((low.bucket, low.key, low.size, low.pos, low.words), (high.bucket, high.key, high.size, high.pos, high.words))))
        # Of the lower partition's rows only, against the higher's.
        start = np.where(np.arange(len(both.key)) < len(low.key), len(low.key), len(both.key))
        p = compare(both, s, start)
        return pa.table({"a": pa.array(p[:, 0]), "b": pa.array(p[:, 1])})

    return run


def _close(s: Settings) -> Batches:
    """The pairs whose wide signatures differ in no more bits than their sizes allow, smaller id first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(f"wide_{e}").to_pylist()), np.uint64).reshape(t.num_rows, WIDE) for e in "ab")
            n = t.column("size_a").to_numpy().astype(np.int64) + t.column("size_b").to_numpy()
            a, b = t.column("rep_a").to_numpy(), t.column("rep_b").to_numpy()
            ok = (np.bitwise_count(x ^ y).sum(1) <= _most(n, s)) & (a != b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["rep_a", "rep_b"])

    return run


def similarities(left: list[str], right: list[str], s: Settings) -> np.ndarray:
    """The share of common distinct shingles of each pair of whole texts; 0 for a text with too few words."""
    place: dict[str, int] = {}
    i, j = (np.array([place.setdefault(t, len(place)) for t in side], np.int64) for side in (left, right))
    rows, _, _, text, x = _shingles(list(place), s)
    if not len(rows):
        return np.zeros(len(left))
    order = np.lexsort((x, text))
    text, x = text[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    # Places among the different shingles, to be marked for one text and looked up for all its partners.
    x = np.unique(x[new], return_inverse=True)[1]
    size = np.zeros(len(place), np.int64)
    size[rows] = np.bincount(text[new], minlength=len(rows))
    start = np.cumsum(size) - size
    both, marked = np.zeros(len(i), np.int64), np.zeros(len(x), bool)
    order = np.argsort(i, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
        a = i[group[0]] if len(group) else 0
        own = x[start[a] : start[a] + size[a]]
        marked[own] = True
        for part in _chunks(size[j[group]], 1 << 21):
            some = group[part]
            pair, at = _ranges(start[j[some]], size[j[some]])
            both[some] = np.bincount(pair[marked[x[at]]], minlength=len(some))
        marked[own] = False
    return both / np.maximum(size[i] + size[j] - both, 1)


def _jaccard(s: Settings) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims = similarities(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), s)
            at = pa.array(np.flatnonzero(sims >= s.least))
            yield pa.RecordBatch.from_arrays([b.column("rep_a").take(at), b.column("rep_b").take(at), pa.array(sims[sims >= s.least])], names=["rep_a", "rep_b", "similarity"])

    return run


def _texts(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_type = 'text' and content is not null and id is not null").select("id", "content")


def near_links(chunks: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (rep_a, rep_b, similarity), rep_a < rep_b, between distinct texts, members (id, rep), and of these the copies, id <> rep.

    A distinct text is a word sequence; its class is named by its least id.
    chunks has (id, content, chunk_type); only chunk_type `text` with at
    least settings.words words takes part, null content and ids do not.
    Repeated rows count once. No link is lost: see the top of the module; the
    only assumption is that the 64-bit hashes of a pair's shingles differ.
    """
    s = settings or Settings()
    rows = _texts(chunks)
    shared = rows.sparkSession.sparkContext.broadcast(_common(rows, chunks.where("chunk_type = 'text' and id is not null").count(), s))
    signature = ", ".join(f"{w} bigint" for w in _SIGNATURE)
    sketches = materialise(rows.mapInArrow(_sketched(s, shared), f"id bigint, k1 bigint, k2 bigint, size int, {signature}, wide binary, " + ", ".join(f"codes{k} binary" for k in range(s.passes))), "sketch")
    classes = sketches.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("wide").alias("wide"))
    several = sketches.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("k1", "k2", "rep")
    copies = materialise(sketches.select("id", "k1", "k2").join(several, ["k1", "k2"]).where("id <> rep").select("id", "rep").distinct(), "copies")
    members = stacked(classes.select(F.col("rep").alias("id"), "rep"), copies)
    many, texts = sketches.agg(F.sum(sum(F.length(f"codes{k}") for k in range(s.passes))), F.count("*")).first()
    many = (many or 0) // 8
    parts = max(1, math.ceil(many / s.passes / s.rows))
    # Parts begin where a sample of at least 2,000 texts, or 100 postings a part, has them begin; they may differ in size, no row depends on it.
    rate = max(2000 / max(texts, 1), 100 * parts * s.passes / max(many, 1))
    bounds = rows.sparkSession.sparkContext.broadcast(_bounds(sketches, parts, min(1.0, rate), s))
    found = []
    for turn in range(s.passes):
        posted = sketches.where(f"length(codes{turn}) > 0").select("k1", "size", F.when(F.col("size") >= _LONG, F.col("wide")).alias("wide"), *_SIGNATURE, f"codes{turn}")
        dealt = posted.mapInArrow(_dealt(s, bounds, turn), "part int, rows binary, wider binary").repartitionById(parts, "part")
        found.append(materialise(dealt.mapInArrow(_scan(s), _SCAN), "pairs"))
    # One scan, which packs small files into few tasks.
    scanned = rows.sparkSession.read.schema(found[0].schema).parquet(*sorted({f.rpartition("/")[0] for t in found for f in t.inputFiles()}))
    edges = scanned.where("b is null")
    reach = F.floor((F.col("size") - F.col("pos")) * ((1 + s.least) / s.least) - F.col("size") + 1e-6)
    # Of the partitions that a bucket spans, the sizes of the later ones are larger: those within reach are met.
    spans = edges.groupBy("bucket", "pid").agg(F.min("size").alias("least"), F.max(reach).alias("most"))
    held = spans.groupBy("bucket").agg(F.collect_list(F.struct("pid", "least", "most")).alias("y")).where("size(y) > 1").select("bucket", "y", F.explode("y").alias("x"))
    met = held.select("bucket", F.col("x.pid").alias("lo"), F.explode(F.expr("transform(filter(y, p -> x.pid < p.pid and p.least <= x.most), p -> p.pid)")).alias("hi"))
    sides = met.select("*", F.explode(F.array("lo", "hi")).alias("pid"))
    across = edges.drop("b").join(sides, ["bucket", "pid"]).groupBy("bucket", "lo", "hi").applyInArrow(_tile(s), "a bigint, b bigint")
    pairs = scanned.where("b is not null").select("a", "b").unionByName(across).distinct()
    # Both ends by the least id of their text; should two texts share k1, each of them is tried.
    of = lambda end: classes.select(F.col("k1").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("rep", "size", "wide")))
    close = materialise(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_close(s), "rep_a bigint, rep_b bigint"), "close")
    for table in found:
        release(table)
    # Only the texts that are asked for; their ids are broadcast if a count shows that they are few.
    ids = close.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    ids = F.broadcast(ids) if close.count() <= s.broadcast else ids
    text = rows.join(ids, "id", "left_semi").groupBy("id").agg(F.min("content").alias("text"))
    both = close.join(text.withColumnsRenamed({"id": "rep_a", "text": "text_a"}), "rep_a").join(text.withColumnsRenamed({"id": "rep_b", "text": "text_b"}), "rep_b")
    links = materialise(both.mapInArrow(_jaccard(s), "rep_a bigint, rep_b bigint, similarity double"), "links")
    release(close)
    return links, members, copies


def near_pairs(chunks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """All pairs of chunks (chunk_a, chunk_b), chunk_a < chunk_b, with similar texts, copies included."""
    links, _, copies = near_links(chunks, settings)
    x, y = (copies.withColumnsRenamed({"id": v, "rep": f"rep_{e}"}) for v, e in (("x", "a"), ("y", "b")))
    # A text stands for itself; its copies, mostly few, are joined to that.
    left = stacked(links.select(F.col("rep_a").alias("x"), "rep_b"), links.join(x, "rep_a").select("x", "rep_b"))
    between = stacked(left.select("x", F.col("rep_b").alias("y")), left.join(y, "rep_b").select("x", "y"))
    same = copies.select(F.col("rep").alias("x"), F.col("id").alias("y"))
    both = copies.select(F.col("id").alias("x"), "rep").join(copies.select(F.col("id").alias("y"), "rep"), "rep").where("x < y").select("x", "y")
    return stacked(between, same, both).select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b")).where("chunk_a < chunk_b").distinct()


def near_groups(chunks: DataFrame, documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per chunk of the comparison: (chunk_id, class_id, links).

    class_id is the least chunk id of the connected component over links
    between texts, copies, and same places of files uploaded again (equal
    lower-case file_hash and chunk_index); links counts the other texts that
    the chunk's text is linked to directly.
    """
    links, members, _ = near_links(chunks, settings)
    hashed = documents.where("file_hash is not null and file_hash <> ''").select("doc_id", F.lower("file_hash").alias("h"))
    placed = chunks.where("id is not null").select("id", "doc_id", "chunk_index").distinct().join(hashed.distinct(), "doc_id")
    least = placed.groupBy("h", "chunk_index").agg(F.min("id").alias("first"))
    again = placed.join(least, ["h", "chunk_index"]).where("id <> first").join(members.select("id"), "id", "left_semi").join(members.select(F.col("id").alias("first")), "first", "left_semi")
    edges = links.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).unionByName(again.select(F.col("id").alias("u"), F.col("first").alias("v")))
    edges = edges.unionByName(members.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    labels = connected_components(edges)
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = members.join(labels, members.id == labels.node, "left").join(ends, "rep", "left")
    return out.select(F.col("id").alias("chunk_id"), F.coalesce("component", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
