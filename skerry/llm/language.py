"""Problem 10: the language of every document and of its parts.

Sparse multinomial logistic regression on TF-IDF character n-grams (two to
four characters, hashed), trained with follow-the-regularised-leader and
elastic-net penalties on a bounded sample of labelled documents and then
calibrated with one temperature on held-out ones. Document frequencies are
counted over all documents. A text is scored sentence by sentence and its
language runs are the best path through a chain that is charged for switches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODES = ["en", "fr", "de", "es", "it", "nl"]
BUCKETS = 1 << 16
_ORDERS = (2, 3, 4)
_UNIT = re.compile(r"[^\n]+?(?:[.!?…][\"'»”)\]]*(?=\s)|(?=\n)|$)")
_LETTERS = np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 32 for i in range(1 << 16)], np.uint32)
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@dataclass
class Settings:
    """At most `sample` labelled documents of a language train the model; `switch` is the charge, in nats, of a change of language; `noise` are the shares of random labels tried."""

    sample: int = 500
    units: int = 20
    longest: int = 2000
    switch: float = 6.0
    epochs: int = 3
    alpha: float = 0.5
    l1: float = 1e-4
    l2: float = 1e-5
    chars: int = 200_000
    noise: tuple[float, ...] = (0.0, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2)


def label_code(c: str | Column) -> Column:
    """The code a label stands for by its first two letters, null for none."""
    two = F.lower(F.substring(F.trim(c), 1, 2))
    return F.when(two.isin(CODES), two)


def units_of(text: str, longest: int) -> list[tuple[int, int]]:
    """Sentences, lines and tables of a text; longer ones are cut."""
    out: list[tuple[int, int]] = []
    for m in _UNIT.finditer(text):
        s, e = m.span()
        # The rows of a table are one unit: alone they are mostly names and numbers.
        if out and text[s] == "|" and text[out[-1][0]] == "|" and text[out[-1][1] : s].isspace() and e - out[-1][0] <= longest:
            out[-1] = (out[-1][0], e)
            continue
        while e - s > longest:
            cut = text.rfind(" ", s + longest // 2, s + longest)
            cut = cut if cut > s else s + longest
            out.append((s, cut))
            s = cut
        if s < e:
            out.append((s, e))
    return out


def grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all pieces, and where each piece's begin (one more than pieces)."""
    big = "\n".join(["", *(p.replace("\n", " ") for p in pieces), ""])
    a = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = a == 10
    c = np.where(line, 10, _LETTERS[np.minimum(a, 0xFFFF)])
    keep = np.ones(len(c), bool)
    keep[1:] = ~((c[1:] == 32) & ((c[:-1] == 32) | (c[:-1] == 10)))
    c = c[keep]
    line = c == 10
    # A border line counts as a space within n-grams, but none reaches across it.
    first = np.flatnonzero(line)
    v = np.where(line, np.uint32(32), c)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore"):
        h = v * _SALT[0]
        whole = None
        for k in range(1, max(_ORDERS)):
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _SALT[k] + v[k:]
            n = len(h)
            # Only the first and the last character may be a border.
            if k > 1:
                whole = ~line[k - 1 : k - 1 + n] if whole is None else whole[:n] & ~line[k - 1 : k - 1 + n]
            if k + 1 in _ORDERS:
                inner = ~(line[:n] & line[k : k + n])
                inner = inner if whole is None else inner & whole
                mixed = h[inner]
                mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x5BD1E995)
                # How many of the n-grams begin in each piece or at the line before it.
                count = np.add.reduceat(np.append(inner, np.zeros(len(c) - n, bool)).astype(np.int64), first)[: len(pieces)]
                found.append((mixed >> np.uint32(16), count))
    # Pieces one after another, in each the shorter n-grams first.
    counts = np.array([n for _, n in found])
    starts = np.concatenate([[0], np.cumsum(counts.sum(0))]).astype(np.int64)
    idx = np.empty(starts[-1], np.int64)
    at = starts[:-1]
    for x, n in found:
        idx[np.arange(len(x)) + np.repeat(at - (np.cumsum(n) - n), n)] = x
        at = at + n
    return idx, starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows between starts, zero for empty ranges."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, pieces: list[str]) -> np.ndarray:
        idx, starts = grams(pieces)
        norm, z = np.zeros(len(pieces)), np.zeros((len(pieces), self._scaled.shape[1]), np.float32)
        lo = 0
        while lo < len(pieces):
            # So many pieces at a time that their rows stay in the cache.
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + (1 << 14), "right")) - 1)
            part, at = idx[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]
            norm[lo:hi] = np.sqrt(_sums(self._squares.take(part), at))
            z[lo:hi] = _sums(self._scaled.take(part, axis=0), at)
            lo = hi
        return z / np.maximum(norm, 1e-9)[:, None] + self.bias

    def __post_init__(self) -> None:
        self._scaled = np.ascontiguousarray((self.weights * self.idf[:, None]).astype(np.float32))
        self._squares = self.idf * self.idf

    def log_probs(self, pieces: list[str]) -> np.ndarray:
        z = self.logits(pieces).astype(np.float64) / self.temperature
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(pieces: list[str], labels: np.ndarray, idf: np.ndarray, s: Settings, seed: int = 5) -> Model:
    """FTRL-proximal with elastic net over mini-batches, then a temperature on the held-out tenth.

    After the first epoch, pieces whose label the model firmly contradicts
    are set aside: labels may be wrong, and a document's parts may differ.
    """
    rng = np.random.default_rng(seed)
    k = len(CODES)
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weight(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        w = -(zz - np.sign(zz) * s.l1) / ((1.0 + np.sqrt(nn)) / s.alpha + s.l2)
        return np.where(np.abs(zz) <= s.l1, 0.0, w)

    held = rng.random(len(pieces)) < 0.1
    use = np.flatnonzero(~held)
    for epoch in range(s.epochs):
        order = rng.permutation(use)
        for lo in range(0, len(order), 128):
            at = order[lo : lo + 128]
            idx, starts = grams([pieces[i] for i in at])
            if not len(idx):
                continue
            v = idf[idx]
            norm = np.sqrt(_sums(v * v, starts))
            x = v / np.repeat(np.maximum(norm, 1e-9), np.diff(starts))
            seen, inv = np.unique(idx, return_inverse=True)
            w = weight(z[seen], n[seen])
            b = weight(zb, nb)
            p = _softmax(_sums(w[inv] * x[:, None], starts) + b)
            p[np.arange(len(at)), labels[at]] -= 1
            p /= 16
            row = np.repeat(np.arange(len(at)), np.diff(starts))
            g = np.stack([np.bincount(inv, p[row, c] * x, len(seen)) for c in range(k)], 1)
            old = n[seen]
            n[seen] = old + g * g
            z[seen] += g - (np.sqrt(n[seen]) - np.sqrt(old)) / s.alpha * w
            gb = p.sum(0)
            oldb = nb.copy()
            nb += gb * gb
            zb += gb - (np.sqrt(nb) - np.sqrt(oldb)) / s.alpha * b
        model = Model(weight(z, n), weight(zb, nb), idf)
        if epoch == 0 and len(use):
            firm = np.concatenate([_softmax(model.logits([pieces[i] for i in use[lo : lo + 500]]) * 2) for lo in range(0, len(use), 500)])
            wrong = (firm.argmax(1) != labels[use]) & (firm.max(1) > 0.6)
            use = use[~wrong]
    test = np.flatnonzero(held)
    if len(test):
        lg = np.concatenate([model.logits([pieces[i] for i in test[lo : lo + 500]]) for lo in range(0, len(test), 500)])
        y = labels[test]
        # All held-out pieces count. Some labels are wrong for reasons that have nothing to do with the text: a share
        # of labels, fitted together with the temperature, is taken to be drawn at random.
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        noise = np.array(s.noise)
        own = np.stack([_softmax(lg / t)[np.arange(len(y)), y] for t in grid])
        loss = -np.log((1 - noise)[None, :, None] * own[:, None] + noise[None, :, None] / k + 1e-12).mean(2)
        model.temperature = float(grid[np.unravel_index(int(np.argmin(loss)), loss.shape)[0]])
    return model


def against(lp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What each unit holds against each language.

    It counts from 1.5 nats on, up to a quarter nat a letter, so that a row of
    names or a lone heading, about which the model cannot be sure, goes along
    with its neighbours.
    """
    far = np.maximum(lp.max(1, keepdims=True) - lp - 1.5, 0.0)
    return np.minimum(np.minimum(far, 0.25 * size[:, None]), 16.0)


def runs(held: np.ndarray, switch: float, counts: np.ndarray | None = None) -> np.ndarray:
    """The language of each unit on the path with the least held against it, each switch charged.

    The units of several texts follow each other, `counts` of each; one unit of every text is looked at in a step.
    """
    counts = np.array([len(held)]) if counts is None else counts
    order = np.argsort(-counts, kind="stable")
    n, start = counts[order], (np.cumsum(counts) - counts)[order]
    # How many texts have a unit i: those come first.
    live = np.searchsorted(-n, -np.arange(int(n.max(initial=0))), "left")
    score, langs = -held, np.arange(held.shape[1])
    best, back = score[start[: live[0] if len(live) else 0]], np.zeros(held.shape, np.int8)
    for i in range(1, len(live)):
        m, at = live[i], start[: live[i]] + i
        old = best[:m]
        top = old.argmax(1)
        most = old[np.arange(m), top][:, None] - switch
        stay = old >= most
        back[at] = np.where(stay, langs, top[:, None])
        best[:m] = np.where(stay, old, most) + score[at]
    y, path = best.argmax(1), np.zeros(len(held), np.int64)
    for i in range(len(live) - 1, -1, -1):
        m, at = live[i], start[: live[i]] + i
        path[at] = y[:m]
        y[:m] = back[at, y[:m]]
    return path


@cache
def _kinds() -> np.ndarray:
    """Of the first 65,536 characters: 1 letters, 2 other characters of words and the slash, 0 the rest."""
    return np.array([_kind(chr(i)) for i in range(1 << 16)], np.uint8)


def _kind(c: str) -> int:
    return 1 if c.isalnum() and not c.isdecimal() else 2 if c.isalnum() or c in "_/" else 0


def plain_letters(pieces: list[str]) -> np.ndarray:
    """How many letters of each piece stand in words of letters alone that touch no slash."""
    a = np.frombuffer("\0".join(["", *pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[np.minimum(a, 0xFFFF)]
    far = np.flatnonzero(a > 0xFFFF)
    kind[far] = [_kind(chr(i)) for i in a[far].tolist()]
    letter = kind == 1
    lo, hi = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1, np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    n = np.where((kind[lo - 1] == 0) & (kind[hi] == 0), hi - lo, 0)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
    total = np.concatenate([[0], np.cumsum(n)])
    return np.diff(total[np.searchsorted(lo, ends)], prepend=0)


def segments(texts: list[str], model: Model, s: Settings) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, language, confidence) of the runs of each text."""
    spans = [units_of(t, s.longest) for t in texts]
    flat = [t[a:b] for t, sp in zip(texts, spans) for a, b in sp]
    lps: list[np.ndarray] = []
    sizes = [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(flat):
        hi, chars = lo, 0
        while hi < len(flat) and (chars == 0 or chars + len(flat[hi]) <= s.chars):
            chars += len(flat[hi])
            hi += 1
        lps.append(model.log_probs(flat[lo:hi]))
        sizes.append(plain_letters(flat[lo:hi]))
        lo = hi
    lp = np.concatenate(lps) if lps else np.zeros((0, len(CODES)))
    # Letters of words; codes and paths are of no language, unless a text has nothing else.
    size = np.concatenate(sizes)
    counts = np.array([len(sp) for sp in spans])
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    for i in np.flatnonzero(_sums(size, starts) == 0):
        size[starts[i] : starts[i + 1]] = [sum(map(str.isalpha, x)) for x in flat[starts[i] : starts[i + 1]]]
    held = against(lp, size)
    total, letters = _sums(held, starts), _sums(size, starts)
    # A language that nothing is held against is the best path by itself.
    # Of several such languages, the one the whole text speaks for most.
    sums = np.where(total == 0, _sums(lp * size[:, None], starts), -np.inf)
    free = (total == 0).any(1)
    langs = np.repeat(sums.argmax(1), counts)
    hard = np.repeat(~free & (letters > 0), counts)
    if hard.any():
        langs[hard] = runs(held[hard] - 1e-6 * lp[hard], s.switch, counts[~free & (letters > 0)])
    out = []
    for i, sp in enumerate(spans):
        at, n = int(starts[i]), len(sp)
        if not n or not letters[i]:
            out.append([])
            continue
        own, w, path = lp[at : at + n], size[at : at + n], langs[at : at + n]
        cut = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), n]
        segs = []
        for i, j in zip(cut[:-1], cut[1:]):
            weight = w[i:j].astype(float)
            conf = float((np.exp(own[i:j, path[i]]) * weight).sum() / max(weight.sum(), 1.0))
            segs.append((sp[i][0], sp[j - 1][1], int(path[i]), conf))
        out.append(segs)
    return out


def _frequencies(s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            texts = b.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (chars == 0 or chars + len(texts[hi]) <= s.chars):
                    chars += len(texts[hi])
                    hi += 1
                # A long text is read in stretches; which n-grams it has does not depend on them but at their borders.
                if chars > s.chars:
                    flags = np.zeros(BUCKETS, bool)
                    for a in range(0, chars, s.chars):
                        flags[grams([texts[lo][a : a + s.chars]])[0]] = True
                    df += flags
                else:
                    idx, starts = grams(texts[lo:hi])
                    key = np.sort((np.repeat(np.arange(hi - lo), np.diff(starts)) * BUCKETS + idx).astype(np.uint32 if hi - lo <= 1 << 16 else np.uint64))
                    df += np.bincount(key[np.append(True, key[1:] != key[:-1])[: len(key)]] % BUCKETS, minlength=BUCKETS)
                docs += hi - lo
                lo = hi
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(df[seen], docs))], names=["bucket", "df"])

    return run


def fit(documents: DataFrame, s: Settings) -> Model | None:
    """Document frequencies over all documents, and the model from the sample; None without labelled text."""
    rows = documents.where("text is not null and text <> ''").select("doc_id", "text", "lang")
    counts = rows.select("text").mapInArrow(_frequencies(s), "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))
    idf, docs = np.zeros(BUCKETS), 0
    got = {r.bucket: r.df for r in counts.collect()}  # at most BUCKETS + 1 rows
    docs = got.pop(-1, 0)
    for b, n in got.items():
        idf[b] = n
    idf = np.log((1 + docs) / (1 + idf)) + 1
    labelled = rows.withColumn("code", label_code("lang")).where("code is not null")
    n = {r.code: r.n for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    rate = F.coalesce(*[F.when(F.col("code") == c, F.lit(min(1.0, s.sample / k))) for c, k in sorted(n.items())], F.lit(0.0))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).limit(2 * s.sample * len(CODES)).select("doc_id", "text", "code").collect()
    pieces, labels = [], []
    for r in sorted(picked, key=lambda r: (r.doc_id or 0, r.text)):
        spans = [(a, b) for a, b in units_of(r.text, s.longest) if sum(map(str.isalpha, r.text[a:b])) >= 12]
        step = max(1, len(spans) // s.units)
        for a, b in spans[::step][: s.units]:
            pieces.append(r.text[a:b])
            labels.append(CODES.index(r.code))
    return train(pieces, np.array(labels), idf, s) if pieces else None


_OUT = "doc_id bigint, lang string, segment_no int, start_char int, end_char int, lang_code string, confidence double, n_segments int"


def _labelled(shared, s: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = []
                for i, segs in enumerate(segments(part.column("text").to_pylist(), model, s)):
                    rows += [(i, k, a, e, CODES[c], conf, len(segs)) for k, (a, e, c, conf) in enumerate(segs)]
                cols = list(zip(*rows)) if rows else [()] * 7
                at = pa.array(list(cols[0]), pa.int32())
                types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
                hashes = np.array([xxhash.xxh64_intdigest(t) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("lang").take(at), *(pa.array(list(c), t) for c, t in zip(cols[1:], types)), pa.array(hashes).take(at)], names=[*(f.split()[0] for f in _OUT.split(", ")), "text_hash"])

    return run


def language_segments(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, lang, segment_no from 0, start_char, end_char, lang_code, confidence, n_segments) of every text.

    A segment is a run of one language. Null, empty and letterless texts have
    no segments; null doc_ids are left out, a repeated doc_id counts once (one of
    its texts, by hash); labels are read by their first two letters. Without any
    labelled text there is nothing to learn from and the result is empty.
    """
    s = settings or Settings()
    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text", "lang")
    model = fit(documents, s)
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], _OUT)
    shared = spark.sparkContext.broadcast(model)
    found = rows.mapInArrow(_labelled(shared, s), _OUT + ", text_hash bigint")
    # Repeated ids: the segments of one text, with one label.
    one = found.groupBy("doc_id", "lang", "text_hash", "n_segments").agg(F.array_sort(F.collect_set(F.struct("segment_no", "start_char", "end_char", "lang_code", "confidence"))).alias("x"))
    best = one.groupBy("doc_id").agg(F.max(F.struct("text_hash", F.coalesce("lang", F.lit("")).alias("lang"), "n_segments", "x")).alias("y"))
    return best.select("doc_id", F.col("y.lang").alias("lang"), F.col("y.n_segments").alias("n_segments"), F.explode("y.x").alias("z")).select("doc_id", "lang", "z.segment_no", "z.start_char", "z.end_char", "z.lang_code", "z.confidence", "n_segments")


def label_faults(documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, segment_no, lang_code) of documents with a missing or wrong label or several languages."""
    segs = language_segments(documents, settings)
    return segs.where((F.col("n_segments") > 1) | ~F.coalesce(label_code("lang") == F.col("lang_code"), F.lit(False))).select("doc_id", "segment_no", "lang_code")
