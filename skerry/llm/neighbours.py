"""Problem 4: the k most similar vectors of every vector.

An inverted file with product-quantised residuals, fitted per model on a
bounded sample. Cells are grouped into blocks of about `block` vectors; a
vector is sent once to the block of its own cell, and to those further blocks
that hold cells it has to probe. A task holds one block, scores codes with
asymmetric distance tables, and reranks the best candidates in double
precision on the spot, so full vectors are shuffled once per block they
matter to. The sample bounds the number of cells, and a sample in which a
vector's neighbours no longer are says nothing of how far they lie: a model
with more than `dense` vectors for each sampled one has its cells fitted in
tasks, on one in `dense` of its vectors, and some vectors' neighbours are
looked for among all. A cell that grows beyond `fat` vectors is cut further by centroids fitted where it is held, and a query
looks only into the finer cells near it, so that what is done for a vector
grows far slower than their number. Copies of a vector are found over all rows;
the one of the least id is indexed and brings the k + 1 least ids of its group
along, which stand for the group wherever it is found, and all copies share
what it finds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.shared import materialise

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass
class Settings:
    """Parameters of the index; the driver sees at most `sample` vectors of a model and about `samples` of all.

    A model with more than `dense` times its sample has at most `cells` cells,
    made and looked for below those of a coarser fit: `tops` of these are probed.

    With `exact` every vector meets every other of its model, in blocks, and
    the result is the exact one: work grows with the square of the rows.
    """

    dim: int = 96
    k: int = 5
    sample: int = 24_000
    samples: int = 200_000
    per_cell: int = 128
    fat: int = 1_024
    probes: int = 24
    parts: int = 24
    codes: int = 256
    rerank: int = 96
    block: int = 8_192
    rounds: int = 8
    asked: int = 6_000
    missed: float = 0.002
    models: int = 256
    dense: int = 6
    cells: int = 100_000
    tops: int = 32
    exact: bool = False


@dataclass
class Index:
    """What a model's vectors are assigned with; its size does not grow with the rows."""

    centroids: np.ndarray
    books: np.ndarray
    margin: float
    block_of: np.ndarray
    tops: np.ndarray | None = None
    top_of: np.ndarray | None = None
    size: np.ndarray | None = None


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from distinct random rows; an empty cell restarts at the row farthest from its centre."""
    first = np.unique(x, axis=0)
    c = first[rng.choice(len(first), min(k, len(first)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        d = (c * c).sum(1)[None] - 2 * (x @ c.T)
        a = d.argmin(1)
        n = np.bincount(a, minlength=len(c))
        total = np.zeros_like(c)
        order = np.argsort(a, kind="stable")
        starts = np.flatnonzero(np.diff(np.concatenate([[-1], a[order]])))
        total[a[order][starts]] = np.add.reduceat(x[order], starts, axis=0)
        full = n > 0
        c[full] = total[full] / n[full, None]
        if (~full).any():
            far = np.argsort(-d[np.arange(len(x)), a])[: (~full).sum()]
            c[np.flatnonzero(~full)[: len(far)]] = x[far]
    return c


def fit(raw: np.ndarray, total: int, s: Settings, seed: int = 7) -> Index:
    """Fit cells, residual codebooks, probing bounds and blocks on a sample of `total` vectors."""
    rng = np.random.default_rng(seed)
    x = unit(raw.astype(np.float64)).astype(np.float32)
    k = int(min(max(1, math.ceil(total / s.per_cell)), max(1, len(x) // 8)))
    c = kmeans(x, k, s.rounds, rng)
    d = np.maximum(0, 1 + (c * c).sum(1)[None] - 2 * (x @ c.T))
    own = d.argmin(1)
    margin = _margin(x, c, own, s, rng)
    # A cell of more than a block is a block by itself.
    group = kmeans(c, max(1, math.ceil(2 * total / s.block)), 6, rng)
    of = ((group * group).sum(1)[None] - 2 * (c @ group.T)).argmin(1)
    return _index(x, c, own, group, of, math.inf if s.exact else margin, total, s, rng)


def fit_below(raw: np.ndarray, tops: np.ndarray, c: np.ndarray, n: np.ndarray, asked: np.ndarray, near: np.ndarray, total: int, s: Settings, seed: int = 7) -> Index:
    """As fit(), from cells that hold n vectors of a larger sample each; near are the neighbours of the unit vectors asked."""
    rng = np.random.default_rng(seed)
    x = unit(raw.astype(np.float64)).astype(np.float32)
    top_of = np.concatenate([((tops * tops).sum(1)[None] - 2 * (c[lo : lo + 4096] @ tops.T)).argmin(1) for lo in range(0, len(c), 4096)])
    order = np.argsort(top_of, kind="stable")
    c, n, top_of = c[order], n[order], top_of[order]
    size = n * (total / n.sum())
    # A few cells are looked through without tops.
    below = (tops, top_of) if len(c) > max(256, s.sample // 8) else (None, None)
    ix = Index(c, np.zeros(0), 0.0, np.zeros(len(c), np.int64), *below, size)
    own = probe_cells(x, ix, s)[0]
    # How far a neighbour's cell is beyond the own one.
    gaps = np.zeros(1)
    if len(near):
        cells = probe_cells(near, ix, s)[0]
        d = np.sqrt(np.maximum(0, ((asked - c[cells]) ** 2).sum(1)))
        gaps = d - np.sqrt(np.maximum(0, ((asked - c[probe_cells(asked, ix, s)[0]]) ** 2).sum(1)))
    margin = float(np.quantile(gaps, 1 - s.missed))
    groups, of = [np.zeros((0, c.shape[1]), np.float32)], np.zeros(len(c), np.int64)
    for t in np.unique(top_of):
        mine = np.flatnonzero(top_of == t)
        g = kmeans(c[mine], max(1, math.ceil(2 * total * n[mine].sum() / n.sum() / s.block)), 6, rng)
        of[mine] = ((g * g).sum(1)[None] - 2 * (c[mine] @ g.T)).argmin(1) + sum(map(len, groups))
        groups.append(g)
    ix = _index(x, c, own, np.concatenate(groups), of, margin, total, s, rng, size)
    ix.tops, ix.top_of, ix.size = *below, size
    return ix


def _index(x: np.ndarray, c: np.ndarray, own: np.ndarray, group: np.ndarray, of: np.ndarray, margin: float, total: int, s: Settings, rng: np.random.Generator, size: np.ndarray | None = None) -> Index:
    """Residual codebooks, and blocks of cells that are in one group as far as they go."""
    k = len(c)
    residual = (x - c[own])[rng.permutation(len(x))[:12_000]]
    width = s.dim // s.parts
    m = int(min(s.codes, max(1, len(residual) // 4)))
    books = np.zeros((s.parts, m, width), np.float32)
    for p in range(s.parts):
        b = kmeans(residual[:, p * width : (p + 1) * width], m, s.rounds, rng)
        books[p, : len(b)] = b
        books[p, len(b) :] = b[0]
    if size is None:
        size = np.bincount(own, minlength=k) * (total / len(x))
    held = np.bincount(of, weights=size, minlength=len(group))
    block_of = np.full(k, -1, np.int64)
    loads: list[float] = []
    for g in np.argsort(-held, kind="stable").tolist():
        todo = np.flatnonzero(of == g)
        mine: list[int] = []
        for j in todo[np.argsort(-(c[todo] @ group[g]))]:
            at = next((b for b in mine[::-1] if loads[b] + size[j] <= s.block), None)
            if at is None:
                # The last ones of other groups may still have room.
                at = next((b for b in range(max(0, len(loads) - 64), len(loads)) if loads[b] + size[j] <= s.block), len(loads))
                mine.append(at)
            if at == len(loads):
                loads.append(0.0)
            block_of[j] = at
            loads[at] += size[j]
    return Index(c, books, margin, block_of)


def _margin(x: np.ndarray, c: np.ndarray, own: np.ndarray, s: Settings, rng: np.random.Generator) -> float:
    """How much farther than its own centroid a vector's neighbours' centroids are, at most for all but `missed` of the neighbours.

    Asked of some sampled vectors against the whole sample, where neighbours
    are thinner and so farther than among all vectors.
    """
    if len(x) <= s.k + 1:
        return math.inf
    ask = rng.permutation(len(x))[: s.asked]
    gaps = []
    for lo in range(0, len(ask), 500):
        at = ask[lo : lo + 500]
        near = np.argpartition(-(x[at] @ x.T), s.k, axis=1)[:, : s.k + 1]
        d = np.sqrt(np.maximum(0, 1 + (c * c).sum(1)[None] - 2 * (x[at] @ c.T)))
        gaps.append(np.take_along_axis(d, own[near], 1) - d[np.arange(len(at)), own[at]][:, None])
    return float(np.quantile(np.concatenate(gaps), 1 - s.missed))


def _vectors(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and raw float32 rows of the usable vectors of a batch."""
    col = b.column("embedding")
    right = pc.fill_null(pc.equal(pc.list_value_length(col), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(right)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    x = pc.fill_null(pc.cast(col.take(pa.array(at)).flatten(), pa.float32()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], np.ascontiguousarray(x[good])


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())])
    return fixed.cast(pa.binary())


def _sampled(dim: int) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _vectors(b, dim)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("model").take(at), b.column("chunk_id").take(at), _binary(x + np.float32(0))], names=["model", "chunk_id", "v"])  # no -0.0

    return run


def probe_cells(x: np.ndarray, ix: Index, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Own cell, and (rows, probes) cells to probe with -1 for none.

    Of the nearest cells those are left out that are farther than the own
    one by more than the fitted margin, unless nearer ones hold fewer vectors
    than are reranked (of cells fitted in tasks, whose sizes are known).
    """
    if ix.tops is not None:
        return _below(x, ix, s)
    d = np.maximum(0, 1 + (ix.centroids * ix.centroids).sum(1)[None] - 2 * (x @ ix.centroids.T))
    n = d.shape[1] if s.exact else min(s.probes, d.shape[1])
    near = np.argpartition(d, n - 1, axis=1)[:, :n]
    dn = np.take_along_axis(d, near, 1)
    order = np.argsort(dn, axis=1)
    near, dn = np.take_along_axis(near, order, 1), np.sqrt(np.take_along_axis(dn, order, 1))
    own = near[:, 0].copy()
    keep = dn <= dn[:, :1] + ix.margin
    keep[:, : min(2, n)] = True
    if ix.size is not None:
        keep |= np.cumsum(ix.size[near], axis=1) - ix.size[near] < s.rerank
    return own, np.where(keep, near, -1)


def _below(x: np.ndarray, ix: Index, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """As probe_cells(), among the cells below the nearest tops."""
    n = min(s.tops, len(ix.tops))
    first = np.searchsorted(ix.top_of, np.arange(len(ix.tops) + 1))
    half = (ix.centroids * ix.centroids).sum(1)
    own, out = np.empty(len(x), np.int64), np.full((len(x), s.probes), -1, np.int64)
    for lo in range(0, len(x), 1024):
        some = x[lo : lo + 1024]
        t = (ix.tops * ix.tops).sum(1)[None] - 2 * (some @ ix.tops.T)
        near = np.argpartition(t, n - 1, axis=1)[:, :n]
        order = np.argsort(near.ravel(), kind="stable")
        of, rows = near.ravel()[order], order // n
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
        parts, least = [], np.full(len(some), np.inf, np.float32)
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            a, b = first[of[i]], first[of[i] + 1]
            if a == b:
                continue
            d = half[a:b] - 2 * (some[rows[i:j]] @ ix.centroids[a:b].T)
            least[rows[i:j]] = np.minimum(least[rows[i:j]], d.min(1))
            parts.append((rows[i:j], a, d))
        reach = (np.sqrt(np.maximum(0, 1 + least)) + ix.margin) ** 2 - 1
        who, cell, far = [], [], []
        for r, a, d in parts:
            # The nearest of these cells stays too: two cells at least are probed.
            i, j = np.nonzero((d <= reach[r][:, None]) | (d <= d.min(1, keepdims=True)))
            who.append(r[i])
            cell.append(j + a)
            far.append(d[i, j])
        who, cell, far = np.concatenate(who), np.concatenate(cell), np.concatenate(far)
        order = np.lexsort((cell, far, who))
        who, cell, far = who[order], cell[order], far[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        own[lo + who[place == 0]] = cell[place == 0]
        before = np.cumsum(ix.size[cell]) - ix.size[cell]
        before -= before[np.searchsorted(who, who)]
        good = (place < s.probes) & ((far <= reach[who]) | (place < 2) | (before < s.rerank))
        out[lo + who[good], place[good]] = cell[good]
    return own, out


def _under(shared, s: Settings) -> Batches:
    """The nearest top of each sampled vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = shared.value
        for b in _sampled(s.dim)(batches):
            x = unit(np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(-1, s.dim).astype(np.float64)).astype(np.float32)
            models = np.array(b.column("model").to_pylist(), object)
            top = np.zeros(len(x), np.int32)
            for m, t in tops.items():
                mine = np.flatnonzero(models == m)
                top[mine] = ((t * t).sum(1)[None] - 2 * (x[mine] @ t.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("model"), pa.array(top), _binary(x)], names=["model", "top", "v"])

    return run


def _cells(per: dict[str, int], s: Settings) -> Callable[[pa.Table], pa.Table]:
    """Cells of the sampled vectors under one top, one for `per` of them, with how many each holds; a heavy top is fitted on some."""

    def run(t: pa.Table) -> pa.Table:
        model = t.column("model")[0].as_py()
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(t.num_rows, s.dim)
        x = np.unique(x, axis=0)
        rng = np.random.default_rng(11)
        k = math.ceil(len(x) / per[model])
        c = kmeans(x[rng.permutation(len(x))[: max(20_000, 8 * k)]], k, s.rounds, rng)
        own = np.concatenate([((c * c).sum(1)[None] - 2 * (x[lo : lo + 4096] @ c.T)).argmin(1) for lo in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(c))
        return pa.table({"model": pa.array([model] * len(c), pa.string()), "n": pa.array(n, pa.int64()), "v": _binary(c)})

    return run


def _nearest_of(shared, s: Settings) -> Batches:
    """For the vectors asked of each model the k nearest others of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {m: (a, np.full((len(a), s.k), -np.inf, np.float32), np.zeros((len(a), s.k, s.dim), np.float32)) for m, a in shared.value.items()}
        for b in batches:
            at, raw = _vectors(b, s.dim)
            models = np.array(b.column("model").to_pylist(), object)[at]
            for m, (a, top, v) in best.items():
                x = raw[models == m]
                if not len(x):
                    continue
                x = unit(x.astype(np.float64)).astype(np.float32)
                cos = a @ x.T
                # The vector itself and its copies are no neighbours.
                cos[cos > 1 - 1e-6] = -np.inf
                near = np.argpartition(-cos, min(s.k, len(x)) - 1, axis=1)[:, : s.k]
                score = np.concatenate([top, np.take_along_axis(cos, near, 1)], axis=1)
                pick = np.argsort(-score, axis=1, kind="stable")[:, : s.k]
                v[:] = np.take_along_axis(np.concatenate([v, x[near]], axis=1), pick[:, :, None], 1)
                top[:] = np.take_along_axis(score, pick, 1)
        for m, (a, top, v) in best.items():
            i, j = np.nonzero(np.isfinite(top))
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(top[i, j].astype(np.float64)), _binary(v[i, j])], names=["model", "asked", "cosine", "v"])

    return run


def _fitted_below(rows: DataFrame, samples: dict[str, np.ndarray], totals: dict[str, int], s: Settings) -> dict[str, Index]:
    """Indexes of models that have more than `dense` vectors for each sampled one; what the driver gets is bounded by `cells`."""
    sc = rows.sparkSession.sparkContext
    rng = np.random.default_rng(7)
    tops, asked, per = {}, {}, {}
    for m, raw in samples.items():
        x = unit(raw.astype(np.float64)).astype(np.float32)
        cells = min(s.cells, math.ceil(totals[m] / s.per_cell))
        tops[m] = kmeans(x, min(max(1, math.ceil(cells / 256)), max(1, len(x) // 8)), s.rounds, rng)
        asked[m] = x[rng.permutation(len(x))[:400]]
        per[m] = max(1, math.ceil(totals[m] / s.dense / cells))
    rows = rows.where(F.col("model").isin(list(samples)))
    # By the vector, so that copies are taken or left together.
    some = rows.where(F.pmod(F.xxhash64("embedding"), F.lit(s.dense)) == 0)
    under = some.mapInArrow(_under(sc.broadcast(tops), s), "model string, top int, v binary")
    cells = under.groupBy("model", "top").applyInArrow(_cells(per, s), "model string, n bigint, v binary").toArrow()
    near = rows.coalesce(4 * sc.defaultParallelism).mapInArrow(_nearest_of(sc.broadcast(asked), s), "model string, asked int, cosine double, v binary").toArrow()
    out = {}
    for m, raw in samples.items():
        mine = cells.filter(pc.equal(cells.column("model"), m))
        c = np.frombuffer(b"".join(mine.column("v").to_pylist()), np.float32).reshape(-1, s.dim)
        found = near.filter(pc.equal(near.column("model"), m))
        a, cos = found.column("asked").to_numpy(), found.column("cosine").to_numpy()
        v = np.frombuffer(b"".join(found.column("v").to_pylist()), np.float32).reshape(-1, s.dim)
        order = np.lexsort((-cos, a))
        order = order[np.arange(len(order)) - np.searchsorted(a[order], a[order]) < s.k]
        out[m] = fit_below(raw, tops[m], c, np.maximum(1, mine.column("n").to_numpy()), asked[m][a[order]], v[order], totals[m], s)
    return out


_SENT = "block int, model string, chunk_id bigint, v binary, own int, probes array<int>, heads array<bigint>"


def _assign(shared, s: Settings) -> Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes, labels = shared.value
        for b in batches:
            raw = np.frombuffer(b"".join(b.column("v").to_pylist()), np.float32).reshape(b.num_rows, s.dim)
            models = np.array(b.column("model").to_pylist(), object)
            ids = b.column("chunk_id").to_numpy(zero_copy_only=False)
            for model, ix in indexes.items():
                mine = np.flatnonzero(models == model)
                for lo in range(0, len(mine), 2048):
                    rows = mine[lo : lo + 2048]
                    x = unit(raw[rows].astype(np.float64)).astype(np.float32)
                    own, probes = probe_cells(x, ix, s)
                    row, place = np.nonzero(probes >= 0)
                    cell = probes[row, place]
                    blk = ix.block_of[cell]
                    order = np.lexsort((place, blk, row))
                    row, cell, blk = row[order], cell[order], blk[order]
                    starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (blk[1:] != blk[:-1])]))
                    who, to = row[starts], blk[starts]
                    take = pa.array(rows[who])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(labels[model][to].astype(np.int32)), pa.array([model] * len(to), pa.string()),
                            pa.array(ids, pa.int64()).take(take), _binary(raw[rows[who]]),
                            pa.array(np.where(to == ix.block_of[own[who]], own[who], -1).astype(np.int32)),
                            pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32))), b.column("heads").take(take),
                        ],
                        names=["block", "model", "chunk_id", "v", "own", "probes", "heads"],
                    )

    return run


def _finer(x: np.ndarray, s: Settings, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Centroids of a fat cell, each vector's one, how far that is at most, and how much farther those of its neighbours are, but for `missed`."""
    k = math.ceil(len(x) / s.per_cell)
    picked = x[rng.permutation(len(x))[: 16 * k]]
    c = kmeans(picked, k, 4, rng)
    own = np.concatenate([((c * c).sum(1)[None] - 2 * (x[lo : lo + 4096] @ c.T)).argmin(1) for lo in range(0, len(x), 4096)])
    ask = rng.permutation(len(x))[:500]
    # Only the k-th nearest of a thinned cell, which is farther away than that of the whole: the margin is on the safe side.
    among = rng.permutation(len(x))[:20_000]
    near = among[np.argpartition(-(x[ask] @ x[among].T), s.k, axis=1)[:, : s.k + 1]]
    d = np.sqrt(np.maximum(0, (x[ask] * x[ask]).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x[ask] @ c.T)))
    gap = np.take_along_axis(d, own[near], 1) - d.min(1, keepdims=True)
    return c, own, float(np.quantile(d.min(1), 1 - s.missed)), float(np.quantile(gap, 1 - s.missed))


def search_block(ids: np.ndarray, raw: np.ndarray, own: np.ndarray, probes: tuple[np.ndarray, np.ndarray], ix: Index, s: Settings, scored: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the vectors of one block: (query places, neighbour places, cosines), k at most for a query.

    Rows with own >= 0 are the block's members; every row with probes (cells,
    and where each row's begin) is a query. Codes are scored by asymmetric
    distance tables, the `rerank` best then exactly. `scored` collects the
    number of codes scored.
    """
    rng = np.random.default_rng(13)
    x64 = raw.astype(np.float64)
    x64 /= np.linalg.norm(x64, axis=1, keepdims=True)
    x = x64.astype(np.float32)
    parts, m, width = ix.books.shape
    members = np.flatnonzero(own >= 0)
    members = members[np.argsort(own[members], kind="stable")]
    cells, first = np.unique(own[members], return_index=True)
    last = np.append(first[1:], len(members))
    # Finer cells: of each cell the centroids it is cut by, itself if it is small.
    centres, span, within_, at = [], [], {}, 0
    for c, i, j in zip(cells.tolist(), first.tolist(), last.tolist()):
        if j - i > s.fat and not s.exact:
            fine, of, far, margin = _finer(x[members[i:j]], s, rng)
            order = np.argsort(of, kind="stable")
            members[i:j] = members[i:j][order]
            ends = np.cumsum(np.bincount(of, minlength=len(fine))) + i
            span += list(zip(np.append(i, ends[:-1]).tolist(), ends.tolist()))
        else:
            fine, far, margin = ix.centroids[c : c + 1], 0.0, 0.0
            span.append((i, j))
        within_[c] = (at, fine, far, margin)
        centres.append(fine)
        at += len(fine)
    if not centres:
        return
    sizes = np.array([j - i for i, j in span])
    centre = np.concatenate(centres).astype(np.float32)
    of_row = np.repeat(np.arange(len(span)), sizes)
    rest = (x[members] - centre[of_row]).reshape(-1, parts, width)
    codes = np.empty((len(members), parts), np.int64)
    half = (ix.books**2).sum(2) / 2
    made = centre[of_row]
    for p in range(parts):
        codes[:, p] = (rest[:, p] @ ix.books[p].T - half[p]).argmax(1)
        made[:, p * width : (p + 1) * width] += ix.books[p][codes[:, p]]
    shift = (made * made).sum(1) / 2
    cell, begin = probes
    count = np.diff(begin)
    queries = np.flatnonzero(count > 0)
    queries = queries[np.argsort(cell[begin[queries]], kind="stable")]
    rerank = len(members) if s.exact else s.rerank
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        table = np.matmul(ix.books, x[q].reshape(-1, parts, width).transpose(1, 2, 0))  # parts, codes, queries
        n = count[q]
        who = np.repeat(np.arange(len(q)), n)
        asked = cell[np.repeat(begin[q] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        order = np.argsort(asked, kind="stable")
        who, asked = who[order], asked[order]
        edge = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1], [True]]))
        wanted: list[tuple[int, np.ndarray]] = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            held = within_.get(int(asked[i]))
            if held is None:
                continue
            start, fine, far, margin = held
            cols = who[i:j]
            if len(fine) == 1:
                wanted.append((start, cols))
                continue
            d = np.sqrt(np.maximum(0, 1 + (fine * fine).sum(1)[None] - 2 * (x[q[cols]] @ fine.T)))
            # All within the margin, and in a query's own cell as many as hold twice the vectors that are reranked.
            by = np.argsort(d, axis=1)
            filled = np.cumsum(sizes[start : start + len(fine)][by], axis=1) >= 2 * s.rerank
            last_ = np.where(filled.any(1), filled.argmax(1), len(fine) - 1)
            reach = np.take_along_axis(d, np.take_along_axis(by, last_[:, None], 1), 1)
            home = (own[q[cols]] == asked[i])[:, None]
            # A query from another cell is no farther from its own finer centroid than the cell's vectors are from theirs.
            near = d <= np.where(home, np.maximum(d.min(1, keepdims=True) + margin, reach), np.minimum(d.min(1, keepdims=True), far) + margin)
            wanted += [(start + f, cols[near[:, f]]) for f in np.flatnonzero(near.any(0)).tolist()]
        wanted = [(f, cols) for f, cols in wanted if span[f][1] > span[f][0]]
        if not wanted:
            continue
        rows = np.concatenate([np.arange(*span[f]) for f, _ in wanted])
        score = np.full((len(rows), len(q)), -np.inf, np.float32)
        at = 0
        for f, cols in wanted:
            i, j = span[f]
            some = len(cols) * 2 < len(q)
            t, dots = (table[:, :, cols], x[q[cols]] @ centre[f]) if some else (table, x[q] @ centre[f])
            acc = np.take(t[0], codes[i:j, 0], axis=0)
            for p in range(1, parts):
                acc += np.take(t[p], codes[i:j, p], axis=0)
            acc += dots[None]
            acc -= shift[i:j, None]
            score[at : at + j - i, cols] = acc if some else acc[:, cols]
            at += j - i
            if scored is not None:
                scored.append((j - i) * len(cols))
        best = np.argpartition(-score, min(rerank, len(rows)) - 1, axis=0)[:rerank].T if len(rows) > rerank else np.tile(np.arange(len(rows)), (len(q), 1))
        good = np.isfinite(np.take_along_axis(score.T, best, 1))
        step = max(1, (1 << 19) // max(best.shape[1], 1))
        for a in range(0, len(q), step):
            cand, mine = members[rows[best[a : a + step]]], q[a : a + step]
            cos = np.einsum("qrd,qd->qr", x64[cand], x64[mine])
            cos[~good[a : a + step] | (ids[cand] == ids[mine][:, None])] = -np.inf
            top = np.lexsort((ids[cand], -cos), axis=1)[:, : s.k]
            cos, who_ = np.take_along_axis(cos, top, 1), np.take_along_axis(cand, top, 1)
            ok = np.isfinite(cos)
            yield np.repeat(mine, ok.sum(1)), who_[ok], cos[ok]


_FOUND = "model string, chunk_id bigint, neighbour bigint, cosine double"


def _search(shared, s: Settings) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        model = t.column("model")[0].as_py()
        ids = t.column("chunk_id").to_numpy()
        v = t.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        raw = np.frombuffer(b"".join(v.to_pylist()), np.float32).reshape(len(ids), -1)
        # Repeated rows of a vector have come to the same blocks and count once.
        _, once = np.unique(np.rec.fromarrays([ids, np.array([hash(r.tobytes()) for r in raw], np.int64)]), return_index=True)
        ids, own = ids[once], t.column("own").to_numpy()[once]
        lists, heads = t.column("probes").combine_chunks().take(pa.array(once)), t.column("heads").to_pylist()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        probes = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        parts = list(search_block(ids, raw[once], own, probes, shared.value[0][model], s))
        q, n, c = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        # A vector that stands for its copies is all of its heads, and finds them itself in its own block.
        groups = [np.array(heads[i] or [int(x)], np.int64) for i, x in zip(once, ids)]
        size = np.array([len(g) for g in groups], np.int64)
        home = np.flatnonzero((own >= 0) & (size > 1))
        q, n, c = np.concatenate([q, home]), np.concatenate([n, home]), np.concatenate([c, np.ones(len(home))])
        found = np.concatenate([np.zeros(0, np.int64), *(groups[i] for i in n)])
        q, c = np.repeat(ids[q], size[n]), np.repeat(c, size[n])
        return pa.table({"model": pa.array([model] * len(q), pa.string()), "chunk_id": pa.array(q, pa.int64()), "neighbour": pa.array(found, pa.int64()), "cosine": pa.array(c, pa.float64())})

    return run


_GROUP = ["model", "h1", "h2"]


def _copies(packed: DataFrame) -> DataFrame:
    """(model, h1, h2, chunk_id, rep): all rows of vectors that several chunks have, rep their least id."""
    groups = packed.groupBy(*_GROUP).agg(F.min("chunk_id").alias("rep"), F.max("chunk_id").alias("last")).where("rep < last").drop("last")
    return materialise(packed.select(*_GROUP, "chunk_id").join(groups, _GROUP).distinct(), "copies")


def _kept(packed: DataFrame, copies: DataFrame, s: Settings) -> DataFrame:
    """(model, chunk_id, v, heads): one row of each distinct vector, with the k + 1 least ids of its copies if there are any."""
    least = Window.partitionBy(*_GROUP).orderBy("chunk_id")
    heads = copies.withColumn("r", F.row_number().over(least)).where(F.col("r") <= s.k + 1).groupBy(*_GROUP, F.col("rep").alias("chunk_id")).agg(F.sort_array(F.collect_list("chunk_id")).alias("heads"))
    marks = copies.select(*_GROUP, "chunk_id", F.lit(True).alias("copied")).join(heads, [*_GROUP, "chunk_id"], "left")
    return packed.join(marks, [*_GROUP, "chunk_id"], "left").where("copied is null or heads is not null").select("model", "chunk_id", "v", "heads")


def nearest_neighbours(vectors: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(model, chunk_id, neighbour, cosine, rank from 1): the k nearest of every usable vector.

    vectors has (chunk_id BIGINT, embedding ARRAY<FLOAT>, model). A vector is
    usable if it has settings.dim finite values, not all zero; null ids and
    models are left out; each model is searched by itself. Repeated rows count
    once and a chunk is never its own neighbour; ties go to the smaller id. An
    empty table gives an empty result. Raises beyond settings.models models.
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    rows = vectors.select("chunk_id", "embedding", "model").where(f"chunk_id is not null and model is not null and size(embedding) = {s.dim}")
    held = rows.groupBy("model").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("embedding"), 0.02).alias("d")).limit(s.models + 1).collect()
    counts, totals = {r.model: r.n for r in held}, {r.model: r.d for r in held}
    if len(counts) > s.models:
        raise ValueError(f"more than {s.models} models")
    # About `sample` rows of each model, fewer if there are many models, chosen by a hash of the id.
    most = min(s.sample, max(1_000, s.samples // max(len(counts), 1)))
    rate = F.coalesce(*[F.when(F.col("model") == m, F.lit(min(1.0, most / n))) for m, n in sorted(counts.items())], F.lit(0.0))
    chosen = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < rate * (1 << 20))
    sample = chosen.mapInArrow(_sampled(s.dim), "model string, chunk_id bigint, v binary").toArrow() if counts else None
    indexes: dict[str, Index] = {}
    blocks: dict[str, int] = {}
    below: dict[str, np.ndarray] = {}
    for m in sorted(counts):
        mine = sample.filter(pc.equal(sample.column("model"), m))
        if not mine.num_rows:
            if counts[m] > most:
                raise RuntimeError(f"no usable vector in the sample of {m}")
            continue
        raw = np.frombuffer(b"".join(mine.column("v").to_pylist()), np.float32).reshape(mine.num_rows, s.dim)
        keep = np.unique(raw, axis=0)
        if not s.exact and totals[m] > s.dense * most:
            below[m] = keep
        else:
            indexes[m] = fit(keep, counts[m], s)
    if below:
        indexes |= _fitted_below(rows, below, totals, s)
    for m in indexes:
        blocks[m] = int(indexes[m].block_of.max()) + 1
    if not indexes:
        return spark.createDataFrame([], _FOUND + ", rank int")
    packed = rows.mapInArrow(_sampled(s.dim), "model string, chunk_id bigint, v binary")
    packed = packed.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    copies = _copies(packed)
    shared = spark.sparkContext.broadcast((indexes, _labels(rows, blocks)))
    sent = _kept(packed, copies, s).mapInArrow(_assign(shared, s), _SENT)
    found = sent.groupBy("block").applyInArrow(_search(shared, s), _FOUND)
    # One more than k, as a copy leaves itself out.
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "neighbour"))), 1, s.k + 1)
    lists = found.groupBy("model", F.col("chunk_id").alias("rep")).agg(best.alias("best"))
    each = lists.join(copies.select("model", "rep", "chunk_id"), ["model", "rep"], "left").withColumn("chunk_id", F.coalesce("chunk_id", "rep"))
    mine = F.slice(F.filter("best", lambda x: x["neighbour"] != F.col("chunk_id")), 1, s.k)
    out = each.select("model", "chunk_id", F.posexplode(mine).alias("pos", "n"))
    return out.select("model", "chunk_id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.d")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def _labels(rows: DataFrame, blocks: dict[str, int], few: int = 10_000) -> dict[str, np.ndarray]:
    """A number for each block of each model, so that the hash partitioning of a shuffle gives every task as many blocks.

    Many blocks need no such care: beyond `few` they are numbered in order.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sum(blocks.values())
    turns = list(range(total))
    if total <= few:
        tried = spark.range(4 * max(total, parts) + 16).select(F.col("id").cast("int").alias("n"))
        held: dict[int, list[int]] = {}
        for r in tried.select("n", F.pmod(F.hash("n"), F.lit(parts)).alias("p")).collect():
            held.setdefault(r.p, []).append(r.n)
        turns = [held[p][i] for i in range(max(map(len, held.values()))) for p in sorted(held) if i < len(held[p])]
    out, at = {}, 0
    for m in sorted(blocks):
        out[m] = np.array(turns[at : at + blocks[m]], np.int64)
        at += blocks[m]
    return out


def neighbour_pairs(vectors: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: one is among the other's k nearest."""
    n = nearest_neighbours(vectors, settings)
    return n.select(F.least("chunk_id", "neighbour").alias("chunk_a"), F.greatest("chunk_id", "neighbour").alias("chunk_b")).distinct()
