"""Keyword, vector and hybrid search, for one or many questions at once."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from skerry.functions.fixed import BM25_B, BM25_EPSILON, BM25_K1, RRF_K, TOP_K
from skerry.functions.text import tokens
from skerry.operators.order import few
from skerry.plans.shared import materialise


#: Scores that agree to so many digits are ties.
TIE_DIGITS = 12
#: Texts that a task scores at once against a batch of questions, texts in a group with a bound of its own, frequent terms that form the groups.
BLOCK, GROUP, LEADING = 16_384, 512, 64
#: Questions that are summed up at once, and the share of a group's texts from which a term's column is dense.
TOGETHER, DENSE = 512, 0.08
#: Up to so many different terms of a batch of questions are pushed into the scan of the postings.
PUSHED_TERMS = 1_000


def metadata_filter(conditions: dict) -> Column:
    """A predicate from {column: value or {"$eq" | "$in" | "$gte" | "$lte": value}}, all of which must hold; null never matches."""
    ops = {"$eq": lambda c, v: c == v, "$in": lambda c, v: c.isin(v), "$gte": lambda c, v: c >= v, "$lte": lambda c, v: c <= v}
    out = F.lit(True)
    for name, want in conditions.items():
        for op, value in (want if isinstance(want, dict) else {"$eq": want}).items():
            if op not in ops:
                raise ValueError(f"unknown operator {op}")
            out = out & F.coalesce(F.col(name).isNull() if value is None else ops[op](F.col(name), value), F.lit(False))
    return out


def postings(chunks: DataFrame) -> DataFrame:
    """(term, id, tf)."""
    return chunks.select("id", F.explode(tokens("content")).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """(id, dl): tokens per chunk."""
    return chunks.select("id", F.size(tokens("content")).alias("dl"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """(term, df, idf) over the whole corpus; a negative idf becomes epsilon times the mean idf."""
    df = chunks.select("id", F.explode(F.array_distinct(tokens("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return _with_idf(df, chunks.agg(F.count("*").alias("n_docs")))


@dataclass
class Index:
    """Keyword index tables: postings (term, id, dl, tf) in files sorted by term, docs (id, dl), terms (term, df, idf)."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame


def _written(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = chunks.select("id", tokens("content").alias("ts"))
    docs = materialise(base.select("id", F.size("ts").alias("dl")), "docs")
    hits = base.select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))
    return materialise(hits.repartitionByRange("term").sortWithinPartitions("term"), "postings"), docs


def _indexed(postings_: DataFrame, docs: DataFrame) -> Index:
    df = postings_.groupBy("term").agg(F.count("*").alias("df"))
    return Index(postings_, docs, materialise(_with_idf(df, docs.agg(F.count("*").alias("n_docs"))), "terms"))


def build_index(chunks: DataFrame) -> Index:
    """One pass over the texts; postings are aggregated and written once, and everything else is made from them.

    Postings are range-partitioned and sorted by term, so that the files and
    row groups which hold none of a question's terms are skipped.
    """
    return _indexed(*_written(chunks))


def append(index: Index, chunks: DataFrame) -> Index:
    """The index with further chunks: only they are read, their postings are files beside the others; the terms are counted again."""
    found, docs = _written(chunks.join(index.docs.select("id"), "id", "left_anti"))
    return _indexed(index.postings.unionByName(found), index.docs.unionByName(docs))


def delete_by(index: Index, chunks: DataFrame, which: Column) -> tuple[Index, int]:
    """The index without the chunks that a condition on the chunk table (document, source, user, id) holds for, and how many they were."""
    gone = chunks.where(F.coalesce(which, F.lit(False))).select("id").distinct().join(index.docs.select("id"), "id", "left_semi")
    gone = materialise(gone, "gone")
    return _indexed(index.postings.join(gone, "id", "left_anti"), index.docs.join(gone, "id", "left_anti")), gone.count()


def clear(index: Index) -> Index:
    """An index of the same shape without any chunk."""
    return _indexed(index.postings.limit(0), index.docs.limit(0))


def compact(index: Index) -> Index:
    """The same index written anew in one set of files, without what was deleted."""
    return _indexed(materialise(index.postings.repartitionByRange("term").sortWithinPartitions("term"), "postings"), materialise(index.docs, "docs"))


@dataclass
class Collection:
    """The two indexes of one set of chunks: keywords, and vectors (id, embedding) with the same ids."""

    keyword: Index
    vectors: DataFrame


def add_chunks(collection: Collection | None, chunks: DataFrame, vectors: DataFrame) -> tuple[Collection, int]:
    """Chunks (id, content) and their vectors (id, embedding) added to both indexes, vectors first; how many were added.

    Raises if a chunk has no vector or a vector no chunk. Nothing to add
    changes nothing.
    """
    v = materialise(vectors.select("id", "embedding"), "vectors")
    odd = chunks.select("id").distinct().join(v.select("id").distinct().withColumn("_v", F.lit(1)), "id", "full_outer")
    n, alone = chunks.select("id").distinct().count(), odd.where("_v is null").count() + v.join(chunks.select("id"), "id", "left_anti").count()
    if alone:
        raise ValueError(f"{alone} chunks and vectors do not belong together")
    if collection is None:
        return Collection(build_index(chunks), v), n
    new = v.join(collection.vectors.select("id"), "id", "left_anti")
    return Collection(append(collection.keyword, chunks), collection.vectors.unionByName(new)), n


def index_chunks(collection: Collection | None, chunks: DataFrame, embed: Callable[[Column], Column]) -> tuple[Collection, int]:
    """Chunks embedded by an expression over their content and added to both indexes; how many they were."""
    return add_chunks(collection, chunks, chunks.select("id", embed(F.col("content")).alias("embedding")))


def remove_chunks(collection: Collection, chunks: DataFrame, which: Column) -> tuple[Collection, int]:
    """Both indexes without the chunks that a condition on the chunk table holds for, and how many they were."""
    keyword, n = delete_by(collection.keyword, chunks, which)
    return Collection(keyword, collection.vectors.join(keyword.docs.select("id"), "id", "left_semi")), n


def _with_idf(df: DataFrame, n: DataFrame) -> DataFrame:
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(chunks: DataFrame, questions: DataFrame, k: int = TOP_K, where: Column | None = None, index: Index | None = None) -> DataFrame:
    """(qid, id, score, rank from 0): the k best chunks of each question (qid, query).

    Statistics are over all chunks, the filter comes afterwards. A repeated
    query word counts repeatedly, chunks without any query word score 0 and
    may fill up the list, ties go to the later id. Without an index one is
    built first; questions are a batch of at most 10,000, else this raises.
    """
    ix = index or build_index(chunks)
    asked = questions.select("qid", F.explode(tokens("query")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    sizes = ix.docs.agg(F.avg("dl").alias("avgdl"))
    few(questions)
    # Few different terms become a filter on the scan of the postings; a limit bounds what the driver sees.
    some = [r.term for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    hits = ix.postings.where(F.col("term").isin(some)) if len(some) <= PUSHED_TERMS else ix.postings
    allowed = ix.docs.select("id")
    if where is not None:
        allowed = chunks.where(where).select("id").distinct()
        hits = hits.join(allowed, "id", "left_semi")
    weights = asked.join(ix.terms.select("term", "idf"), "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(weights, "term").crossJoin(F.broadcast(sizes)).groupBy("qid", "id").agg(F.round(F.sum(part), TIE_DIGITS).alias("score"))
    # Chunks that score 0 are only needed where fewer than k are hit, and then from the last 2k by id.
    found = scored.groupBy("qid").agg(F.count("*").alias("hits"))
    last = allowed.orderBy(F.desc("id")).limit(2 * k)
    lacking = questions.select("qid").join(found, "qid", "left").where("coalesce(hits, 0) < " + str(k)).select("qid")
    fill = lacking.crossJoin(F.broadcast(last)).join(scored.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", "id", F.lit(0.0).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("id"))
    both = scored.select("qid", "id", "score").unionByName(fill)
    return _shown(both.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k))


@dataclass
class Texts:
    """What many questions are scored against: texts (id, ts: their words) in files, terms (term, df, idf), how many and how long they are; ids that several rows have."""

    texts: DataFrame
    terms: DataFrame
    rows: int
    avgdl: float
    repeated: bool


def texts_of(chunks: DataFrame, where: Column | None = None) -> Texts:
    """The words of chunks written once, with their statistics; no postings are made.

    Only ids with a chunk that meets `where` are searched; the statistics are
    of all. It is asked where the words are written, so that these are not
    shuffled to be joined, unless several chunks have one id.
    """
    allowed = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    written = materialise(chunks.select("id", tokens("content").alias("ts"), allowed.alias("allowed")), "texts")
    texts = written.select("id", "ts")
    n = texts.agg(F.count("*").alias("n_docs"), F.avg(F.size("ts")).alias("avgdl"))
    df = texts.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    got = n.first()
    repeated = bool(texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
    out = Texts(texts, materialise(_with_idf(df, n.select("n_docs")), "terms"), got.n_docs, got.avgdl or 0.0, repeated)
    if where is None:
        return out
    searched = written.where("allowed")
    return among(out, searched) if repeated else replace(out, texts=searched.select("id", "ts"))


def among(texts: Texts, ids: DataFrame) -> Texts:
    """Only the texts of some ids, with the statistics of all."""
    return replace(texts, texts=materialise(texts.texts.join(ids.select("id").distinct(), "id", "left_semi"), "among"))


@dataclass
class _Asked:
    """A batch of questions: qids; terms, frequent ones first; and sorted by question the places of its terms and their weights (times asked x idf)."""

    qids: pa.Array
    terms: pa.Array
    question: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    avgdl: float


def _asked(texts: Texts, questions: DataFrame) -> _Asked:
    rows = few(questions.select("qid", tokens("query").alias("ts"))).toArrow().combine_chunks()
    known = texts.terms.join(questions.select(F.explode(tokens("query")).alias("term")).distinct(), "term").orderBy(F.desc("df"), "term").toArrow()
    terms = pa.array(known.column("term").to_pylist(), pa.string())
    qids = pc.unique(rows.column("qid"))
    ts = pa.array([t for r in rows.column("ts").to_pylist() for t in r], pa.string())
    place = pc.index_in(rows.column("qid"), qids).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(place, pc.list_value_length(rows.column("ts")).to_numpy(zero_copy_only=False))
    at = pc.fill_null(pc.index_in(ts, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    key, times = np.unique(owner[at >= 0] * max(1, len(terms)) + at[at >= 0], return_counts=True)
    question, term = np.divmod(key, max(1, len(terms)))
    return _Asked(qids, terms, question, term, times * known.column("idf").to_numpy()[term], texts.avgdl)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers lo, lo + 1, ... (n of them) of each range."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)


def _best(question: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each question's k best, later ids first of ties."""
    order = np.lexsort((ids, score, -question))[::-1]
    q = question[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def _thick_first(seen: np.ndarray) -> np.ndarray:
    """An order of texts in which those with the same frequent terms are near each other; `seen` says who has which, one column a term."""
    return np.lexsort(np.packbits(seen, axis=1).T[::-1])


def _kth(total: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where there are fewer."""
    return np.partition(total, total.shape[1] - k, axis=1)[:, total.shape[1] - k] if total.shape[1] >= k else np.full(len(total), -np.inf)


def _slack(least: np.ndarray) -> np.ndarray:
    """A score to reach, less by more than the noise of a sum."""
    return np.where(np.isneginf(least), least, least - 1e-10 * (1 + np.abs(np.where(np.isneginf(least), 0, least))))


def _scores(a: _Asked, ids: np.ndarray, dl: np.ndarray, doc: np.ndarray, at: np.ndarray, k: int, floor: np.ndarray, counts: list[int] | None = None):
    """(question, score, id) of what may be among the k best of a block of texts: their words are `at` of the terms, `floor` is the score to reach.

    Texts with the same frequent terms are put into groups. What a question
    can score in a group is bounded by the largest part of each of its terms
    there; it is asked in the most promising group first, then in those whose
    bound reaches what it has found. Terms that many texts of the group have
    are a matrix product, the others are summed up from their postings. These
    sums only choose: what they choose is summed once more in the order of
    the question's terms, so that equal texts tie. `counts` collects the
    pairs of a question and a group, and of these the ones summed up.
    """
    count, asked = max(1, len(a.terms)), len(a.qids)
    first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    rows = np.append(first[1:], len(ids)) - first
    seen = np.zeros((len(first), min(count, LEADING)), bool)
    often = at < LEADING
    seen[np.repeat(np.arange(len(first)), rows)[doc[often]], at[often]] = True
    # The rows of an id stay together.
    order = _thick_first(seen)
    names, moved = ids[first[order]], _ranges(first[order], rows[order])
    rows = rows[order]
    begins = np.concatenate([[0], np.cumsum(rows)])
    to = np.empty(len(dl), np.int64)
    to[moved] = np.arange(len(dl))
    dl, doc = dl[moved], to[doc]
    groups = -(-len(names) // GROUP)
    low = begins[np.minimum(np.arange(groups + 1) * GROUP, len(names))]
    wide = int(np.diff(low).max())
    group = np.repeat(np.arange(groups), np.diff(low))
    key, tf = np.unique((group[doc] * count + at) * wide + doc - low[group[doc]], return_counts=True)
    cell, d = np.divmod(key, wide)
    length = dl[low[cell // count] + d]
    part = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / a.avgdl))
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    cells, size = cell[start], np.diff(np.append(start, len(cell)))
    most = np.zeros((count, groups))
    if len(start):
        most[cells % count, cells // count] = np.maximum.reduceat(part, start)
    begin = np.searchsorted(a.question, np.arange(asked + 1))
    bound = np.zeros((asked, groups))
    for lo in range(0, asked, TOGETHER):
        q = lo + np.flatnonzero(np.diff(begin[lo : lo + TOGETHER + 1]))
        if len(q):
            mine = slice(begin[lo], begin[min(lo + TOGETHER, asked)])
            bound[q] = np.add.reduceat(np.maximum(a.weight[mine], 0)[:, None] * most[a.term[mine]], begin[q] - begin[lo])
    bound *= np.maximum.reduceat(rows, np.arange(groups) * GROUP)
    least, found = floor.copy(), []

    def ask(g: int, questions: np.ndarray, first_time: bool) -> None:
        """Adds what questions may find in a group to `found`, and the first time raises what they have to reach."""
        mine = slice(*np.searchsorted(cells, [g * count, (g + 1) * count]))
        n, inside = low[g + 1] - low[g], slice(g * GROUP, min((g + 1) * GROUP, len(names)))
        local = np.full(count, -1)
        local[cells[mine] % count] = np.arange(mine.start, mine.stop)
        thick = np.flatnonzero(size[mine] > DENSE * n) + mine.start
        column = np.full(mine.stop - mine.start + 1, -1)
        column[thick - mine.start] = np.arange(len(thick))
        columns = np.zeros((len(thick), n))
        p = _ranges(start[thick], size[thick])
        columns[np.repeat(np.arange(len(thick)), size[thick]), d[p]] = part[p]
        for lo in range(0, len(questions), TOGETHER):
            some = questions[lo : lo + TOGETHER]
            terms = begin[some + 1] - begin[some]
            e = _ranges(begin[some], terms)
            q, c, w = np.repeat(np.arange(len(some)), terms), local[a.term[e]], a.weight[e]
            q, c, w = q[c >= 0], c[c >= 0], w[c >= 0]
            dense = column[c - mine.start]
            weights = np.zeros((len(some), len(thick)))
            weights[q[dense >= 0], dense[dense >= 0]] = w[dense >= 0]
            q, c, w = q[dense < 0], c[dense < 0], w[dense < 0]
            p = _ranges(start[c], size[c])
            total = np.bincount(np.repeat(q * n, size[c]) + d[p], np.repeat(w, size[c]) * part[p], len(some) * n).reshape(len(some), n) + weights @ columns
            if n > inside.stop - inside.start:
                total = np.add.reduceat(total, begins[inside] - low[g], axis=1)
            if first_time:
                least[some] = np.maximum(least[some], _kth(total, k))
            reach = _slack(least[some])
            # Where texts without any of its terms are good enough for a question, only the last k by id are.
            for x in np.flatnonzero(reach <= 0):
                bare = np.flatnonzero(total[x] == 0)
                total[x, bare[np.argsort(names[inside][bare])[:-k]]] = -np.inf
            chosen = np.flatnonzero((total >= reach[:, None]) & (total > -np.inf))
            i, j = np.divmod(chosen, total.shape[1])
            found.append((some[i], j + inside.start, total.ravel()[chosen]))

    best, summed = bound.argmax(1), 0
    for again in (False, True):
        for g in range(groups):
            q = np.flatnonzero(((best == g) ^ again) & (bound[:, g] >= _slack(least)))
            if len(q):
                ask(g, q, not again)
                summed += len(q)
    if counts is not None:
        counts[:] = [a + b for a, b in zip(counts or [0, 0], (asked * groups, summed))]
    i, j, total = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ordered = np.lexsort((-total, i))
    last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i[ordered], i[ordered]) == k - 1)
    least[i[ordered[last]]] = total[ordered[last]]
    ok = total >= _slack(least)[i]
    i, j = i[ok], j[ok]
    # All rows of an id that was chosen, and for each all terms of the question.
    hit, text = np.repeat(np.arange(len(i)), rows[j]), _ranges(begins[j], rows[j])
    terms = (begin[1:] - begin[:-1])[i[hit]]
    exact = np.zeros(len(i), np.longdouble)
    for some in np.array_split(np.arange(len(hit)), max(1, int(terms.sum()) >> 20)):
        e = _ranges(begin[i[hit[some]]], terms[some])
        g = np.repeat(group[text[some]], terms[some])
        want = (g * count + a.term[e]) * wide + np.repeat(text[some], terms[some]) - low[g]
        place = np.minimum(np.searchsorted(key, want), max(0, len(key) - 1))
        there = np.flatnonzero(key[place] == want) if len(key) else np.zeros(0, np.int64)
        np.add.at(exact, np.repeat(hit[some], terms[some])[there], (a.weight[e[there]] * part[place[there]]).astype(np.longdouble))
    yield i, np.round(exact, TIE_DIGITS).astype(np.float64), names[j]


def bm25_many(texts: Texts, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """As bm25(), for large batches: each task scores its texts against all questions and gives its k best for each, so pairs are not shuffled."""
    asked = _asked(texts, questions)
    spark = texts.texts.sparkSession
    shared = spark.sparkContext.broadcast(asked)

    def run(batches):
        a = shared.value
        floor, held = np.full(len(a.qids), -np.inf), []

        def blocks():
            kept, rows = [], 0
            for b in batches:
                b = b.filter(pc.is_valid(b.column("id")))
                if b.num_rows:
                    kept, rows = [*kept, b], rows + b.num_rows
                if rows > BLOCK:
                    t = pa.Table.from_batches(kept).combine_chunks()
                    # The rows of one id stay together.
                    last = t.column("id")[-1].as_py()
                    cut = rows - 1
                    while cut and t.column("id")[cut - 1].as_py() == last:
                        cut -= 1
                    if cut:
                        yield t.slice(0, cut)
                        kept, rows = t.slice(cut).to_batches(), rows - cut
            if rows:
                yield pa.Table.from_batches(kept)

        for t in blocks():
            t = t.combine_chunks()
            ids = t.column("id").to_numpy()
            ids = ids.astype(str) if ids.dtype == object else ids
            words = t.column("ts").combine_chunks()
            dl = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            at = pc.fill_null(pc.index_in(words.flatten(), a.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(dl)), dl)
            found = list(_scores(a, ids, dl, doc[at >= 0], at[at >= 0], k, floor))
            question, score, name = (np.concatenate(x) for x in zip(*held, *found))
            best = _best(question, score, name, k)
            held = [(question[best], score[best], name[best])]
            full = np.flatnonzero(np.bincount(question[best], minlength=len(floor)) >= k)
            floor[full] = score[best][np.searchsorted(question[best], full, side="right") - 1]
        for question, score, name in held:
            for lo in range(0, len(question), 100_000):
                some = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([a.qids.take(pa.array(question[some])), pa.array(name[some].tolist(), kind), pa.array(score[some])], names=["qid", "id", "score"])

    kind = to_arrow_type(texts.texts.schema["id"].dataType)
    schema = StructType([StructField("qid", questions.schema["qid"].dataType), StructField("id", texts.texts.schema["id"].dataType), StructField("score", DoubleType())])
    # A task gives k rows a question: no more tasks than keep the cores busy.
    rows = texts.texts.repartition("id").sortWithinPartitions("id") if texts.repeated else texts.texts.coalesce(4 * spark.sparkContext.defaultParallelism)
    scored = rows.mapInArrow(run, schema) if len(asked.qids) else spark.createDataFrame([], schema)
    scored = scored.withColumn("score", F.round("score", TIE_DIGITS))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("id"))
    return _shown(scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k))


def _shown(hits: DataFrame) -> DataFrame:
    """Ranks are taken of scores that are equal only up to the noise of sums; what is shown has six digits."""
    return hits.withColumn("score", F.round("score", 6))


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the right length, finite and not all zero, as doubles."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    good = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.coalesce(good, F.lit(False))).withColumn("embedding", e)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_search(vectors: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """(qid, id, score, rank from 0) by cosine; questions (qid, q) is a batch of counted size, compared with every vector in one pass."""
    pairs = vectors.select("id", "embedding").crossJoin(few(questions.select("qid", "q")))
    scored = pairs.select("qid", "id", F.round(cosine(F.col("embedding"), F.col("q")), TIE_DIGITS).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return _shown(scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k))


def vector_search_many(vectors: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """As vector_search(), for large batches: each Arrow batch of usable() vectors gives its k best for every question, so pairs are not shuffled."""
    asked = few(questions.select("qid", "q")).toArrow()
    qids = asked.column("qid")
    q = np.array(asked.column("q").to_pylist(), np.float64)
    if not len(q):
        return vector_search(vectors, questions, k)
    shared = vectors.sparkSession.sparkContext.broadcast((qids.to_numpy(), q / np.linalg.norm(q, axis=1, keepdims=True)))

    def run(batches):
        names, unit = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id").to_numpy()
            x = b.column("embedding").flatten().to_numpy().reshape(len(ids), -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            for lo in range(0, len(unit), 256):
                score = np.round(unit[lo : lo + 256] @ x.T, TIE_DIGITS)
                least = min(k, len(ids))
                i, j = np.nonzero(score >= -np.partition(-score, least - 1, axis=1)[:, least - 1 : least])
                order = np.lexsort((ids[j], -score[i, j], i))
                i, j = i[order], j[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([pa.array(names[lo + i]), pa.array(ids[j]), pa.array(score[i, j])], names=["qid", "id", "score"])

    schema = StructType([StructField("qid", questions.schema["qid"].dataType), StructField("id", vectors.schema["id"].dataType), StructField("score", DoubleType())])
    scored = vectors.select("id", "embedding").mapInArrow(run, schema).withColumn("score", F.round("score", TIE_DIGITS))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return _shown(scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k))


def in_blocks(questions: DataFrame, searched: Callable[[DataFrame], DataFrame], most: int = 5_000) -> DataFrame:
    """searched() of all questions, however many, in blocks of about `most` by a hash of qid; questions are counted first."""
    rows = materialise(questions, "questions")
    blocks = max(1, math.ceil(rows.count() / most))
    parts = [searched(rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def fuse(keyword: DataFrame | None, vector: DataFrame | None, k: int = TOP_K, keyword_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """Weighted reciprocal-rank fusion: (qid, id, score, bm25_score, vector_score, rank from 0).

    Ties: vector rank first, then keyword rank. A leg may be missing; a
    weight of 0 is honoured.
    """
    legs = []
    for leg, name, weight in ((vector, "vector", vector_weight), (keyword, "bm25", keyword_weight)):
        if leg is not None:
            legs.append(leg.select("qid", "id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"), (F.lit(float(weight)) / (RRF_K + F.col("rank") + 1)).alias(f"{name}_part")))
    if not legs:
        raise ValueError("no leg to fuse")
    both = reduce(lambda a, b: a.join(b, ["qid", "id"], "full_outer"), legs)
    for name in ("vector", "bm25"):
        if f"{name}_rank" not in both.columns:
            both = both.withColumns({f"{name}_score": F.lit(None).cast("double"), f"{name}_rank": F.lit(None).cast("int"), f"{name}_part": F.lit(0.0)})
    score = F.round(F.coalesce("vector_part", F.lit(0.0)) + F.coalesce("bm25_part", F.lit(0.0)), 6)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"))
    out = both.withColumn("score", score).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return out.select("qid", "id", "score", "bm25_score", "vector_score", "rank")


def overlap_rerank(hits: DataFrame, texts: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, original_score, rank): hits reordered by the share of query words they hold, the k best.

    The pluggable scorer of this build is lexical; another can be put in its
    place as a column over (query, content).
    """
    j = hits.select("qid", "id", F.col("score").alias("original_score"), F.col("rank").alias("old")).join(texts.select("id", "content"), "id").join(questions.select("qid", "query"), "qid")
    q = F.array_distinct(tokens("query"))
    share = F.size(F.array_intersect(q, tokens("content"))) / F.greatest(F.size(q), F.lit(1))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "old")
    return j.withColumn("score", F.round(share, 6)).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("qid", "id", "score", "original_score", "rank")


def no_rerank(hits: DataFrame, texts: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, original_score, rank): the first k hits as they are."""
    return hits.where(F.col("rank") < k).select("qid", "id", "score", F.col("score").alias("original_score"), "rank")


RERANKERS = {"overlap": overlap_rerank, "none": no_rerank}


def reranker(name: str | None) -> Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame]:
    """The reranker of a name; none for null."""
    if (name or "none") not in RERANKERS:
        raise ValueError(f"unknown reranker {name}")
    return RERANKERS[name or "none"]


def reorder(hits: DataFrame, reranked: DataFrame) -> DataFrame:
    """All hits with their fused scores, those reranked first in their new order, the rest after in the old one."""
    j = hits.join(reranked.select("qid", "id", F.col("rank").alias("place")), ["qid", "id"], "left")
    order = Window.partitionBy("qid").orderBy(F.coalesce("place", F.lit(999)), "rank")
    return j.select("qid", "id", "score", (F.row_number().over(order) - 1).alias("rank"))


def contexts(hits: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """(qid, context): the first k contents, check boxes turned into list marks, a blank line between."""
    j = hits.where(F.col("rank") < k).join(texts.select("id", "content"), "id")
    clean = F.regexp_replace("content", r"- \[[ xX]\]", "-")
    return j.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", clean.alias("c")))), lambda s: s["c"]), "\n\n").alias("context"))
