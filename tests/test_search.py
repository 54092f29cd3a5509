import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.operators import search, store


def corpus(spark):
    return spark.createDataFrame([(1, "alice", "budget alpha report"), (2, "bob", "completely unrelated text"), (3, "alice", "alpha alpha beta"), (4, "bob", None), (5, "bob", "beta the the the")], "id bigint, user_id string, content string")


def brute(docs, query, k):
    toks = {i: (t or "").lower().split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    s = {i: round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()), 6) for i, t in toks.items()}
    return sorted(s.items(), key=lambda x: (-x[1], -x[0]))[:k]


@pytest.mark.parametrize("query", ["alpha", "alpha beta alpha", "the", "zzz", ""])
def test_bm25_equals_brute_force(spark, query):
    c = corpus(spark)
    q = spark.createDataFrame([(1, query)], "qid int, query string")
    got = [(r.id, pytest.approx(r.score)) for r in search.bm25(c, q, 4).orderBy("rank").collect()]
    assert got == brute({r.id: r.content for r in c.collect()}, query, 4)


def test_tenant_and_delete(spark):
    c = corpus(spark)
    q = spark.createDataFrame([(1, "alpha")], "qid int, query string")
    hits = search.bm25(c, q, 10, search.metadata_filter({"user_id": "alice"}))
    assert {r.id for r in hits.collect()} == {1, 3}
    left = store.delete(c, spark.createDataFrame([("alice",), ("alice",), (None,)], "user_id string"), "user_id")
    assert {r.id for r in left.collect()} == {2, 4, 5}


def test_filter_operators(spark):
    c = corpus(spark)
    assert c.where(search.metadata_filter({"id": {"$gte": 2, "$lte": 3}, "user_id": {"$in": ["bob"]}})).count() == 1
    with pytest.raises(ValueError):
        search.metadata_filter({"id": {"$near": 1}})


def test_vector_and_fusion(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0])], "id bigint, embedding array<float>")
    u = search.usable(v, 2)
    assert {r.id for r in u.collect()} == {1, 2, 3}
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid int, q array<double>")
    top = search.vector_search(u, q, 3)
    assert [r.id for r in top.orderBy("rank").collect()] == [1, 3, 2]
    kw = spark.createDataFrame([(1, 9, 2.0, 0), (1, 3, 1.0, 1)], "qid int, id bigint, score double, rank int")
    got = search.fuse(kw, top, 10).orderBy("rank").collect()
    assert got[0].id == 3 and got[0].score == pytest.approx(0.5 / 62 + 0.5 / 62, abs=1e-6)
    assert [r.id for r in got] == [3, 1, 9, 2]
    only = search.fuse(kw, top, 10, keyword_weight=0.0)
    assert only.where("id = 9").first().score == 0
    empty = search.fuse(None, search.vector_search(u.limit(0), q, 3), 5)
    assert empty.count() == 0


def test_rerank_order(spark):
    c = corpus(spark)
    q = spark.createDataFrame([(1, "alpha beta")], "qid int, query string")
    hits = search.bm25(c, q, 4)
    rr = search.overlap_rerank(hits, c, q, 2)
    assert rr.where("rank = 0").first().id == 3
    all_ = search.reorder(hits, rr)
    assert all_.count() == 4 and all_.where("rank = 0").first().id == 3
    assert "alpha" in search.contexts(hits, c, 2).first().context
    assert c.select(F.lit(1)).count() == 5


def test_every_hundredth_row_is_asked(spark):
    from pyspark.sql import functions as F

    from skerry.plans import queries

    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    got = {r.qid: r.n for r in queries.QUERIES["vector_batch_knn"](spark, d).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert got == {r.vec_id: 10 for r in e.where("vec_id % 100 = 0").select("vec_id").distinct().collect()}
    c = spark.read.parquet(f"{d}/chunks.parquet").where("id % 100 = 0").select("id").distinct()
    got = {r.qid for r in queries.QUERIES["bm25_topk"](spark, d).select("qid").distinct().collect()}
    assert got == {r.id for r in c.collect()} and got


def test_blocks_equal_one_search(spark):
    from skerry.operators import search

    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(40)], "id bigint, embedding array<double>")
    q = v.selectExpr("id AS qid", "embedding AS q")
    rows = lambda x: sorted(map(tuple, x.select("qid", "id", "score", "rank").collect()))
    assert rows(search.in_blocks(q, lambda b: search.vector_search(v, b, 3), most=9)) == rows(search.vector_search(v, q, 3))
    assert rows(search.vector_search_many(v, q, 3)) == rows(search.vector_search(v, q, 3))


def test_index_life_cycle(spark):
    c = corpus(spark)
    terms = lambda ix: {r.term: (r.df, pytest.approx(r.idf)) for r in ix.terms.collect()}
    whole = search.build_index(c)
    grown = search.append(search.build_index(c.where("id <= 2")), c)
    assert terms(grown) == terms(whole) and grown.docs.count() == 5
    less, n = search.delete_by(grown, c, F.col("user_id") == "bob")
    assert n == 3 and terms(less) == terms(search.build_index(c.where("user_id = 'alice'")))
    assert search.delete_by(less, c, F.col("id") == 99)[1] == 0
    assert search.compact(less).postings.count() == less.postings.count() and search.clear(less).docs.count() == 0
    q = spark.createDataFrame([(1, "alpha")], "qid int, query string")
    assert {r.id for r in search.bm25(c, q, 10, index=less).collect()} == {1, 3}


def test_both_indexes(spark):
    c = corpus(spark).where("content is not null")
    v = c.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    made, n = search.add_chunks(None, c, v)
    assert n == 4 and made.vectors.count() == 4
    same, n = search.add_chunks(made, c.limit(0), v.limit(0))
    assert n == 0 and same.keyword.docs.count() == 4
    left, n = search.remove_chunks(made, c, F.col("user_id") == "alice")
    assert n == 2 and {r.id for r in left.vectors.collect()} == {2, 5} == {r.id for r in left.keyword.docs.collect()}
    with pytest.raises(ValueError):
        search.add_chunks(None, c, v.where("id > 1"))
    with pytest.raises(ValueError):
        search.reranker("other")


def test_ranks_are_taken_before_rounding(spark):
    v = spark.createDataFrame([(1, [1.0, 2e-4]), (2, [1.0, 1e-4])], "id bigint, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid bigint, q array<double>")
    for f in (search.vector_search, search.vector_search_many):
        assert [(r.id, r.score) for r in f(v, q, 2).orderBy("rank").collect()] == [(2, 1.0), (1, 1.0)]


def test_many_questions_equal_one_search(spark):
    rows = [(i, " ".join(f"w{(i * j) % (7 + j)}" for j in range(1, 1 + i % 9))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, rows[8][1]), (63, rows[8][1]), (8, "w1 w2 again"), (None, "w1")]
    c = spark.createDataFrame(rows, "id bigint, content string").where("id is not null").repartition(5)
    q = spark.createDataFrame([(1, "w1 w2 w1"), (2, rows[8][1]), (3, "zzz"), (4, None), (5, "W0 w3 w5"), (5, "w1")], "qid int, query string")
    got = lambda x: sorted(map(tuple, x.select("qid", "id", "score", "rank").collect()))
    want = got(search.bm25(c, q, 7))
    assert got(search.bm25_many(search.texts_of(c), q, 7)) == want and len(want) == 35
    assert got(search.in_blocks(q, lambda b: search.bm25_many(search.texts_of(c), b, 7), most=2)) == want
    some, q = c.where("id < 4"), q.where("qid < 5")
    assert got(search.bm25_many(search.among(search.texts_of(c), some), q, 7)) == got(search.bm25(c, q, 7, F.col("id") < 4))


def test_filter_beside_the_words_equals_one_search(spark):
    c = spark.createDataFrame([(i, f"w{i % 3} w{i % 7} common", i % 4) for i in range(1, 40)], "id bigint, content string, part int")
    q = spark.createDataFrame([(1, "w1 w5"), (2, "zzz")], "qid int, query string")
    got = lambda x: sorted(map(tuple, x.select("qid", "id", "score", "rank").collect()))
    twice = c.unionByName(spark.createDataFrame([(3, "w1 w5 more", 1), (4, "w1", None)], c.schema))
    for rows in (c, twice):
        want = got(search.bm25(rows, q, 5, F.col("part") == 1))
        assert len(want) == 10 and got(search.bm25_many(search.texts_of(rows, F.col("part") == 1), q, 5)) == want


def test_bm25_tenant_does_not_shuffle_words_for_its_filter(spark):
    from skerry.plans.queries import QUERIES
    from skerry.plans.shared import held, scope

    with scope(spark):
        before = held(spark)
        assert QUERIES["bm25_tenant"](spark, "/root/testdata/sf0.001").count()
        assert not [x for x in held(spark) if x not in before and "/among-" in x]


def without_postings(spark, name):
    from skerry.plans.queries import QUERIES
    from skerry.plans.shared import held, scope

    with scope(spark):
        before = held(spark)
        n = QUERIES[name](spark, "/root/testdata/sf0.001").count()
        return n and not [x for x in held(spark) if x not in before and "/postings-" in x]


def asked_of(terms, questions, avgdl):
    """A batch of questions, each {place of a term: weight}."""
    rows = [(i, t, w) for i, q in enumerate(questions) for t, w in sorted(q.items())]
    question, term, weight = (np.array(x) for x in zip(*rows))
    return search._Asked(pa.array(range(len(questions))), pa.array([f"w{t}" for t in range(terms)]), question, term, weight.astype(float), avgdl)


def summed(a, ids, texts, k):
    """{question: its k best (score, id)}, rows of one id summed."""
    out = {}
    for q in range(len(a.qids)):
        score = dict.fromkeys(ids, 0.0)
        for i, t in zip(ids, texts):
            for term, w in zip(a.term[a.question == q], a.weight[a.question == q]):
                tf = t.count(term)
                score[i] += w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / a.avgdl))
        out[q] = sorted(((round(s, 9), i) for i, s in score.items()), reverse=True)[:k]
    return out


def test_groups_of_texts_lose_no_hit(monkeypatch):
    monkeypatch.setattr(search, "GROUP", 8)
    monkeypatch.setattr(search, "TOGETHER", 3)
    rng = np.random.default_rng(5)
    # Two vocabularies, copies, blank texts, ids of several rows; the last two questions meet one text and none.
    texts = [list(rng.integers(0, 20, 12) + 20 * (i % 2)) for i in range(90)] + [[]] * 12 + [[41]]
    texts += texts[:9]
    ids = np.array([*range(100), 99, 100, 100, *range(200, 200 + len(texts) - 103)])
    questions = [{int(t): float(w) for t, w in zip(rng.choice(20, 6, False) + 20 * (q % 2), rng.random(6))} for q in range(12)] + [{41: 1.0}, {42: 1.0}]
    a = asked_of(43, questions, 11.0)
    doc, at = np.repeat(np.arange(len(texts)), [len(t) for t in texts]), np.array([x for t in texts for x in t], np.int64)
    counts = []
    for k in (1, 4, 500):
        found = list(search._scores(a, ids, np.array([len(t) for t in texts]), doc, at, k, np.full(len(questions), -np.inf), counts))
        q, score, name = (np.concatenate(x) for x in zip(*found))
        best = search._best(q, score, name, k)
        want = summed(a, ids.tolist(), texts, k)
        assert {x: [(round(s, 9), i) for y, s, i in zip(q[best], score[best].tolist(), name[best].tolist()) if y == x] for x in want} == want
        if k == 1:
            # Groups of the other vocabulary are not summed up, and of the texts without a term few are listed.
            assert counts[1] < 0.7 * counts[0] and (q == 13).sum() <= len(texts) / 8


def test_words_are_cut_once(spark):
    c = spark.createDataFrame([(1, "Alpha beta  alpha"), (2, None)], "id bigint, content string")
    assert {(r.id, tuple(r.ts)) for r in search.texts_of(c).texts.collect()} == {(1, ("alpha", "beta", "alpha")), (2, ())}


def test_bm25_topk_writes_no_postings(spark):
    assert without_postings(spark, "bm25_topk")


def test_hybrid_bm25_only_writes_no_postings(spark):
    assert without_postings(spark, "hybrid_bm25_only")


def test_rerank_none_writes_no_postings(spark):
    assert without_postings(spark, "rerank_none")


def test_bm25_tenant_writes_no_postings(spark):
    assert without_postings(spark, "bm25_tenant")
