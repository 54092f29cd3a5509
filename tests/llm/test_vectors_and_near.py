"""Nearest vectors and near-duplicates against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.llm import near, neighbours

SCHEMA = "chunk_id bigint, embedding array<float>, model string"


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i]), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(12, dim))
    return (c[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32)


def test_pairs_against_brute_force(spark):
    x, ids = clustered(700, 16), list(range(10, 710))
    rows = [(i, [float(v) for v in r], "m") for i, r in zip(ids, x)]
    rows += [(i, [float(v) for v in r], "other") for i, r in zip(ids[:30], clustered(30, 16, 5))]
    bad = [(1, None, "m"), (2, [0.0] * 16, "m"), (3, [float("nan")] * 16, "m"), (4, [1.0] * 8, "m"), (5, [float("inf")] + [0.0] * 15, "m"), (6, [None] + [1.0] * 15, "m"), (None, [1.0] * 16, "m"), (7, [1.0] * 16, None)]
    df = spark.createDataFrame(rows + bad + rows[:40], SCHEMA).withColumn("neighbour", F.lit("clash"))
    s = neighbours.Settings(dim=16, parts=8, block=150, per_cell=32, sample=400)
    got = {(r.chunk_a, r.chunk_b) for r in neighbours.neighbour_pairs(df, s).collect()}
    want = brute(ids, x.astype(np.float64)) | brute(ids[:30], clustered(30, 16, 5).astype(np.float64))
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_many_copies_are_exact(spark):
    x = clustered(200, 16, 2)
    x[50:150] = x[50]
    rows = [(i, [float(v) for v in r], "m") for i, r in enumerate(x)]
    s = neighbours.Settings(dim=16, parts=8, block=60, per_cell=32)
    got = neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), s)
    per = {}
    for r in got.collect():
        per.setdefault(r.chunk_id, {})[r["rank"]] = r.neighbour
    assert len(per) == 200 and all(len(v) == 5 for v in per.values())
    assert per[149] == {1: 50, 2: 51, 3: 52, 4: 53, 5: 54} and per[52] == {1: 50, 2: 51, 3: 53, 4: 54, 5: 55}


def test_copies_that_the_sample_misses_are_exact(spark):
    x = clustered(2000, 16, 3)
    x[::10] = x[0]
    rows = [(i, [float(v) for v in r], "m") for i, r in enumerate(x)]
    s = neighbours.Settings(dim=16, parts=8, block=600, per_cell=64, sample=16, rerank=8)
    per = {}
    for r in neighbours.nearest_neighbours(spark.createDataFrame(rows[::-1], SCHEMA), s).collect():
        per.setdefault(r.chunk_id, {})[r["rank"]] = r.neighbour
    assert len(per) == 2000 and all(len(v) == 5 for v in per.values())
    for i in range(0, 2000, 10):
        assert list(dict(sorted(per[i].items())).values()) == [j for j in range(0, 60, 10) if j != i][:5]


def test_exact_way_equals_brute_force(spark):
    x, ids = clustered(900, 16, 8), list(range(900))
    df = spark.createDataFrame([(i, [float(v) for v in r], "m") for i, r in zip(ids, x)], SCHEMA)
    s = neighbours.Settings(dim=16, parts=8, block=100, per_cell=32, exact=True)
    assert {(r.chunk_a, r.chunk_b) for r in neighbours.neighbour_pairs(df, s).collect()} == brute(ids, x.astype(np.float64))


def test_work_for_a_vector_grows_slower_than_the_vectors():
    """The sample stays, the vectors grow: fat cells are cut where they are held."""
    s, work = neighbours.Settings(dim=16, parts=8, block=1 << 30, per_cell=64, fat=512, sample=400), []
    for n in (4_000, 16_000, 64_000):
        rng = np.random.default_rng(9)
        groups = clustered(n // 10, 16, 9)  # vectors have some neighbours much nearer than the rest
        x = (groups[rng.integers(0, len(groups), n)] + 0.05 * rng.normal(size=(n, 16))).astype(np.float32)
        ix = neighbours.fit(x[:400], n, s)
        u = neighbours.unit(x.astype(np.float64)).astype(np.float32)
        own, probes = neighbours.probe_cells(u, ix, s)
        ask = np.arange(0, n, n // 400)
        cells = [probes[i][probes[i] >= 0] if i % (n // 400) == 0 else np.zeros(0, np.int64) for i in range(n)]
        begin = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
        scored, found = [], {}
        for q, other, _ in neighbours.search_block(np.arange(n), x, own, (np.concatenate(cells), begin), ix, s, scored):
            for i, j in zip(q.tolist(), other.tolist()):
                found.setdefault(i, set()).add(j)
        best = np.argsort(-(u[ask] @ u.T), axis=1)[:, 1:6]
        assert np.mean([len(set(b.tolist()) & found[i]) / 5 for i, b in zip(ask.tolist(), best)]) >= 0.9
        work.append(sum(scored) / len(ask))
    assert work[2] < 2.5 * work[1], work


def test_a_thin_sample_does_not_widen_the_search(spark, monkeypatch):
    """Of 240 groups of 50 vectors the sample has few of each: cells and margin are fitted on more than it, and few cells are probed."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(240, 16))
    x = (centres / np.linalg.norm(centres, axis=1, keepdims=True))[np.arange(12_000) % 240] + 0.03 * rng.normal(size=(12_000, 16))
    x = x.astype(np.float32)
    s, held, assign = neighbours.Settings(dim=16, parts=8, block=1_000, per_cell=32, sample=400), [], neighbours._assign
    monkeypatch.setattr(neighbours, "_assign", lambda shared, s: held.append(shared.value[0]["m"]) or assign(shared, s))
    df = spark.createDataFrame([(i, [float(v) for v in r], "m") for i, r in enumerate(x)], SCHEMA)
    found = {}
    for r in neighbours.nearest_neighbours(df, s).where("chunk_id % 40 = 0").collect():
        found.setdefault(r.chunk_id, set()).add(r.neighbour)
    u = neighbours.unit(x.astype(np.float64)).astype(np.float32)
    ask = np.arange(0, 12_000, 40)
    best = np.argsort(-(u[ask] @ u.T), axis=1)[:, 1:6]
    assert np.mean([len(set(b.tolist()) & found[i]) / 5 for i, b in zip(ask.tolist(), best)]) >= 0.98
    own, probes = neighbours.probe_cells(u, held[0], s)
    assert (probes >= 0).sum() / len(u) < 6 and (probes[np.arange(len(u)), 0] == own).all()
    # The cells below the tops are those that all cells together give.
    d = (held[0].centroids**2).sum(1)[None] - 2 * (u @ held[0].centroids.T)
    assert (d.argmin(1) == own).mean() > 0.999


def test_few_and_none(spark):
    one = spark.createDataFrame([(1, [1.0] * 96, "m")], SCHEMA)
    assert neighbours.neighbour_pairs(one).count() == 0 and neighbours.neighbour_pairs(one.limit(0)).count() == 0
    two = spark.createDataFrame([(1, [1.0] * 96, "m"), (2, [2.0] * 96, "m"), (2, [2.0] * 96, "m")], SCHEMA)
    assert [tuple(r) for r in neighbours.neighbour_pairs(two).collect()] == [(1, 2)]


def shingles(text, n=3):
    w = near.words_of(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus(seed=1, n=60):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab, 80)) for _ in range(n)]
    for t in list(texts[:25]):
        w = t.split()
        for k in rng.integers(0, len(w), rng.integers(1, 5)):
            w[k] = "edit" + str(rng.integers(1000))
        texts.append(" ".join(w))
    return texts + [texts[3].upper(), texts[3] + "!", texts[4]]


SN = "id bigint, content string, chunk_type string, doc_id bigint, chunk_index int"


def test_near_pairs_against_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "text", i, 0) for i, t in enumerate(texts)]
    extra = [(900, texts[0], "table", 900, 0), (901, None, "text", 901, 0), (902, "too short", "text", 902, 0), (903, "", "text", 903, 0), (None, texts[0], "text", 1, 1)]
    df = spark.createDataFrame(rows + extra + rows[:9], SN).withColumn("rep", F.lit("clash")).withColumn("low", F.lit(1))
    s = [shingles(t) for t in texts]
    want = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.5}
    got = {tuple(r) for r in near.near_pairs(df).collect()}
    assert got == want
    docs = spark.createDataFrame([(1, "AB"), (2, "ab"), (5, None), (6, "")], "doc_id bigint, file_hash string")
    groups = {r.chunk_id: (r.class_id, r.links) for r in near.near_groups(df, docs).collect()}
    assert set(groups) == set(range(len(texts))) and groups[2][0] == groups[1][0] and all(groups[i][0] == groups[j][0] for i, j in got)
    assert near.near_pairs(df.limit(0)).count() == 0


def distances(words):
    return np.bitwise_count(words[:, None] ^ words[None]).sum(2)


def test_bit_planes_count_like_popcount():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 63, (150, 4)).astype(np.uint64)
    words[7] = words[3] ^ np.uint64(9)
    masks, base = np.where(near._bits(words), near._ALL, np.uint64(0)), near.planes(words)
    q, w = (x.ravel() for x in np.mgrid[0:150, 0:3])
    alive = np.where(w == 2, np.uint64((1 << 22) - 1), near._ALL)  # 150 = 2 * 64 + 22 lanes
    for radius in (0, 2, 31, 100, 128, 256):
        at, lanes = near.within(masks, base, q, w, alive, np.full(len(q), radius))
        i, lane = np.nonzero(np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 8), axis=1, bitorder="little"))
        got = set(zip(q[at[i]].tolist(), (w[at[i]] * 64 + lane).tolist()))
        assert got == {tuple(x) for x in np.argwhere(distances(words) <= radius).tolist()}


def postings(words, size, pos, bucket):
    return near._sorted(near.Postings(np.asarray(bucket, np.int32), np.arange(len(words)), np.asarray(size), np.asarray(pos), words))


def test_unrelated_blocks_are_abandoned():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, (3000, 4)).astype(np.uint64) | (rng.integers(0, 2, (3000, 4)).astype(np.uint64) << np.uint64(63))
    counts = []
    near.compare(postings(words, np.full(3000, 100), np.zeros(3000, int), np.zeros(3000, int)), near.Settings(), None, counts)
    blocks, early, planes = counts
    assert blocks > 50_000 and early > 0.9 * blocks and planes < 0.9 * 256 * blocks


def test_compare_equals_the_pairwise_rule():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (20, 4)).astype(np.uint64)
    words = base[rng.integers(0, 20, 900)] ^ (rng.integers(0, 1 << 63, (900, 4)).astype(np.uint64) & rng.integers(0, 1 << 63, (900, 4)).astype(np.uint64) & rng.integers(0, 1 << 63, (900, 4)).astype(np.uint64))
    size, pos, bucket = rng.integers(60, 160, 900), rng.integers(0, 60, 900), rng.integers(0, 4, 900)
    p, s = postings(words, size, pos, bucket), near.Settings()
    both = np.ceil((p.size[:, None] + p.size[None]) / 3 - 1e-9)
    ok = (p.bucket[:, None] == p.bucket[None]) & (p.pos[:, None] <= p.size[:, None] - both) & (p.pos[None] <= p.size[None] - both) & (distances(p.words) <= p.size[:, None] + p.size[None] - 2 * both)
    want = {tuple(sorted((int(p.key[i]), int(p.key[j])))) for i, j in np.argwhere(ok) if i < j}
    assert want and {tuple(x) for x in near.compare(p, s).tolist()} == want
    assert {tuple(x) for x in near.compare(p, near.Settings(dense=1)).tolist()} == want and {tuple(x) for x in near.compare(p, near.Settings(dense=65)).tolist()} == want


def test_blocks_keep_pairs_at_the_bound_of_their_sizes():
    # Sizes 123 and 123 may differ in 82 bits, 123 and 124, of the block's last lane, in 81 only.
    words, size = np.random.default_rng(6).integers(0, 1 << 63, (64, 4)).astype(np.uint64), np.full(64, 123)
    size[-1] = 124
    words[1] = words[0] ^ np.array([2**64 - 1, 2**18 - 1, 0, 0], np.uint64)
    assert distances(words)[0, 1] == 82
    for dense in (1, 65):
        assert near.compare(postings(words, size, np.zeros(64, int), np.zeros(64, int)), near.Settings(dense=dense)).tolist() == [[0, 1]]


def test_rows_of_copies_stand_once_in_the_order_of_postings():
    rng = np.random.default_rng(9)
    bucket, size, key, pos = rng.integers(-2, 3, 4000).astype(np.int32), rng.integers(60, 64, 4000), rng.integers(-9, 9, 4000), rng.integers(0, 4, 4000)
    rows = list(zip(bucket.tolist(), size.tolist(), key.tolist(), pos.tolist()))
    got = [rows[i] for i in near._order(bucket, size, key, pos)]
    assert len(set(got)) == len(got) and set(got) == set(rows) and [r[:2] for r in got] == sorted(r[:2] for r in got)


def test_shingles_are_counted_by_their_slots():
    rng = np.random.default_rng(10)
    for n in (0, 1, 5, 3000):
        known = np.unique(np.concatenate([rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1), np.arange(n, dtype=np.uint64)]))  # half of them crowd one slot
        counts = rng.integers(2, 99, len(known))
        x = rng.permutation(np.concatenate([known, known + np.uint64(1), rng.integers(0, 1 << 63, 500).astype(np.uint64), np.array([0, 2**64 - 1], np.uint64)]))
        of = dict(zip(known.tolist(), counts.tolist()))
        assert near.counter((known, counts))(x).tolist() == [of.get(v, 0) for v in x.tolist()]


def test_pairs_are_made_of_links_and_copies_alone(spark):
    # The sketches of all texts, most of which have no partner, are not read again for the pairs.
    df = spark.createDataFrame([(i, t, "text", i, 0) for i, t in enumerate(corpus())], SN)
    read = {f.split("/")[-2].split("-")[0] for f in near.near_pairs(df).inputFiles()}
    assert read == {"links", "copies"}


def test_hot_bucket_over_partitions(spark):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"e{rng.integers(10**6)}"
        texts.append(" ".join(w))
    rows = [(i, t, "text", i, 0) for i, t in enumerate(texts)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = near.near_pairs(spark.createDataFrame(rows, SN), near.Settings(rows=300)).count()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert n == 150 * 149 // 2


def test_no_link_is_lost_at_the_least_similarity(spark):
    rng = np.random.default_rng(11)
    vocab, texts = [f"v{i}" for i in range(5000)], []
    for i in range(300):
        w = list(rng.choice(vocab, 100))
        other = list(w)
        for k in range(4, 100, 9):  # 11 changed words touch 33 of 98 shingles: 65 of 131 are shared
            other[k] = f"x{i}y{k}"
        other[4] = w[4]
        texts += [" ".join(w), " ".join(other)]
    s = [shingles(t) for t in texts]
    want = {(i, i + 1) for i in range(0, 600, 2) if len(s[i] & s[i + 1]) / len(s[i] | s[i + 1]) >= 0.5}
    assert len(want) == 300 and max(len(s[i] & s[j]) / len(s[i] | s[j]) for i, j in want) < 0.56
    df = spark.createDataFrame([(i, t, "text", i, 0) for i, t in enumerate(texts)], SN)
    assert {tuple(r) for r in near.near_pairs(df).collect()} == want


def test_pairs_do_not_depend_on_the_sample_that_orders_shingles(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.001/chunks.parquet")
    got = [{tuple(r) for r in near.near_pairs(chunks, near.Settings(sample=n)).collect()} for n in (0, 20, 10**9)]
    assert got[0] == got[1] == got[2] and got[0]


def test_words_are_hashed_like_the_regular_expression_cuts_them():
    texts = ["One two-two, ONE_one", "", None, "İstanbul ΟΔΟΣ\nΟΔΟΣ ß ²", "𝔘x 𝟘𝟙 😀 \ud800a", "..."]
    for chars in (1, 1 << 18):
        h, n = near.word_hashes(texts, chars)
        words = [near.words_of(t or "") for t in texts]
        assert n.tolist() == [len(w) for w in words]
        flat = [w for t in words for w in t]
        assert len(set(h.tolist())) == len(set(flat)) == len(set(zip(flat, h.tolist())))


def test_parts_follow_bucket_size_and_key():
    rng = np.random.default_rng(3)
    place, key = rng.integers(0, 6, 500), rng.integers(-3, 3, 500)
    at = [(1, -2), (1, 0), (1, 0), (4, 2)]
    part = near.part_of(place, key, tuple(np.array(x) for x in zip(*at)))
    assert part.tolist() == [sum(b <= r for b in at) for r in zip(place.tolist(), key.tolist())]


def test_postings_are_shuffled_as_packed_values(spark):
    # Of a text's postings one row a part goes out, not one row each.
    sketches = spark.createDataFrame(near_sketches(40), "k1 bigint, size int, wide binary, w0 bigint, w1 bigint, w2 bigint, w3 bigint, codes0 binary")
    bounds = (np.array([50 << 32]), np.array([0]))
    shared = spark.sparkContext.broadcast([bounds])
    got = sketches.coalesce(1).mapInArrow(near._dealt(near.Settings(), shared, 0), "part int, rows binary, wider binary").collect()
    assert sorted(r.part for r in got) == [0, 1]
    rows = {r.part: np.frombuffer(r.rows, near._POSTING) for r in got}
    assert sum(map(len, rows.values())) == 4000 and (rows[0]["bucket"] < 50).all() and (rows[1]["bucket"] >= 50).all()
    assert {(int(k), int(p)) for x in rows.values() for k, p in zip(x["key"], x["pos"])} == {(k, p) for k in range(40) for p in range(100)}


    # Nothing but the texts' own words may stand for them, in every part.
    for r in got:
        wider = np.frombuffer(r.wider, near._WIDER)
        assert [(int(x["key"]), int(x["size"]), bytes(x["wide"])) for x in wider] == [] and all(rows[r.part]["size"] < near._LONG)


def test_long_texts_far_apart_leave_no_pair_for_the_joins(spark):
    rng = np.random.default_rng(8)
    sketches = spark.createDataFrame([(k, 200, rng.bytes(128), 0, 0, 0, 0, bytes(np.array([5 << 32], np.int64))) for k in range(30)] + [(k, 200, b"\7" * 128, 0, 0, 0, 0, bytes(np.array([5 << 32], np.int64))) for k in (40, 41)], "k1 bigint, size int, wide binary, w0 bigint, w1 bigint, w2 bigint, w3 bigint, codes0 binary")
    none = np.zeros(0, np.int64)
    dealt = sketches.mapInArrow(near._dealt(near.Settings(), spark.sparkContext.broadcast([(none, none)]), 0), "part int, rows binary, wider binary").repartitionById(1, "part")
    pairs = dealt.mapInArrow(near._scan(near.Settings()), near._SCAN).where("b is not null").select("a", "b").collect()
    assert [tuple(r) for r in pairs] == [(40, 41)]


def near_sketches(n):
    codes = bytes(np.array([(p << 32) | p for p in range(100)], np.int64))
    return [(k, 100 + k, bytes(range(k, k + 128)), k, k + 1, k + 2, k + 3, codes) for k in range(n)]
