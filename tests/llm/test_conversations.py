from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skerry.llm import conversations, turns
from skerry.llm.components import connected_components

T0 = datetime(2024, 1, 1)
SCHEMA = "id string, thread_id string, role string, content string, metadata string, created_at timestamp"


def aliases(spark):
    return spark.createDataFrame([("user", "user"), ("Human ", "user"), ("assistant", "assistant"), ("bot", "assistant"), ("system", "system"), (None, None)], "alias string, role string")


def threads(spark, ids):
    return spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "id string").withColumn("conv", F.lit("clash"))


def at(i):
    return T0 + timedelta(minutes=i)


def faults(spark, rows, ids):
    m = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("clash"))
    return {r.thread_id: r.fault for r in conversations.conversation_faults(m, threads(spark, ids), aliases(spark)).collect()}


CASES = {
    "good": ([("user", "q", 0), ("Bot", "a", 1), ("system", None, 2), ("HUMAN", "q", 3), (" assistant ", "a", 4)], None),
    "tie": ([("assistant", "a", 0), ("system", "s", 0), ("user", "q", 0)], None),
    "nobody": ([("system", "s", 0)], "empty"), "none": ([], "empty"), "blank": ([("user", " .", 0), ("assistant", None, 1)], "empty"),
    "starts": ([("assistant", "a", 0), ("user", "q", 1), ("assistant", "a", 2)], "broken"), "twice": ([("user", "q", 0), ("assistant", "a", 1), ("assistant", "b", 2)], "broken"),
    "role": ([("user", "q", 0), ("assistant", "a", 1), ("tool", "x", 2)], "broken"), "null_role": ([("user", "q", 0), ("assistant", "a", 1), (None, "x", 2)], "broken"),
    "undated": ([("user", "q", None), ("assistant", "a", 1)], "broken"), "open": ([("user", "q", 0), ("assistant", "a", 1), ("user", "q", 2)], "no_reply"),
    "blank_reply": ([("user", "q", 0), ("assistant", "-", 1)], "no_reply"), "two_users": ([("user", "q", 0), ("user", "q", 1), ("assistant", "a", 2)], "no_reply"),
}


def rows_of(name, turns_):
    return [(f"{name}{i}", name, r, c, None, None if t is None else at(t)) for i, (r, c, t) in enumerate(turns_)]


def test_faults(spark):
    rows = [r for n, (ts, _) in CASES.items() for r in rows_of(n, ts)]
    got = faults(spark, rows + rows[:4], list(CASES))
    assert {n: got.get(n) for n in CASES} == {n: want for n, (_, want) in CASES.items()}
    assert set(got) <= set(CASES)


def test_hot_thread_over_many_partitions(spark):
    rows = [(f"h{i}", "hot", "user" if i % 2 == 0 else "assistant", f"t{i}", None, at(i)) for i in range(4000)]
    m = spark.createDataFrame(rows + rows[10:20], SCHEMA)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert conversations.conversation_faults(m, threads(spark, ["hot"]), aliases(spark)).count() == 0
        out = conversations.rebuilt_conversations(m, threads(spark, ["hot"]), aliases(spark)).orderBy("turn_no").collect()
        assert [r.turn_no for r in out] == list(range(4000)) and [r.content for r in out] == [f"t{i}" for i in range(4000)]
        cut = m.where("id <> 'h2001'")
        assert conversations.conversation_faults(cut, threads(spark, ["hot"]), aliases(spark)).first().fault == "no_reply"
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_links_find_conversations(spark):
    rows = [
        ("a", "t", "user", "q", None, at(0)), ("b", None, "assistant", "a", '{"reply_to": "a"}', at(1)), ("c", None, "user", "q2", '{"reply_to": "b"}', at(2)),
        ("d", "t", "assistant", "a2", '{"quote_of": "c"}', at(3)), ("x", None, "user", "q", None, at(0)), ("y", None, "assistant", "a", '{"reply_to": "x"}', at(1)), ("z", None, "user", "lone", '{"reply_to": "gone"}', at(1)),
    ]
    m = spark.createDataFrame(rows, SCHEMA)
    conv = {r.id: r.conv for r in turns.conversations_of(m).collect()}
    assert conv == {"b": "t", "c": "t", "x": "message:x", "y": "message:x", "z": conv["z"]} and conv["z"] not in ("t", "message:x")
    assert faults(spark, rows, ["t"]) == {}


def test_conversations_without_thread_are_rebuilt(spark):
    rows = [("a", "t", "user", "q", None, at(0)), ("b", "t", "assistant", "a", None, at(1)), ("x", None, "user", "q", None, at(0)), ("y", None, "assistant", "a", '{"reply_to": "x"}', at(1))]
    out = conversations.rebuilt_conversations(spark.createDataFrame(rows, SCHEMA), threads(spark, ["t"]), aliases(spark)).collect()
    assert sorted((r.thread_id, r.turn_no, r.message_id) for r in out) == [("message:x", 0, "x"), ("message:x", 1, "y"), ("t", 0, "a"), ("t", 1, "b")]


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, 300 + i) for i in range(1, 40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {n: find(n) for n in list(parent)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_empty_tables_and_alias_bound(spark):
    m, a = spark.createDataFrame([], SCHEMA), aliases(spark)
    assert conversations.conversation_faults(m, spark.createDataFrame([], "id string"), a).count() == 0
    assert conversations.rebuilt_conversations(m, spark.createDataFrame([], "id string"), a.limit(0)).count() == 0
    with pytest.raises(ValueError):
        turns.role_of(a, most=2)


def test_missing_message_holds_those_that_name_it(spark):
    rows = [
        ("x", None, "user", "q", '{"quote_of": "gone"}', at(0)), ("y", None, "assistant", "a", '{"reply_to": "gone"}', at(1)),
        ("z", None, "user", "q", '{"reply_to": "other"}', at(2)), ("w", None, "user", "q", None, at(3)),
    ]
    got = {r.id: r.conv for r in turns.conversations_of(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["x"] == got["y"] and len({got["x"], got["z"], got["w"]}) == 3
