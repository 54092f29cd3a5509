"""Chunkers against small models of their rules."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.operators import chunking
from tests_model import packed


def run(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_sentence_packer_equals_model(spark):
    base = ["", "Hi!", "A. B. C", "x" * 1500, "One. " * 400, "word " * 300 + ". end", ". ".join("s" * k for k in range(1, 180)), "a.\nb.\nc", "tail. "]
    assert run(spark, base, chunking.sentence_chunks("x")) == [packed(t) for t in base]
    assert run(spark, [None], chunking.sentence_chunks("x")) == [[]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab. \n", max_size=400), min_size=1, max_size=6))
def test_sentence_packer_property(spark, texts):
    assert run(spark, texts, chunking.sentence_chunks("x", 60, 20)) == [packed(t, 60, 20) for t in texts]


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# A\none\n## B\n\n#tag\ntwo"), (2, "# only\n# heads"), (3, "plain"), (4, "  "), (5, None)], "k int, x string")
    got = {(r.k, r.section_no): (r.section_header, r.content) for r in chunking.markdown_sections(df, "k", "x").collect()}
    assert got == {(1, 0): (None, "intro"), (1, 1): ("A", "one"), (1, 2): ("tag", "two"), (2, 0): (None, "# only\n# heads"), (3, 0): (None, "plain")}


def test_block_chunks_lose_nothing(spark):
    texts = ["", "short", "line\n" * 500, "x" * 2500, "\n" * 30, ("y" * 999 + "\n") * 3, None]
    got = run(spark, texts, chunking.block_chunks("x"))
    for t, cs in zip(texts, got):
        assert "".join(cs) == (t or "") and all(0 < len(c) <= 1000 for c in cs)


def test_tables(spark):
    df = spark.createDataFrame([(i, None if i == 3 else f"v{i}") for i in range(250)], "a int, b string")
    rows = {r.chunk_index: r for r in chunking.table_markdown(df, ["a"], ["a", "b"]).collect()}
    assert sorted(rows) == [0, 1, 2] and (rows[2].row_start, rows[2].row_end) == (200, 249)
    assert rows[0].content.startswith("Table (CSV):\n| a | b |\n| --- | --- |\n| 0 | v0 |") and "| 3 |  |" in rows[0].content
    t = spark.createDataFrame([([["h", None], [" x ", "y"]],)], "t array<array<string>>").select(chunking.array_table_markdown(F.col("t"))).first()[0]
    assert t == "Table:\n| h |  |\n| --- | --- |\n| x | y |"
    assert re.match("Table", t)
