from pyspark.sql import functions as F

from skerry.functions import schemas
from skerry.operators import answers, chunking
from tests_model import packed_paragraphs


def test_local_answer(spark):
    ctx = "Budget is 5.\n\nThe audit committee met in spring and approved the whole plan for next year.\n\nshort\n\nAudit again"
    df = spark.createDataFrame([("audit plan", ctx), ("zzz", "tiny"), ("q", ""), ("q", None)], "q string, c string")
    got = [r.y for r in df.select(answers.local_answer("q", "c", note="!").alias("y")).collect()]
    assert got[0].startswith("- The audit committee met") or got[0].startswith("The audit committee met")
    assert got[1] == "tiny!" and got[2] == got[3] == "No relevant information found.!"


def test_fallback_and_prompt(spark):
    df = spark.createDataFrame([("alpha", "One two. Alpha three. Four. Alpha late"), ("zzz", "One. Two. Three"), ("q", "")], "q string, c string")
    got = [r.y for r in df.select(answers.fallback_answer("q", "c").alias("y")).collect()]
    assert got[:2] == ["Alpha three.", "One. Two."] and got[2].endswith("related to: q")
    p = df.select(answers.prompt("be brief", F.col("q"), F.col("c")).alias("p")).first().p
    assert [m.role for m in p] == ["system", "user"] and "Question: alpha" in p[1].content


def test_generate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, p string")
    assert {r.k: r.content for r in answers.generate(df, "k", "p", lambda: lambda xs: [x.upper() for x in xs]).collect()} == {1: "A", 2: "B"}

    def broken():
        def run(xs):
            raise RuntimeError("down")

        return run

    assert all("down" in r.error for r in answers.generate(df, "k", "p", broken).collect())


def test_paragraph_buffer_equals_model(spark):
    cases = [[(True, "Top"), (False, "One. Two"), (False, " "), (True, "Next"), (False, "Three")], [(False, "p" * 400 + ". x"), (False, "q" * 700), (False, "tail. end"), (False, None)], [], [(True, "only")]]
    df = spark.createDataFrame([(i, [{"heading": h, "text": t} for h, t in c]) for i, c in enumerate(cases)], "i int, ps array<struct<heading:boolean,text:string>>")
    got = [[(x.section, x.content) for x in r.y] for r in df.select("i", chunking.paragraph_chunks(F.col("ps")).alias("y")).orderBy("i").collect()]
    assert got == [packed_paragraphs(c) for c in cases]


def test_entities_round_trip(spark):
    df = spark.createDataFrame([("t", "u", None, None, None, {"a": "b"}, False)], schemas.THREAD)
    back = schemas.from_dict(schemas.to_dict(df), schemas.THREAD)
    assert back.collect() == df.collect()
    m = spark.createDataFrame([({"k": "v", "n": None},)], "m map<string,string>").select(schemas.nested_metadata(schemas.flat_metadata(F.col("m"))).alias("m")).first().m
    assert m == {"k": "v"}
    spark.createDataFrame([], schemas.MESSAGE)
    spark.createDataFrame([], schemas.TRACE)
