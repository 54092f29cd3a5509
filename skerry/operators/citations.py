"""Citations: built from hits, merged, formatted and shortened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import excerpt


def build(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(qid, rank, source_file, excerpt, page_number, section, chunk_id, relevance_score) of ranked hits."""
    t = texts.select("id", "source_file", "content", "page_number", "section_header")
    return hits.join(t, "id").select("qid", "rank", "source_file", excerpt("content").alias("excerpt"), "page_number", F.col("section_header").alias("section"), F.col("id").alias("chunk_id"), F.round("score", 6).alias("relevance_score"))


def merge(citations: DataFrame, key: str, place: str) -> DataFrame:
    """Citations of a key with the same source and page as one: excerpts joined and shortened again, the greatest non-zero score, the first section and chunk.

    A single one is kept as it is. Sorted within a key by score, then place:
    the column merged_no counts from 0.
    """
    g = citations.groupBy(key, "source_file", "page_number").agg(
        F.count("*").alias("n"), F.min(place).alias("first_place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, "excerpt"))), lambda s: s["excerpt"]), " ").alias("joined"),
        F.max(F.nullif("relevance_score", F.lit(0.0))).alias("score"), F.max("relevance_score").alias("only"),
        F.min_by("section", place).alias("section"), F.min_by("chunk_id", place).alias("chunk_id"),
    )
    g = g.withColumns({"excerpt": F.when(F.col("n") == 1, F.col("joined")).otherwise(excerpt("joined")), "relevance_score": F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("score"))})
    order = Window.partitionBy(key).orderBy(F.desc(F.coalesce("relevance_score", F.lit(0.0))), "first_place")
    return g.withColumn("merged_no", F.row_number().over(order) - 1).select(key, "merged_no", "source_file", "page_number", "excerpt", "section", "chunk_id", "relevance_score")


def reference(source: Column, page: Column, section: Column) -> Column:
    return F.concat_ws(", ", source, F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("Page "), page.cast("string"))), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section: "), section)))


def formatted(citations: Column, style: str) -> Column:
    """An ARRAY<STRUCT> of citations as text: superscript, footnote or inline."""
    ref = lambda s: reference(s["source_file"], s["page_number"], s["section"])
    if style == "superscript":
        return F.array_join(F.transform(citations, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), ref(s))), "\n")
    if style == "footnote":
        return F.concat(F.lit("Sources:\n"), F.array_join(F.transform(citations, lambda s, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), ref(s))), "\n"))
    if style == "inline":
        return F.array_join(F.transform(citations, lambda s: F.concat(F.lit("["), ref(s), F.lit("]"))), " ")
    raise ValueError(f"unknown style {style}")


def sources_shown(citations: DataFrame, key: str, place: str, most: int = 3, chars: int = 120) -> DataFrame:
    """The first citation of each source and page, `most` per key, excerpts shortened."""
    page = F.coalesce("page_number", F.lit(0))
    first = Window.partitionBy(key, "source_file", page).orderBy(place)
    order = Window.partitionBy(key).orderBy(place)
    one = citations.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    one = one.withColumn("shown_no", F.row_number().over(order) - 1).where(F.col("shown_no") < most)
    return one.select(key, "shown_no", "source_file", "page_number", F.substring("excerpt", 1, chars).alias("excerpt"))


def distinct_sources(citations: DataFrame, key: str) -> DataFrame:
    return citations.groupBy(key).agg(F.array_sort(F.collect_set("source_file")).alias("sources"))
