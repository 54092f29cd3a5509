"""The p-queries: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import conversations, language, mixing, near, neighbours, packing, pairs, pii, scans, splitting, sql
from skerry.operators.order import numbered
from skerry.plans.session import table
from skerry.plans.shared import materialise

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversation_faults(table(spark, d, "messages"), table(spark, d, "threads"), table(spark, d, "role_aliases"))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuilt_conversations(table(spark, d, "messages"), table(spark, d, "threads"), table(spark, d, "role_aliases"))


def p1_linked(spark: SparkSession, d: str) -> DataFrame:
    """The conversations with thread_id taken from every message but its thread's first, which a reply link to the message before replaces: found again by the stars."""
    m = table(spark, d, "messages").where("thread_id is not null and id is not null")
    once = m.groupBy("id").agg(*(F.min(c).alias(c) for c in ("thread_id", "role", "content", "created_at")))
    before = numbered(once, ["created_at", "id"], "place", group="thread_id")
    prev = before.select("thread_id", (F.col("place") + 1).alias("place"), F.col("id").alias("reply_to"))
    rows = before.join(prev, ["thread_id", "place"], "left")
    rows = rows.select("id", F.when(F.col("place") == 0, F.col("thread_id")).alias("thread_id"), "role", "content", F.to_json(F.struct("reply_to")).alias("metadata"), "created_at")
    return conversations.rebuilt_conversations(materialise(rows, "linked"), table(spark, d, "threads"), table(spark, d, "role_aliases"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(pii.records_of(table(spark, d, "messages"), table(spark, d, "chunks")), table(spark, d, "person_names"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_pii(pii.records_of(table(spark, d, "messages"), table(spark, d, "chunks")), table(spark, d, "person_names"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_ids(table(spark, d, "chunks"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "chunk_vectors"))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, d, "chunk_vectors"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(table(spark, d, "chunks"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(table(spark, d, "chunks"), table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_defects(table(spark, d, "chunks"), table(spark, d, "documents"))


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_paragraphs(table(spark, d, "chunks"), table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pair_defects(table(spark, d, "messages"), table(spark, d, "role_aliases"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.packed(table(spark, d, "documents"), table(spark, d, "pack_sizes")))


def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The containers with the sources in the shares of mix_targets."""
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_sizes"), targets=table(spark, d, "mix_targets"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_faults(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.language_segments(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": sql.P1_FOUND, "p1_conversations": sql.P1_CONVERSATIONS, "p1_linked": sql.P1_LINKED, "p3_found": sql.P3_FOUND}
