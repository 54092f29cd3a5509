"""Problem 9: sources mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.tokens import Tokenizer, document_tokens, prefix_sums
from skerry.plans.shared import materialise


def _budgets(counted: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """(source, target_share, max_repeats, supply, budget); one row per source of targets.

    Without `total`, the mixture is as large as the scarcest source allows:
    the least supply * max_repeats / share.
    """
    aims = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    supply = counted.groupBy("source").agg(F.sum("n_tokens").alias("supply"))
    rows = aims.join(supply, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0)))
    most = F.floor(F.col("supply") * F.col("max_repeats") / F.col("target_share"))
    limit = rows.agg(F.min(F.when(F.col("supply") > 0, most)).alias("limit"))
    wanted = F.col("limit") if total is None else F.least("limit", F.lit(total))
    return rows.crossJoin(F.broadcast(limit)).withColumn("budget", F.when(F.col("supply") > 0, F.least(F.floor(wanted * F.col("target_share")), F.col("supply") * F.col("max_repeats"))).otherwise(F.lit(0)).cast("bigint")).drop("limit")


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: Tokenizer = Tokenizer()) -> tuple[DataFrame, DataFrame]:
    """The mixture's records and its report.

    Records (source, epoch from 0, mix_key, doc_id, n_tokens, tokens_used):
    whole epochs repeat every document of the source, the last one takes
    documents in the order of hash-random keys up to the exact budget, so
    that the document at the cut gives only its first tokens_used tokens.
    Sorting by mix_key shuffles the mixture. Report (source, target_share,
    max_repeats, supply, budget, tokens, share, repeats): one row per source
    of targets. Sources without tokens get nothing and are reported with 0;
    sources outside targets are not used; empty tables give empty results.
    """
    counted = document_tokens(documents, tokenizer)
    budgets = materialise(_budgets(counted, targets, total), "budgets")
    keyed = counted.join(budgets.where("budget > 0").select("source"), "source", "left_semi")
    keyed = keyed.select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("mix"))
    placed = prefix_sums(keyed, "source", "n_tokens", "mix", "doc_id").join(budgets.select("source", "supply", "budget"), "source")
    full = F.floor(F.col("budget") / F.col("supply")).cast("int")
    rest = F.col("budget") - full * F.col("supply")
    cut = F.greatest(F.least(rest - F.col("before"), F.col("n_tokens")), F.lit(0))
    whole = F.transform(F.sequence(F.lit(1), F.greatest(full, F.lit(1))), lambda e: F.struct((e - 1).alias("epoch"), F.col("n_tokens").alias("used")))
    turns = F.concat(F.when(full > 0, whole).otherwise(F.slice(whole, 1, 0)), F.array(F.struct(full.alias("epoch"), cut.alias("used"))))
    rows = placed.select("source", "doc_id", "n_tokens", F.explode(turns).alias("x")).where("x.used > 0")
    records = rows.select("source", F.col("x.epoch").alias("epoch"), F.xxhash64("doc_id", "x.epoch", F.lit(seed + 1)).alias("mix_key"), "doc_id", "n_tokens", F.col("x.used").alias("tokens_used"))
    got = records.groupBy("source").agg(F.sum("tokens_used").alias("tokens"), (F.max("epoch") + 1).alias("repeats"))
    all_ = got.agg(F.sum("tokens").alias("all_tokens"))
    report = budgets.join(got, "source", "left").crossJoin(F.broadcast(all_)).select(
        "source", "target_share", "max_repeats", "supply", "budget",
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
    )
    return records, report
