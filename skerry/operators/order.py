"""Row numbers over any number of rows without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.shared import materialise


def numbered(rows: DataFrame, order: list[str | Column], name: str, group: str | None = None) -> DataFrame:
    """rows with `name`: their place from 0 in the order, or in the order within their group.

    A range sort spreads the rows, however many one group has; places within
    a partition are made global by one small row per partition, and local to
    a group by the place of its first row. Rows must sort by group first if
    they are numbered within it.
    """
    by = ([F.col(group)] if group else []) + [F.col(c) if isinstance(c, str) else c for c in order]
    at = F.monotonically_increasing_id()
    placed = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at), "numbered")
    part = F.shiftright("_at", 33).alias("_part")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = placed.groupBy(part).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    out = placed.withColumn("_part", part).join(shift, "_part").withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_shift"))
    if group:
        first = out.groupBy(F.col(group).alias("_g")).agg(F.min(name).alias("_first"))
        out = out.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn(name, F.col(name) - F.col("_first")).drop("_g", "_first")
    return out.drop("_at", "_part", "_shift")


def few(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """rows marked for a broadcast, after a count has shown that there are at most so many; raises otherwise."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to broadcast; split them into batches")
    return F.broadcast(rows)
