"""Audit log reads over (event_id, ts, user_id, event_type, props) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_audit(events: DataFrame) -> DataFrame:
    """Event rows in the audit log's shape, with the day they are partitioned by."""
    return events.select("event_id", F.col("ts").alias("timestamp"), F.to_date("ts").alias("date"), "user_id", "event_type", (F.col("event_type") != "error").alias("success"), F.col("props").alias("details"))


def of_day(log: DataFrame, day: str, event_type: str | None = None, user_id: int | None = None) -> DataFrame:
    out = log.where(F.col("date") == F.lit(day).cast("date"))
    out = out if event_type is None else out.where(F.col("event_type") == event_type)
    return out if user_id is None else out.where(F.col("user_id") == user_id)


def recent(log: DataFrame, limit: int = 100, event_type: str | None = None, buffer: int = 1000) -> DataFrame:
    """The last `limit` of the last `buffer` events, oldest first."""
    last = log.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(buffer)
    last = last if event_type is None else last.where(F.col("event_type") == event_type)
    return last.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(limit).orderBy("timestamp", "event_id")


def retained(log: DataFrame, cutoff: Column) -> DataFrame:
    """Events of days not before the cutoff: a partition filter where the log is partitioned by date."""
    return log.where(F.col("date") >= cutoff)


def query_hash(query: str | Column) -> Column:
    """STRUCT<hash, length>: what the log keeps of a query."""
    q = F.col(query) if isinstance(query, str) else query
    return F.struct(F.substring(F.sha2(q, 256), 1, 16).alias("hash"), F.length(q).alias("length"))


def trace_id(thread_id: Column, user_id: Column) -> Column:
    return F.md5(F.coalesce(thread_id, user_id))
