"""Problem 1: conversations rebuilt from message rows, ordered and validated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.turns import SEGMENT, blank, codes, fresh, in_order, role_of, segments
from skerry.plans.shared import materialise


def _summaries(messages: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per conversation: (conv, turns, any_text, bad, assistant_first, twice, open)."""
    rows = in_order(messages, role_of(aliases), [blank("content").alias("blank")])
    parts = rows.mapInArrow(segments, SEGMENT)
    near = Window.partitionBy("conv").orderBy("pid")
    before, after = near.rowsBetween(Window.unboundedPreceding, -1), near.rowsBetween(1, Window.unboundedFollowing)
    met = parts.select(
        "conv", "turns", "any_text", "bad",
        F.last("last_rank", ignorenulls=True).over(before).alias("prev"),
        F.first("first_good", ignorenulls=True).over(after).alias("next_good"),
        "first_rank", "last_rank", "twice", "open",
    )
    on = lambda c: F.max(F.coalesce(c, F.lit(False)))
    return met.groupBy("conv").agg(
        F.sum("turns").alias("turns"), on(F.col("any_text")).alias("any_text"), on(F.col("bad")).alias("bad"),
        on(F.col("prev").isNull() & (F.col("first_rank") == 2)).alias("assistant_first"),
        on(F.col("twice") | ((F.col("prev") == 2) & (F.col("first_rank") == 2))).alias("twice"),
        on(F.col("open") | ((F.col("last_rank") == 1) & ~F.coalesce("next_good", F.lit(False)))).alias("open"),
    )


def _fault() -> Column:
    return (
        F.when((F.coalesce("turns", F.lit(0)) == 0) | ~F.coalesce("any_text", F.lit(False)), "empty")
        .when(F.col("bad") | F.col("assistant_first") | F.col("twice"), "broken")
        .when(F.col("open"), "no_reply")
    )


def conversation_faults(messages: DataFrame, threads: DataFrame, aliases: DataFrame) -> DataFrame:
    """The first fault of each thread of `threads` that has one: (thread_id, fault).

    Messages are ordered as in :mod:`skerry.llm.turns`, messages without
    thread_id joining the conversation that reply and quote links lead to.
    Null or unlisted roles and turns without created_at make a thread
    `broken`; a thread without messages is `empty`; re-deliveries and
    repeated thread rows count once; thread rows without id are left out.
    Empty tables give an empty result. Extra columns are ignored.
    """
    ids = threads.where("id is not null").select(F.col("id").alias("thread_id")).distinct()
    made = _summaries(messages, aliases)
    joined = ids.join(made, ids.thread_id == made.conv, "left")
    return joined.select("thread_id", _fault().alias("fault")).where("fault is not null")


def _numbered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The user and assistant rows, each with its place among its conversation's turns in this partition."""
    pid, last, conv, count = TaskContext.get().partitionId(), None, None, 0
    for batch in rows:
        if not batch.num_rows:
            continue
        keep, last = fresh(batch, last)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array(keep & ((rank == 1) | (rank == 2))))
        if not batch.num_rows:
            continue
        new = codes(batch.column("conv"))
        at = np.arange(batch.num_rows)
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        if batch.column("conv")[0].as_py() == conv:
            first = np.append(np.flatnonzero(new)[1:], batch.num_rows)[0]
            place[:first] += count
        conv, count = batch.column("conv")[-1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(place.astype(np.int64)), batch.column("rank"), batch.column("id"), batch.column("created_at"), batch.column("content")],
            names=["conv", "pid", "place", "rank", "id", "created_at", "content"],
        )


def rebuilt_conversations(messages: DataFrame, threads: DataFrame, aliases: DataFrame) -> DataFrame:
    """The turns of all sound threads: (thread_id, turn_no from 0, role, message_id, created_at, content).

    A conversation stays one row per turn, as one row per conversation would
    gather it in one task. Threads with a fault of
    :func:`conversation_faults` are left out; edge cases as there. Messages
    that only links hold together, without any thread_id, are a conversation
    named message:<id>.
    """
    role = role_of(aliases)
    rows = in_order(messages, role, [F.col("content")]).mapInArrow(_numbered, "conv string, pid int, place bigint, rank tinyint, id string, created_at timestamp, content string")
    rows = materialise(rows, "turns")  # read twice below, and partition numbers must agree
    made = _summaries(messages, aliases)
    sound = threads.where("id is not null").select(F.col("id").alias("thread_id")).distinct().join(made, F.col("thread_id") == F.col("conv")).where(_fault().isNull()).select("thread_id")
    # Conversations without any thread_id are named by a message; ids that look like that are not theirs.
    named = F.col("conv").startswith("message:")
    ids = messages.where(F.col("thread_id").startswith("message:")).select(F.col("thread_id").alias("conv"))
    alone = made.where(named & _fault().isNull()).join(ids, "conv", "left_anti").select(F.col("conv").alias("thread_id"))
    sound = sound.unionByName(alone).distinct()
    turns = rows.join(sound, rows.conv == sound.thread_id)
    # The place within the partition becomes the place in the conversation; only one row per conversation and partition is summed.
    sizes = rows.groupBy("conv", "pid").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("conv").alias("_conv"), F.col("pid").alias("_pid"), F.sum("n").over(before).alias("shift")).where("shift is not null")
    out = turns.join(shift, (turns.conv == shift._conv) & (turns.pid == shift._pid), "left")
    name = F.when(F.col("rank") == 1, "user").otherwise("assistant")
    return out.select("thread_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("turn_no"), name.alias("role"), F.col("id").alias("message_id"), "created_at", "content")
