"""Messages in thread order, without gathering a thread in one task.

Rows are range-partitioned and sorted by (conversation, created_at, role
rank, id), so that a conversation with any share of all rows is spread over
as many tasks as it needs. A streaming pass over each sorted partition sees
neighbours; what crosses a partition border is settled on one small row per
conversation and partition. Re-deliveries of a message are neighbours in
this order and count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm.components import connected_components

#: Names of the roles, and their rank where created_at is equal.
RANK = {"system": 0, "user": 1, "assistant": 2}
ORDER = ["conv", "created_at", "rank", "id"]


def squeeze(c: str | Column) -> Column:
    """Lower case without outer spaces of any kind."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def blank(c: str | Column) -> Column:
    """Null or without any letter or digit."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | ~c.rlike(r"[\p{L}\p{Nd}]")


def role_of(aliases: DataFrame, most: int = 1000) -> Callable[[str], Column]:
    """A lookup of role spellings. aliases (alias, role) may have at most `most` rows, else this raises."""
    rows = aliases.where("alias is not null and role is not null").select(squeeze("alias").alias("a"), squeeze("role").alias("r")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} role aliases")
    if not rows:
        return lambda c: F.lit(None).cast("string")
    table = F.create_map([F.lit(x) for r in sorted(rows) for x in (r.a, r.r)])
    return lambda c: F.element_at(table, squeeze(c))


def link_rows(messages: DataFrame) -> DataFrame:
    """(id, thread_id, other): each message with the message it replies to or quotes, from its JSON metadata."""
    return messages.select(
        "id", "thread_id",
        F.explode(F.array(F.get_json_object("metadata", "$.reply_to"), F.get_json_object("metadata", "$.quote_of"))).alias("other"),
    ).where("other is not null")


def conversations_of(messages: DataFrame) -> DataFrame | None:
    """Conversations of the messages without thread_id: (id, conv), or None where all have one.

    A message with a thread_id enters already contracted to its thread, so
    that only links with an unidentified end are iterated; a message that is
    linked to but missing still holds those together that name it. A component
    takes the least of its threads as its name, else `message:` and its least id.
    """
    lost = messages.where("thread_id is null and id is not null").select("id").distinct()
    if lost.isEmpty():
        return None
    node = lambda t, i: F.when(F.col(t).isNotNull(), F.concat(F.lit("a"), F.col(t))).otherwise(F.concat(F.lit("b"), F.col(i)))
    ends = messages.where("id is not null").groupBy("id").agg(F.min("thread_id").alias("other_thread"))
    links = link_rows(messages).join(ends.withColumnRenamed("id", "other"), "other", "left")
    edges = links.where("thread_id is null or other_thread is null").select(node("thread_id", "id").alias("u"), node("other_thread", "other").alias("v"))
    labels = connected_components(edges)
    name = F.coalesce("component", F.concat(F.lit("b"), F.col("id")))
    return lost.join(labels, F.concat(F.lit("b"), F.col("id")) == F.col("node"), "left").select(
        "id", F.when(name.startswith("a"), F.substring(name, 2, 1 << 30)).otherwise(F.concat(F.lit("message:"), F.substring(name, 2, 1 << 30))).alias("conv")
    )


def in_order(messages: DataFrame, role: Callable[[str], Column], extra: list[Column], keep: Column | None = None) -> DataFrame:
    """Rows (conv, created_at, rank, id, *extra) that `keep` holds for, sorted within range partitions; links lead through all rows."""
    found = conversations_of(messages)
    if found is not None:
        messages = messages.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").withColumn("conv", F.coalesce("thread_id", "conv")).drop("_id")
    else:
        messages = messages.withColumn("conv", F.col("thread_id"))
    if keep is not None:
        messages = messages.where(keep)
    rows = messages.where("conv is not null").withColumn("_role", role("role"))
    rank = F.coalesce(*[F.when(F.col("_role") == k, v) for k, v in RANK.items()], F.lit(3)).cast("tinyint")
    rows = rows.select("conv", "created_at", rank.alias("rank"), "id", *extra)
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def fresh(batch: pa.RecordBatch, last: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Which rows are not a re-delivery of the row before; the key of the last row."""
    n = batch.num_rows
    keep = np.ones(n, bool)
    same = np.ones(max(n - 1, 0), bool)
    for k in ("conv", "id"):
        a = batch.column(k)
        same &= pc.fill_null(pc.equal(a[1:], a[:-1]), False).to_numpy(zero_copy_only=False).astype(bool)
    keep[1:] = ~same
    ends = lambda i: (batch.column("conv")[i].as_py(), batch.column("id")[i].as_py())
    if last is not None and last[1] is not None and ends(0) == last:
        keep[0] = False
    return keep, ends(n - 1)


def codes(a: pa.Array) -> np.ndarray:
    """Change marks: True where a value differs from the one before; the first is True."""
    out = np.ones(len(a), bool)
    out[1:] = pc.not_equal(a[1:], a[:-1]).to_numpy(zero_copy_only=False)
    return out


SEGMENT = "conv string, pid int, n int, first_rank tinyint, first_good boolean, last_rank tinyint, any_text boolean, bad boolean, twice boolean, open boolean, turns int"


def _merged(a: dict, b: dict) -> dict:
    if not a["turns"] or not b["turns"]:
        head, tail = (a, b) if a["turns"] else (b, b)
        ends = {k: head[k] for k in ("first_rank", "first_good", "last_rank")}
        return ends | {"conv": a["conv"], "n": a["n"] + b["n"], "turns": a["turns"] + b["turns"]} | {k: a[k] or b[k] for k in ("any_text", "bad", "twice", "open")}
    return {
        "conv": a["conv"], "n": a["n"] + b["n"], "turns": a["turns"] + b["turns"],
        "first_rank": a["first_rank"], "first_good": a["first_good"], "last_rank": b["last_rank"],
        "any_text": a["any_text"] or b["any_text"], "bad": a["bad"] or b["bad"],
        "twice": a["twice"] or b["twice"] or (a["last_rank"] == b["first_rank"] == 2),
        "open": a["open"] or b["open"] or (a["last_rank"] == 1 and not b["first_good"]),
    }


def segments(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation and partition: what its turns there are like.

    `open` tells of a user turn within that no non-blank assistant turn
    follows; a user turn that ends the segment is left to the merge.
    """
    pid, last, held = TaskContext.get().partitionId(), None, None
    for batch in rows:
        if not batch.num_rows:
            continue
        keep, last = fresh(batch, last)
        batch = batch.filter(pa.array(keep))
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(codes(batch.column("conv")))
        ends = np.append(starts[1:], batch.num_rows)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        text = ~batch.column("blank").to_numpy(zero_copy_only=False).astype(bool)
        dated = pc.is_valid(batch.column("created_at")).to_numpy(zero_copy_only=False).astype(bool)
        bad = (rank == 3) | (~dated & (rank > 0))
        says = text & (rank > 0)
        convs, out = batch.column("conv").take(pa.array(starts)).to_pylist(), []
        for conv, s, e in zip(convs, starts, ends):
            r = rank[s:e]
            at = np.flatnonzero((r == 1) | (r == 2))
            t = r[at]
            good = (t == 2) & text[s:e][at]
            seg = {"conv": conv, "n": int(e - s), "turns": len(t), "any_text": bool(says[s:e].any()), "bad": bool(bad[s:e].any()), "twice": bool(((t[1:] == 2) & (t[:-1] == 2)).any()), "open": bool(((t[:-1] == 1) & ~good[1:]).any())}
            seg |= {"first_rank": int(t[0]), "first_good": bool(good[0]), "last_rank": int(t[-1])} if len(t) else {"first_rank": None, "first_good": None, "last_rank": None}
            if held and held["conv"] == conv:
                held = _merged(held, seg)
            else:
                if held:
                    out.append(held)
                held = seg
        if out:
            yield _table(out, pid)
    if held:
        yield _table([held], pid)


def _table(out: list[dict], pid: int) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "tinyint": pa.int8(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in SEGMENT.split(", ")]
    return pa.RecordBatch.from_pydict({k: pa.array([pid if k == "pid" else x[k] for x in out], kinds[t]) for k, t in fields})
