"""Problem 8: texts packed into containers of fixed capacity, in controlled mixture.

Deficit round-robin over the source queues hands out windows: each source
gets its share of a window's tokens, and what it was served too much or too
little is carried to the next window. With the queue's prefix sums this needs
no serial pass: the item that starts at token c of a queue whose quota is q
belongs to window floor(c / q), whatever partition it is in. A window is
bounded, so it is packed in one task, best fit by decreasing size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.tokens import Tokenizer, document_tokens, prefix_sums


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item: decreasing sizes into the fullest container with room."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: list[tuple[int, int]] = []
    out, made = [0] * len(sizes), 0
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            left, no = capacity, made
            made += 1
        else:
            left, no = room.pop(at)
        out[i] = no
        if left > sizes[i]:
            insort(room, (left - sizes[i], no))
    return out


_PACKED = "container string, capacity_tokens int, container_id string, window_no bigint, source string, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"


def _pack_window() -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("mix", "ascending"), ("doc_id", "ascending")])
        name, window, capacity = (t.column(k)[0].as_py() for k in ("container", "window_no", "capacity_tokens"))
        no = best_fit(t.column("n_tokens").to_pylist(), capacity)
        ids = pa.array([f"{name}-{window}-{k}" for k in no], pa.string())
        return pa.table([t.column("container"), t.column("capacity_tokens"), ids, t.column("window_no"), *(t.column(k) for k in ("source", "doc_id", "piece_no", "start_token", "n_tokens"))], names=[f.split()[0] for f in _PACKED.split(", ")])

    return run


def packed(documents: DataFrame, sizes: DataFrame, window: int = 256, seed: int = 29, most: int = 64, tokenizer: Tokenizer = Tokenizer(), targets: DataFrame | None = None) -> DataFrame:
    """Every document in containers of every size of `sizes`.

    Rows (container, capacity_tokens, container_id, window_no, source, doc_id,
    piece_no, start_token, n_tokens). A document is split only if it exceeds
    the capacity: whole pieces of it fill containers of their own (window_no
    null) and the rest is packed like any other item. `window` is the number
    of containers in a window. Each source has the share of a window's tokens
    that `targets` (source, target_share) gives it, or without them, or where
    they leave it out, its own share of all tokens; what of a queue outlasts
    the others fills the last windows alone, as nothing is dropped. Null texts and texts without tokens are left
    out, repeated doc_ids count once, sizes without a positive capacity are
    ignored; more than `most` sizes raise. Empty tables give an empty result.
    """
    kinds = sizes.where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    if kinds.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} container sizes")
    counted = document_tokens(documents, tokenizer)
    each = counted.crossJoin(F.broadcast(kinds)).withColumn("whole", F.floor(F.col("n_tokens") / F.col("capacity_tokens")).cast("int"))
    cap = F.col("capacity_tokens").cast("bigint")
    # A document of just the capacity is an item, not a split.
    each = each.withColumn("whole", F.when(F.col("n_tokens") <= cap, 0).otherwise(F.col("whole")))
    full = each.where("whole > 0").select("container", "capacity_tokens", "source", "doc_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece_no"))
    full = full.select("container", "capacity_tokens", F.concat_ws("-", "container", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")).alias("container_id"), F.lit(None).cast("bigint").alias("window_no"), "source", "doc_id", "piece_no", (F.col("piece_no") * cap).alias("start_token"), cap.alias("n_tokens"))
    start = F.col("whole") * cap
    items = each.select("container", "capacity_tokens", "source", "doc_id", F.col("whole").alias("piece_no"), start.alias("start_token"), (F.col("n_tokens") - start).alias("n_tokens"), F.xxhash64("doc_id", F.lit(seed)).alias("mix")).where("n_tokens > 0")
    items = items.withColumn("queue", F.concat_ws("\u0001", "container", "source"))
    queued = prefix_sums(items, "queue", "n_tokens", "mix", "doc_id")
    share = items.groupBy("container", "source").agg(F.sum("n_tokens").alias("own"))
    total = share.groupBy("container").agg(F.sum("own").alias("all_tokens"))
    share = share.join(F.broadcast(total), "container").withColumn("part", F.col("own") / F.col("all_tokens"))
    if targets is not None:
        aims = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"))
        share = share.join(aims, "source", "left").withColumn("part", F.coalesce("target_share", "part")).drop("target_share")
        sums = share.groupBy("container").agg(F.sum("part").alias("_sum"))
        share = share.join(F.broadcast(sums), "container").withColumn("part", F.col("part") / F.col("_sum")).drop("_sum")
    # A window's quota of a source: its part of the tokens of `window` containers.
    quota = window * F.col("capacity_tokens") * F.col("part")
    placed = queued.join(share, ["container", "source"]).withColumn("window_no", F.floor(F.col("before") / quota))
    placed = placed.select("container", "capacity_tokens", "window_no", "source", "doc_id", "piece_no", "start_token", "n_tokens", "mix")
    return placed.groupBy("container", "window_no").applyInArrow(_pack_window(), _PACKED).unionByName(full)


def fill_report(rows: DataFrame) -> DataFrame:
    """(container, capacity_tokens, items, containers, tokens, fill) of packed rows."""
    used = rows.groupBy("container", "capacity_tokens", "container_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    out = used.groupBy("container", "capacity_tokens").agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
