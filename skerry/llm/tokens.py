"""Token counts of a public tokenizer, and distributed prefix sums over them."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.turns import codes
from skerry.plans.shared import materialise


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE of ranks; every executor must be able to read `path`."""

    path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_loaded: dict[Tokenizer, object] = {}


def encoding(t: Tokenizer):
    if t not in _loaded:
        import tiktoken

        with open(t.path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[t] = tiktoken.Encoding("own", pat_str=t.pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[t]


_CUT = re.compile(r"(?<=\S)(?= \S)")


def count_tokens(text: str, enc, slice_: int = 200_000) -> int:
    """Tokens of a whole text; a long one is encoded in slices cut before a lone space, where no token can cross; without one the rest stays whole."""
    n, at = 0, 0
    while len(text) - at > slice_:
        m = _CUT.search(text, at + slice_)
        if m is None:
            break
        n += len(enc.encode_ordinary(text[at : m.start()]))
        at = m.start()
    return n + len(enc.encode_ordinary(text[at:]))


def _counted(t: Tokenizer) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(t)
        for b in batches:
            n = [count_tokens(x, enc) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def document_tokens(documents: DataFrame, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """(doc_id, source, n_tokens), written once; null ids and texts are left out, a null source is `(none)`.

    Texts without tokens are left out; a repeated doc_id counts once, with
    the greatest (n_tokens, source).
    """
    rows = documents.select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), "text").where("doc_id is not null and text is not null")
    counted = rows.mapInArrow(_counted(tokenizer), "doc_id bigint, source string, n_tokens bigint").where("n_tokens > 0")
    once = counted.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("x")).select("doc_id", "x.source", "x.n_tokens")
    return materialise(once, "tokens")


def _running(fields: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, group, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("value").to_numpy()
            starts = np.flatnonzero(codes(b.column("group")))
            cum = np.cumsum(v) - v
            base = np.repeat(cum[starts], np.diff(np.append(starts, len(v))))
            local = cum - base
            if b.column("group")[0].as_py() == group:
                first = starts[1] if len(starts) > 1 else len(v)
                local[:first] += total
            group, total = b.column("group")[-1].as_py(), int(local[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in fields), pa.array(np.full(len(v), pid, np.int32)), pa.array(local.astype(np.int64))], names=[*fields, "pid", "local"])

    return run


def prefix_sums(rows: DataFrame, group: str, value: str, key: str, tie: str) -> DataFrame:
    """rows with `before`: the sum of `value` over the rows of the same group that come first in (key, tie) order.

    A range sort spreads a group over as many tasks as it needs; the sums of
    a group's parts are added up on one small row per group and partition.
    group must be a string and not null, value a BIGINT.
    """
    base = rows.withColumns({"group": F.col(group), "value": F.col(value)})
    fields = base.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema) + ", pid int, local bigint"
    ordered = base.repartitionByRange("group", key, tie).sortWithinPartitions("group", key, tie)
    local = materialise(ordered.mapInArrow(_running(fields), schema), "sums")
    part = Window.partitionBy("group").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    shift = local.groupBy("group", "pid").agg(F.sum("value").alias("n")).select("group", "pid", F.coalesce(F.sum("n").over(part), F.lit(0)).alias("shift"))
    return local.join(shift, ["group", "pid"]).withColumn("before", F.col("local") + F.col("shift")).drop("group", "pid", "local", "shift", "value")
