"""The folder all executors share, and tables written there to cut lineage.

``spark.checkpoint.dir`` names the folder. It is read from the session; only
where it is unset and the master is local a temporary folder is made. A table
written with :func:`materialise` survives the loss of any executor. It stays
until it is released, its :func:`scope` ends, or :func:`sweep` finds it old,
as the frames that a query returns read it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UNION = "spark.sql.unionOutputPartitioning"


def shared_dir(spark: SparkSession) -> str:
    """Return the shared folder of the session; raise on a cluster without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="skerry-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, deleted with the scope it was asked for in."""
    path = f"{shared_dir(spark)}/skerry/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Everything written to the shared folder inside is deleted at the end: read, or write elsewhere, what is wanted before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def held(spark: SparkSession) -> list[str]:
    """The tables that lie in the shared folder."""
    p, fs = _fs(spark, f"{shared_dir(spark)}/skerry")
    return sorted(str(x.getPath()) for x in fs.listStatus(p)) if fs.exists(p) else []


def sweep(spark: SparkSession, hours: float = 48) -> int:
    """Delete what jobs that ended without their scope left in the shared folder, unchanged for so long; how many tables."""
    p, fs = _fs(spark, f"{shared_dir(spark)}/skerry")
    if not fs.exists(p):
        return 0
    old = [str(x.getPath()) for x in fs.listStatus(p) if x.getModificationTime() < (time.time() - 3600 * hours) * 1000]
    for path in old:
        _delete(spark, path)
    return len(old)


def materialise(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df to the shared folder and return a scan of it, with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, label)
    # What the write shuffles is of no use afterwards and goes at once.
    keep = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, keep)
    return spark.read.schema(df.schema).parquet(path)


def stacked(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """The rows of all frames by the names of their columns.

    Spark 4.1 plans a union of frames hashed alike as hashed too, and joins and
    aggregates leave their exchange out; when adaptive execution then changes
    one frame's partitions, the union no longer is, and the job fails (can't
    zip RDDs) or keys meet in no task. The session is told not to plan so.
    """
    first.sparkSession.conf.set(_UNION, "false")
    return reduce(DataFrame.unionByName, rest, first)


def release(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialise`."""
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/skerry/" in root:
            _delete(df.sparkSession, root)
