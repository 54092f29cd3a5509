"""Continuous ingestion: chunks, de-duplication and audit counts as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import tokens
from skerry.operators.chunking import explode_sentence_chunks
from skerry.plans.shared import new_path


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream; new files are new rows."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder) if not _is_dir(spark, f"{folder}/{name}.parquet") else spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote, from the shared folder."""
    spark = stream.sparkSession
    root = new_path(spark, "stream")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        def put(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out")

        q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def chunks(documents: DataFrame) -> DataFrame:
    """Sentence chunks of arriving documents; stateless."""
    return explode_sentence_chunks(documents.where("text is not null"), "doc_id", "text")


def first_uploads(documents: DataFrame, late: str | None = None) -> DataFrame:
    """Arriving documents whose (user_id, file_hash) is new.

    With `late`, an interval, state is kept only so long after created_at.
    """
    d = documents.where("file_hash is not null and user_id is not null").withColumn("file_hash", F.lower("file_hash"))
    key = ["user_id", "file_hash"]
    return d.dropDuplicates(key) if late is None else d.withWatermark("created_at", late).dropDuplicatesWithinWatermark(key)


def hourly_events(events: DataFrame) -> DataFrame:
    """Events per hour and type; complete once the watermark has passed."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def rotated_audit(events: DataFrame, folder: str, state: str) -> None:
    """Append arriving events to a log with a folder for each day, as far as they are there."""
    e = events.withColumn("date", F.to_date("ts"))
    e.writeStream.format("json").partitionBy("date").option("path", folder).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def recent_events(events: DataFrame, buffer: int = 1000) -> DataFrame:
    """The last `buffer` of the arriving events, kept from batch to batch: each batch is cut to its own last ones before it meets the buffer."""
    spark = events.sparkSession
    root, order = new_path(spark, "recent"), [F.desc("ts"), F.desc("event_id")]

    def put(batch: DataFrame, n: int) -> None:
        last = batch.orderBy(*order).limit(buffer)
        if n:
            last = last.unionByName(spark.read.schema(batch.schema).parquet(f"{root}/{n - 1}")).dropDuplicates(["event_id"]).orderBy(*order).limit(buffer)
        last.write.mode("overwrite").parquet(f"{root}/{n}")
        done.append(n)

    done: list[int] = []
    events.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/{done[-1]}") if done else spark.createDataFrame([], events.schema)


def corpus_statistics(documents: DataFrame) -> DataFrame:
    """(term, df) of the arriving documents, each batch's counts beside the earlier ones; they are added up when read."""
    spark = documents.sparkSession
    root = new_path(spark, "statistics")

    def put(batch: DataFrame, n: int) -> None:
        terms = batch.select(F.explode(F.array_distinct(tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        terms.write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    documents.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("term string, df bigint, batch bigint").parquet(f"{root}/out").groupBy("term").agg(F.sum("df").alias("df"))


def expired_threads(threads: DataFrame, now: str, days: int) -> DataFrame:
    """Of arriving thread rows those soft-deleted threads whose time to live has passed at `now`."""
    old = F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} days")
    return threads.where(F.coalesce("deleted", F.lit(False)) & old)
