"""The registry, threads and collections: reads, and changes as new states of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import strip
from skerry.operators.order import numbered
from skerry.operators.rules import thread_title
from skerry.plans.shared import stacked


def latest_threads(threads: DataFrame) -> DataFrame:
    """One row per thread id: the one updated last, of equal ones the one created last, then by title."""
    order = Window.partitionBy("id").orderBy(F.desc("updated_at"), F.desc("created_at"), F.desc_nulls_last("title"))
    return threads.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def role_names(aliases: DataFrame | None, most: int = 1000) -> Callable[[str | Column], Column]:
    """What a spelling of a role stands for: system, user, assistant, or null. aliases (alias, role) is counted; more than `most` raise."""
    known = {k: k for k in ("system", "user", "assistant")}
    if aliases is not None:
        rows = aliases.where("alias is not null and role is not null").select(F.lower(strip("alias")).alias("a"), F.lower(strip("role")).alias("r")).distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} role aliases")
        known = {r.a: r.r for r in sorted(rows)}
    names = F.create_map([F.lit(x) for kv in known.items() for x in kv]) if known else None
    return lambda c: F.lit(None).cast("string") if names is None else F.element_at(names, F.lower(strip(c)))


def distinct_messages(messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row per message id, re-deliveries counted once: (id, thread_id, role, content, created_at, citations, kind, turn).

    kind is what the role's spelling stands for; turn sorts a thread: at equal
    created_at system, user, assistant, others, then by id. Citations are
    those of the delivery received first that has any.
    """
    cites, first = F.col("citations"), F.col("received_at") if "received_at" in messages.columns else F.lit(0)
    one = messages.groupBy("id").agg(*(F.min(c).alias(c) for c in ("thread_id", "role", "content", "created_at")), F.min_by(cites, F.struct(cites.isNull().alias("n"), first.alias("r"), F.xxhash64(F.to_json(F.struct(cites))).alias("h"))).alias("citations"))
    one = one.withColumn("kind", role_names(aliases)("role"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ["system", "user", "assistant"])), F.col("kind")), F.lit(0)), F.lit(4))
    return one.withColumn("turn", F.struct("created_at", rank.cast("int").alias("rank"), "id"))


def find_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id): uploads whose user already has a file of the same hash; the first by created_at stays."""
    d = documents.where("file_hash is not null and user_id is not null").select("doc_id", "user_id", F.lower("file_hash").alias("h"), "created_at")
    first = d.groupBy("user_id", "h").agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("first_doc_id"))
    return d.join(first, ["user_id", "h"]).where("doc_id <> first_doc_id").select("doc_id", "first_doc_id")


def register(documents: DataFrame, uploads: DataFrame) -> DataFrame:
    """The registry with those uploads appended whose (user_id, file_hash) it does not hold yet; hashes are compared in lower case, the first upload of equal ones stays."""
    key = lambda df: df.withColumn("_h", F.lower("file_hash"))
    order = Window.partitionBy("user_id", "_h").orderBy("created_at", "doc_id")
    new = key(uploads).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    held = key(documents).select("user_id", "_h").distinct()
    return stacked(documents, new.join(held, ["user_id", "_h"], "left_anti").select(*documents.columns))


def insert_threads(threads: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """threads with new ones (id, user_id, title) appended; an id that exists already is left alone."""
    rows = new.dropDuplicates(["id"]).where("id is not null").join(threads.select("id").distinct(), "id", "left_anti")
    rows = rows.withColumns({"created_at": now, "updated_at": now, "deleted": F.lit(False)})
    return stacked(threads, rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(threads.schema[c].dataType).alias(c) for c in threads.columns]))


def insert_messages(threads: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, messages) with new messages appended and their threads touched: updated_at becomes the newest message's time, if later.

    Messages whose id is there already are re-deliveries and are not appended
    again; messages of unknown threads are left out.
    """
    rows = new.dropDuplicates(["id"]).join(messages.select("id").distinct(), "id", "left_anti").join(threads.select(F.col("id").alias("thread_id")).distinct(), "thread_id", "left_semi")
    last = rows.groupBy("thread_id").agg(F.max("created_at").alias("_last")).withColumnRenamed("thread_id", "id")
    touched = threads.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).select(*threads.columns)
    return touched, stacked(messages, rows.select(*messages.columns))


def update_chunk_counts(documents: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """chunk_count set to the number of distinct chunks, updated_at advanced where it changes."""
    n = chunks.groupBy("doc_id").agg(F.count_distinct("chunk_index").cast("int").alias("_n"))
    j = documents.join(n, "doc_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    changed = F.col("_n") != F.coalesce("chunk_count", F.lit(-1))
    return j.withColumns({"updated_at": F.when(changed, now).otherwise(F.col("updated_at")), "chunk_count": F.col("_n")}).drop("_n")


def delete(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """rows without those whose key is listed; keys may be repeated or null."""
    return rows.join(keys.select(on).where(F.col(on).isNotNull()), on, "left_anti")


def soft_delete(threads: DataFrame, which: Column, now: Column) -> DataFrame:
    hit = F.coalesce(which, F.lit(False))
    return threads.withColumns({"deleted": F.when(hit, True).otherwise(F.col("deleted")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def rename(threads: DataFrame, which: Column, title: str | Column, metadata: Column | None = None) -> DataFrame:
    """A new title and, if given, new metadata; updated_at does not advance."""
    hit = F.coalesce(which, F.lit(False))
    new = {"title": F.when(hit, F.lit(title) if isinstance(title, str) else title).otherwise(F.col("title"))}
    if metadata is not None:
        new["metadata"] = F.when(hit, metadata).otherwise(F.col("metadata"))
    return threads.withColumns(new)


def list_threads(threads: DataFrame, user: Column | None, most: int = 50, deleted: bool = False) -> DataFrame:
    t = latest_threads(threads)
    t = t if user is None else t.where(F.col("user_id") == user)
    t = t if deleted else t.where(~F.coalesce("deleted", F.lit(False)))
    return t.orderBy(F.desc("updated_at"), "id").limit(most)


def thread_messages(threads: DataFrame, messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Visible threads with their messages in order: (thread_id, message_no, role, content), one row per message."""
    t = latest_threads(threads).where(~F.coalesce("deleted", F.lit(False))).select(F.col("id").alias("thread_id"))
    m = distinct_messages(messages, aliases).join(t, "thread_id", "left_semi")
    return numbered(m, ["turn"], "message_no", group="thread_id").select("thread_id", "message_no", "role", "content")


def titles(threads: DataFrame, messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(thread_id, title): the given title, else one made of the first message, else a default."""
    first = distinct_messages(messages, aliases).where("content is not null").groupBy("thread_id").agg(F.min_by("content", "turn").alias("first"))
    t = latest_threads(threads).join(first.withColumnRenamed("thread_id", "id"), "id", "left")
    return t.select(F.col("id").alias("thread_id"), F.coalesce("title", thread_title("first"), F.lit("New Conversation")).alias("title"))


def summaries(threads: DataFrame, messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(thread_id, title, message_count, last_preview) of visible threads, with true counts."""
    m = distinct_messages(messages, aliases).groupBy("thread_id").agg(F.count("*").alias("n"), F.max_by("content", "turn").alias("last"))
    t = latest_threads(threads).where(~F.coalesce("deleted", F.lit(False))).join(m.withColumnRenamed("thread_id", "id"), "id", "left")
    preview = F.concat(F.substring("last", 1, 100), F.when(F.length("last") > 100, "...").otherwise(""))
    return t.select(F.col("id").alias("thread_id"), F.coalesce("title", F.lit("New Conversation")).alias("title"), F.coalesce("n", F.lit(0)).alias("message_count"), preview.alias("last_preview"))


def last_messages(messages: DataFrame, n: int, skip: int = 0, aliases: DataFrame | None = None) -> DataFrame:
    """(thread_id, from_end, role, content): the last n messages of each thread after leaving out `skip`; n <= 0 gives none.

    The window keeps only the first ranks of each task's rows (group limit),
    so a thread of any length costs n rows a task.
    """
    order = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    m = distinct_messages(messages, aliases).withColumn("from_end", F.row_number().over(order))
    return m.where((F.col("from_end") > skip) & (F.col("from_end") <= max(n, 0) + skip)).select("thread_id", "from_end", "role", "content")


def purge(threads: DataFrame, messages: DataFrame, before: Column) -> tuple[DataFrame, DataFrame]:
    """Threads and messages without the soft-deleted threads last updated before a time."""
    gone = latest_threads(threads).where(F.coalesce("deleted", F.lit(False)) & (F.col("updated_at") < before)).select(F.col("id").alias("thread_id"))
    return threads.join(gone.withColumnRenamed("thread_id", "id"), "id", "left_anti"), messages.join(gone, "thread_id", "left_anti")


def add_to_collection(links: DataFrame, new: DataFrame) -> DataFrame:
    """links with the pairs appended that it does not hold."""
    key = ["collection_id", "doc_id"]
    return stacked(links, new.dropDuplicates(key).join(links.select(*key), key, "left_anti").select(*links.columns))


def markdown_export(threads: DataFrame, messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(thread_id, message_no, markdown): the heading (message_no -1) and each message of visible threads as Markdown, in order.

    The parts of a thread are rows, so that a long thread is no single row;
    written sorted they make the file.
    """
    t = latest_threads(threads).where(~F.coalesce("deleted", F.lit(False)))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    head = F.concat(F.lit("# Conversation: "), F.coalesce("title", F.lit("Untitled")), F.lit("\n\n*Thread ID: "), F.col("id"), F.lit("*  \n*Created: "), F.coalesce(stamp("created_at"), F.lit("Unknown")), F.lit("*  \n\n"))
    heads = t.select(F.col("id").alias("thread_id"), F.lit(-1).cast("bigint").alias("message_no"), head.alias("markdown"))
    m = distinct_messages(messages, aliases).join(t.select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    who = F.when(F.col("kind") == "user", "User").otherwise("Assistant")
    source = F.transform("citations", lambda c: F.concat(F.lit("- **"), F.coalesce(c["source_file"], F.lit("Unknown")), F.lit("**"), F.when(F.coalesce(c["page_number"], F.lit(0)) != 0, F.concat(F.lit(" (Page "), c["page_number"].cast("string"), F.lit(")"))).otherwise(""), F.when(F.coalesce(c["section"], F.lit("")) != "", F.concat(F.lit(" - *"), c["section"], F.lit("*"))).otherwise(""), F.lit("\n")))
    sources = F.when((who == "Assistant") & (F.size("citations") > 0), F.concat(F.lit("### Sources\n\n"), F.array_join(source, ""), F.lit("\n"))).otherwise("")
    body = F.concat(F.lit("## "), who, F.lit(" ("), F.coalesce(stamp("created_at"), F.lit("")), F.lit(")\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n"), sources)
    return stacked(heads, numbered(m, ["turn"], "message_no", group="thread_id").select("thread_id", "message_no", body.alias("markdown")))


def sanitised_name(name: Column, content_hash: Column) -> Column:
    """Where a quarantined file goes: 16 characters of its hash and what follows the last underscore of its name."""
    return F.concat(F.substring(content_hash, 1, 16), F.lit("_"), F.element_at(F.split(name, "_"), -1))


def unique_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """files with `place`: the name, and where several files have it a counter before its extension from the second on."""
    at = numbered(files, [order], "_n", group=name)
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return at.withColumn("place", F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext))).drop("_n")


def expired_files(files: DataFrame, now: Column, days: int) -> DataFrame:
    """Scanned files (path, modificationTime) last changed more than `days` days ago: what a quarantine drops."""
    return files.where(F.col("modificationTime") < now - F.expr(f"interval {int(days)} days"))


def delete_documents(documents: DataFrame, chunks: DataFrame, links: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents deleted end to end: (documents, chunks, collection links) without them, and (doc_id, n_chunks) of those that were there."""
    gone = documents.select("doc_id").distinct().join(which.select("doc_id").distinct(), "doc_id", "left_semi")
    n = chunks.select("doc_id", "chunk_index").distinct().groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    report = gone.join(n, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    # Children before the parent.
    return delete(documents, gone, "doc_id"), delete(chunks, gone, "doc_id"), delete(links, gone, "doc_id"), report


def delete_collections(collections: DataFrame, links: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(collections, links) without the collections listed by id."""
    return delete(collections, which, "id"), delete(links, which.select(F.col("id").alias("collection_id")), "collection_id")


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of an id, if there is one."""
    return rows.where(F.col(key) == value).limit(1)
