"""End to end: questions through validation, search, gate, citations and confidence; uploads through checks into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.fixed import TOP_K
from skerry.operators import rules, search
from skerry.operators.chunking import explode_sentence_chunks
from skerry.plans.shared import materialise


def ask(questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = TOP_K) -> DataFrame:
    """One row per question (qid, query): its checks, intent, retrieved ids, gate and confidence.

    The answer text comes from a model outside; the canned response stands
    where the gate does not let one answer. Questions are asked in counted
    blocks, however many they are; vectors are those of search.usable().
    What the checks close is searched by neither leg, nor are query_vectors
    of no question.
    """
    q = questions.select("qid", "query", rules.injection("query")["is_safe"].alias("is_safe"), rules.query_error("query").alias("error"), rules.intent("query").alias("intent"), rules.response_language("query").alias("language"))
    open_ = materialise(q.where("is_safe and error is null and intent <> 'smalltalk'").select("qid", "query"), "open")
    texts = search.texts_of(chunks)
    keyword = search.in_blocks(open_, lambda b: search.bm25_many(texts, b, 2 * k))
    vector = search.in_blocks(query_vectors.join(open_, "qid", "left_semi"), lambda b: search.vector_search_many(vectors, b, 2 * k)) if vectors is not None and query_vectors is not None else None
    hits = search.fuse(keyword, vector, k)
    got = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("h"))
    j = q.join(got, "qid", "left").withColumn("h", F.coalesce("h", F.array().cast("array<struct<rank:int,id:bigint,score:double>>")))
    scores = F.transform("h", lambda s: s["score"])
    gate = rules.answerability("query", F.col("intent"), F.size("h"), F.get(scores, F.lit(0)))
    j = j.withColumn("gate", gate).withColumn("kind", F.when(F.col("intent") == "smalltalk", "smalltalk").when(F.col("gate.status") != "answerable", F.col("gate.status")))
    response = rules.canned(F.col("kind"), F.col("language"))
    return j.select("qid", "is_safe", "error", "intent", "language", F.transform("h", lambda s: s["id"]).alias("ids"), F.col("gate.status").alias("status"), F.col("gate.reason").alias("reason"), response.alias("response"), rules.confidence(scores, F.coalesce(response, F.lit("")), F.col("intent"))["score"].alias("confidence"))


def ingest(uploads: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New documents and their chunks: uploads (doc_id, user_id, file_hash, text, ...) whose hash the user has not uploaded."""
    key = ["user_id", "file_hash"]
    up = uploads.where("text is not null and file_hash is not null").withColumn("file_hash", F.lower("file_hash"))
    known = registry.where("file_hash is not null").select("user_id", F.lower("file_hash").alias("file_hash"))
    new = up.groupBy(*key).agg(F.min_by(F.struct(*[c for c in up.columns if c not in key]), F.struct("created_at", "doc_id")).alias("x")).select(*key, "x.*").join(known, key, "left_anti")
    return new, explode_sentence_chunks(new, "doc_id", "text")
