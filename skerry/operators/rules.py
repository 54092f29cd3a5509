"""Safety and question rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions import fixed
from skerry.functions.text import col, contains_any, count_words, has_word, normalised, strip


def _matched(c: Column, patterns: list[str]) -> Column:
    """The names (first 50 characters and dots) of the patterns that match anywhere, in their order."""
    hits = [F.when(F.regexp_like(c, F.lit("(?i)" + p)), F.lit(p[:50] + "...")) for p in patterns]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def injection(prompt: str | Column) -> Column:
    """STRUCT<is_safe, reason, confidence, patterns_matched> of a prompt; null and empty are safe with confidence 0."""
    p = col(prompt)
    high, medium = _matched(p, fixed.HIGH_RISK), _matched(p, fixed.MEDIUM_RISK)
    words = F.filter(F.array(*map(F.lit, fixed.SUSPICIOUS_WORDS)), lambda w: F.lower(p).contains(w))
    out = lambda safe, reason, conf, hits: F.struct(F.lit(safe).alias("is_safe"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(conf).alias("confidence"), hits.alias("patterns_matched"))
    none = F.array().cast("array<string>")
    return (
        F.when(p.isNull() | (p == ""), out(True, "Empty or invalid prompt", 0.0, none))
        .when(F.size(high) > 0, out(False, "High-risk injection patterns detected", 0.9, high))
        .when((F.size(medium) > 0) & ((F.size(words) >= 2) | (F.size(medium) >= 2)), out(False, "Multiple suspicious patterns detected", 0.75, medium))
        .when(F.size(words) > 0, out(True, F.concat(F.lit("Suspicious keywords detected: "), F.array_join(words, ", ")), 0.3, words))
        .otherwise(out(True, "No injection patterns detected", 1.0, none))
    )


def toxic(c: str | Column) -> Column:
    return F.coalesce(F.regexp_like(col(c), F.lit("(?i)" + fixed.TOXIC)), F.lit(False))


def query_error(query: str | Column) -> Column:
    """Why a query is refused, null if it is not; of several phrases the first in alphabetical order is told."""
    q = col(query)
    low = F.lower(q)
    phrase = F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in sorted(fixed.VALIDATOR_PHRASES)])
    signs = F.length(q) - F.length(F.translate(q, fixed.VALIDATOR_SIGNS, ""))
    return (
        F.when(q.isNull() | (strip(q) == ""), "Query cannot be empty")
        .when(F.length(q) < 3, "Query must be at least 3 characters")
        .when(F.length(q) > 5000, "Query must be less than 5000 characters")
        .when(phrase.isNotNull(), F.concat(F.lit("Query contains suspicious pattern: '"), phrase, F.lit("'")))
        .when(signs > 20, "Query contains too many special characters")
        .when(F.contains(q, F.lit("\x00")), "Query contains invalid characters")
    )


def pii_values(c: str | Column, kind: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit("(?i)" + fixed.PII[kind][0]), F.lit(0))


def pii_findings(c: str | Column) -> Column:
    """ARRAY<STRUCT<entity_type, value, start, end, confidence>> in type order, offsets from 0, overlaps kept."""
    x, parts = col(c), []
    for kind, (pattern, confidence) in fixed.PII.items():
        values = F.regexp_extract_all(x, F.lit("(?i)" + pattern), F.lit(0))
        # A match lies behind the text before it: the pieces between matches and the matches themselves add up.
        gaps = F.transform(F.split(x, "(?i)" + pattern, -1), lambda s: F.length(s))

        def placed(values=values, gaps=gaps, kind=kind, confidence=confidence):
            def one(v, i):
                before = F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda s, g: s + g) + F.aggregate(F.slice(values, F.lit(1), i), F.lit(0), lambda s, w: s + F.length(w))
                return F.struct(F.lit(kind).alias("entity_type"), v.alias("value"), before.alias("start"), (before + F.length(v)).alias("end"), F.lit(confidence).alias("confidence"))

            return F.transform(values, one)

        parts.append(placed())
    return F.concat(*parts)


def pii_redacted(c: str | Column) -> Column:
    """`[TYPE]` for each value, type after type; equal to replacing by offsets wherever values of two types do not overlap."""
    x = col(c)
    for kind, (pattern, _) in fixed.PII.items():
        x = F.regexp_replace(x, "(?i)" + pattern, f"[{kind}]")
    return x


def path_redacted(path: str | Column) -> Column:
    """Path parts with an at-sign or personal information become `[USER]`."""
    found = lambda p: F.contains(p, F.lit("@")) | _any_pii(p)
    return F.array_join(F.transform(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), lambda p: F.when(found(p), F.lit("[USER]")).otherwise(p)), "/")


def _any_pii(c: Column) -> Column:
    out = F.lit(False)
    for pattern, _ in fixed.PII.values():
        out = out | F.regexp_like(c, F.lit("(?i)" + pattern))
    return out


def sanitised(prompt: str | Column) -> Column:
    x = F.regexp_replace(col(prompt), r"(?is)```\s*system.*?```", "")
    x = F.regexp_replace(x, r"(?is)<\s*system\s*>.*?</\s*system\s*>", "")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def safe_alternative(reason: str | Column) -> Column:
    return F.concat(F.lit(fixed.BLOCKED[0]), F.coalesce(col(reason), F.lit("")), F.lit(fixed.BLOCKED[1]))


def intent(query: str | Column) -> Column:
    """smalltalk, mixed, ambiguous or document_question."""
    q = col(query)
    n = normalised(q)
    words = F.array_distinct(F.split(n, " "))
    small, doc = has_word(words, fixed.SMALLTALK_WORDS), has_word(words, fixed.DOCUMENT_WORDS)
    ask = has_word(words, fixed.QUESTION_WORDS) | q.contains("?")
    return (
        F.when(q.isNull() | (n == ""), "document_question")
        .when(F.lower(strip(q)).isin(fixed.SMALLTALK_PHRASES) | n.isin(fixed.SMALLTALK_PHRASES), "smalltalk")
        .when(small & (doc | ask), "mixed")
        .when(small & (F.size(words) <= 4), "smalltalk")
        .when(~doc & ~ask & (F.size(words) <= 6), "ambiguous")
        .otherwise("document_question")
    )


def resolved_intent(rule: Column, model_label: Column) -> Column:
    """The rule's intent, or where that is ambiguous the model's label if it is one, else document_question."""
    return F.when(rule != "ambiguous", rule).when(model_label.isin(fixed.INTENTS), model_label).otherwise("document_question")


def response_language(query: str | Column) -> Column:
    return F.when(has_word(F.split(normalised(query), " "), fixed.FRENCH_WORDS), "fr").otherwise("en")


def answerability(query: str | Column, intent_: Column, n_results: Column, top_score: Column) -> Column:
    """STRUCT<status, reason, confidence>."""
    n = F.coalesce(normalised(query), F.lit(""))
    vague, doc = contains_any(n, fixed.VAGUE_PHRASES), has_word(F.split(n, " "), fixed.DOCUMENT_WORDS)
    top = F.coalesce(top_score, F.lit(0.0))
    out = lambda a, b, c: F.struct(F.lit(a).alias("status"), F.lit(b).alias("reason"), F.lit(c).alias("confidence"))
    return (
        F.when(intent_ == "smalltalk", out("answerable", "smalltalk", 1.0))
        .when(vague & ~doc & (n_results < 2), out("needs_clarification", "underspecified_query", 0.9))
        .when(n_results == 0, out("not_grounded", "no_results", 1.0))
        .when(top < 0.005, out("not_grounded", "very_low_retrieval_score", 0.95))
        .when((n_results == 1) & (top < 0.01) & vague, out("needs_clarification", "single_weak_result", 0.75))
        .otherwise(out("answerable", "sufficient_evidence", 0.8))
    )


def diagnostics(query: str | Column, intent_: Column, gate: Column, scores: Column) -> Column:
    """What a trace keeps of a gate's decision; scores is the ordered ARRAY<DOUBLE> of the results."""
    n = F.coalesce(normalised(query), F.lit(""))
    top3 = F.slice(F.coalesce(scores, F.array().cast("array<double>")), 1, 3)
    mean = F.when(F.size(top3) > 0, F.aggregate(top3, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.size(top3)).otherwise(F.lit(0.0))
    return F.struct(
        intent_.alias("intent"), gate["status"].alias("status"), gate["reason"].alias("reason"), gate["confidence"].alias("confidence"),
        F.greatest(F.coalesce(F.size(scores), F.lit(0)), F.lit(0)).alias("result_count"), F.round(F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0)), 6).alias("top_score"), F.round(mean, 6).alias("avg_top_3_score"),
        has_word(F.split(n, " "), fixed.DOCUMENT_WORDS).alias("has_document_hint"), contains_any(n, fixed.VAGUE_PHRASES).alias("is_vague_query"), F.substring(col(query), 1, 120).alias("query_preview"),
    )


def model_title(answer: str | Column, first: str | Column) -> Column:
    """A title that a model made, without outer spaces and quotes and of 40 characters at most; where it made none, that of the first message."""
    bare = F.regexp_replace(F.regexp_replace(strip(answer), '^"+|"+$', ""), "^'+|'+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, 40), F.lit("")), thread_title(first))


def certainty(response: str | Column) -> Column:
    hedges, strong = count_words(response, fixed.HEDGES), count_words(response, fixed.STRONG_WORDS)
    return F.when(hedges > 3, 0.4).when(strong > 2, 0.75).when(hedges > 0, 0.55).otherwise(0.65)


def confidence(scores: Column, response: str | Column, intent_: Column) -> Column:
    """STRUCT<score, factors, reasoning>; scores is the ordered ARRAY<DOUBLE> of the retrieved results."""
    top, n = F.get(scores, F.lit(0)), F.coalesce(F.size(scores), F.lit(0))
    good = F.size(F.filter(scores, lambda s: s > 0.6))
    retrieval = F.when(n <= 0, 0.0).when(top < 0.5, 0.3).when(top < 0.65, 0.6).otherwise(0.85)
    agreement = F.when(n <= 0, 0.0).when(good >= 3, 0.85).when(good >= 2, 0.65).otherwise(0.3)
    sure = certainty(F.coalesce(col(response), F.lit("")))
    kind = F.when(intent_ == "document_question", 1.0).when(intent_ == "mixed", 0.8).otherwise(0.6)
    w = fixed.FACTOR_WEIGHTS
    factors = {"retrieval_quality": retrieval, "result_agreement": agreement, "response_certainty": sure, "query_type_factor": kind}
    score = F.lit(0.0)
    for name, f in factors.items():
        score = score + f * w[name]
    score = F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 6)
    band = F.when(score > 0.75, "High").when(score > 0.5, "Moderate").otherwise("Low")
    parts = F.concat_ws(
        ", ",
        F.when(retrieval > 0.7, "strong retrieval match").when(retrieval < 0.4, "weak retrieval match"),
        F.when(agreement > 0.7, "multiple supporting sources").when(agreement < 0.4, "single source"),
        F.when(sure > 0.7, "confident language").when(sure < 0.5, "uncertain language"),
    )
    reasoning = F.concat(band, F.lit(" confidence: "), F.when(parts == "", "neutral factors").otherwise(parts))
    return F.struct(score.alias("score"), F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), v)]).alias("factors"), reasoning.alias("reasoning"))


def thread_title(first: str | Column) -> Column:
    return F.concat(F.substring(strip(first), 1, 50), F.when(F.length(col(first)) > 50, "...").otherwise(""))


def cleaned_answer(c: str | Column) -> Column:
    x = F.regexp_replace(col(c), r"- \[[ xX]\]\s*", "- ")
    return F.regexp_replace(x, r"data/uploads/[^/]+/[^\s]+/", "")


def canned(kind: Column, language: Column) -> Column:
    out = F.lit(None).cast("string")
    for (k, l), text in fixed.CANNED.items():
        out = F.when((kind == k) & (language == l), text).otherwise(out)
    return out
