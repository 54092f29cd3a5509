"""Answers without a model: extracted from context, and the prompts a model would get."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.fixed import APOLOGY, SIMPLE_MODE_NOTE
from skerry.functions.text import col, strip, tokens
from skerry.operators.rules import cleaned_answer


def local_answer(query: str | Column, context: str | Column, note: str = SIMPLE_MODE_NOTE) -> Column:
    """The best paragraphs of a context: of the first ten those with most query words, three at most.

    A paragraph of over 50 characters counts one more; equal scores go to the
    later text. Without a match the first long ones stand. More than three
    lines become a list.
    """
    ctx = F.regexp_replace(cleaned_answer(context), r"\n\s*\n", "\n\n")
    paras = F.filter(F.transform(F.split(F.coalesce(ctx, F.lit("")), "\n\n"), strip), lambda p: p != "")
    words = F.array_distinct(tokens(query))
    score = lambda p: F.size(F.filter(words, lambda w: F.lower(p).contains(w))) + F.when(F.length(p) > 50, 1).otherwise(0)
    scored = F.reverse(F.array_sort(F.transform(F.slice(paras, 1, 10), lambda p: F.struct(score(p).alias("s"), p.alias("p")))))
    best = F.transform(F.filter(F.slice(scored, 1, 3), lambda x: x["s"] > 0), lambda x: x["p"])
    long = F.filter(F.slice(paras, 1, 3), lambda p: F.length(p) > 30)
    none = F.array(F.lit("No relevant information found."))
    chosen = F.when(F.size(best) > 0, best).when(F.size(long) > 0, long).when(F.size(paras) > 0, F.slice(paras, 1, 2)).otherwise(none)
    answer = F.array_join(chosen, "\n\n")
    lines = F.split(answer, "\n")
    item = lambda x: F.when(x.rlike(r"^\p{Lu}") & (F.length(x) < 100), F.concat(F.lit("- "), x)).otherwise(x)
    listed = F.array_join(F.transform(lines, lambda x: item(strip(x))), "\n")
    return F.concat(F.when((F.size(lines) > 3) & ~answer.startswith("#"), listed).otherwise(answer), F.lit(note))


def fallback_answer(query: str | Column, context: str | Column) -> Column:
    """Of the first three sentences of a context those that share a word with the query, else the first two; without context an apology."""
    q = col(query)
    parts = F.split(col(context), r"\. ")
    shares = F.filter(F.slice(parts, 1, 3), lambda s: F.arrays_overlap(tokens(s), tokens(q)))
    text = F.array_join(F.when(F.size(shares) > 0, shares).otherwise(F.slice(parts, 1, 2)), ". ")
    text = F.when(text.endswith("."), text).otherwise(F.concat(text, F.lit(".")))
    none = F.concat(F.lit(APOLOGY), q)
    return F.when(F.coalesce(col(context), F.lit("")) == "", none).otherwise(text)


def prompt(system: str | Column, query: Column, context: Column) -> Column:
    """ARRAY<STRUCT<role, content>> for a model, the context before the question."""
    text = F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(query, F.lit("")))
    sys = F.lit(system) if isinstance(system, str) else system
    return F.array(F.struct(F.lit("system").alias("role"), sys.alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))


def generate(rows: DataFrame, key: str, prompt_column: str, client: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(key, content, error): a model's answers, a batch at a time; `client` is called once per worker and gives the model.

    A failing batch gives rows with its error instead of ending the job.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for b in batches:
            try:
                yield pd.DataFrame({key: b[key], "content": model(list(b["_p"])), "error": None})
            except Exception as e:  # noqa: BLE001
                yield pd.DataFrame({key: b[key], "content": None, "error": f"{type(e).__name__}: {e}"[:300]})

    return rows.select(key, F.col(prompt_column).cast("string").alias("_p")).mapInPandas(run, f"{key} {kind}, content string, error string")
