"""Texts, Markdown and tables cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.fixed import CHUNK_CHARS, OVERLAP_CHARS, TABLE_ROWS
from skerry.functions.text import col, strip
from skerry.operators.order import numbered


def sentences(c: str | Column) -> Column:
    parts = F.split(F.replace(F.replace(col(c), F.lit("\r\n"), F.lit(" ")), F.lit("\n"), F.lit(" ")), r"\. ", -1)
    kept = F.filter(F.transform(parts, strip), lambda s: s != "")
    return F.transform(kept, lambda s: F.when(s.endswith("."), s).otherwise(F.concat(s, F.lit("."))))


def sentence_chunks(c: str | Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """ARRAY<STRING>: sentences packed up to `size` characters, the last ones repeated up to `overlap`.

    A fold over the sentences: state (out, cur, n). Spaces between sentences
    do not count towards the size; an over-long sentence is a chunk by
    itself; null and blank texts give an empty array.
    """
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def tail(cur: Column) -> Column:
        """The last sentences whose lengths add up to `overlap` at most."""
        start = F.struct(F.array().cast("array<string>").alias("keep"), F.lit(0).alias("n"), F.lit(True).alias("on"))
        step = lambda a, s: F.when(a["on"] & (a["n"] + F.length(s) <= overlap), F.struct(F.concat(F.array(s), a["keep"]).alias("keep"), (a["n"] + F.length(s)).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["keep"].alias("keep"), a["n"].alias("n"), F.lit(False).alias("on")))
        return F.aggregate(F.reverse(cur), start, step, lambda a: a["keep"])

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda n, s: n + F.length(s))

    def step(a: Column, s: Column) -> Column:
        full = (a["n"] + F.length(s) > size) & (F.size(a["cur"]) > 0)
        kept = tail(a["cur"])
        return F.when(full, F.struct(F.concat(a["out"], F.array(F.array_join(a["cur"], " "))).alias("out"), F.concat(kept, F.array(s)).alias("cur"), (total(kept) + F.length(s)).alias("n"))).otherwise(
            F.struct(a["out"].alias("out"), F.concat(a["cur"], F.array(s)).alias("cur"), (a["n"] + F.length(s)).alias("n"))
        )

    end = lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"])
    return F.aggregate(sentences(F.coalesce(col(c), F.lit(""))), zero, step, end)


def explode_sentence_chunks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_index from 0, content, n_chars)."""
    return rows.select(key, F.posexplode(sentence_chunks(text)).alias("chunk_index", "content")).withColumn("n_chars", F.length("content"))


def markdown_sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_no, section_header, content): the parts that lines starting with `#` open.

    Text before the first such line has a null header; parts without text are
    left out; a file of header lines only is one part without header. The
    lines of a file stay in one row: no shuffle.
    """
    lines = F.split(text, "\n", -1)
    is_head = lambda x: strip(x).startswith("#")
    zero = F.struct(F.array().cast("array<struct<h:string,t:array<string>>>").alias("out"), F.lit(None).cast("string").alias("h"), F.array().cast("array<string>").alias("t"))
    flush = lambda a: F.concat(a["out"], F.array(F.struct(a["h"].alias("h"), a["t"].alias("t"))))
    step = lambda a, x: F.when(is_head(x), F.struct(flush(a).alias("out"), strip(F.regexp_replace(strip(x), "^#+", "")).alias("h"), F.array().cast("array<string>").alias("t"))).otherwise(F.struct(a["out"].alias("out"), a["h"].alias("h"), F.concat(a["t"], F.array(x)).alias("t")))
    folded = F.aggregate(lines, zero, step, flush)
    parts = F.filter(F.transform(folded, lambda s: F.struct(s["h"].alias("h"), strip(F.array_join(s["t"], "\n")).alias("t"))), lambda s: s["t"] != "")
    only = F.array(F.struct(F.lit(None).cast("string").alias("h"), strip(text).alias("t")))
    parts = F.when(F.size(parts) > 0, parts).when(strip(text) != "", only)
    return rows.select(key, F.posexplode(parts).alias("section_no", "s")).select(key, "section_no", F.col("s.h").alias("section_header"), F.col("s.t").alias("content"))


def block_chunks(c: str | Column, size: int = CHUNK_CHARS) -> Column:
    """ARRAY<STRING> of a layout block: up to `size` characters each, cut after the last line end in reach, else at `size`.

    Unlike the usual way of such chunkers the tail is never lost: the chunks
    add up to the text.
    """
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.coalesce(col(c), F.lit("")).alias("rest"))

    def step(a: Column, _: Column) -> Column:
        head = F.substring(a["rest"], 1, size)
        nl = F.length(head) - F.locate("\n", F.reverse(head)) + 1
        cut = F.when(F.length(a["rest"]) <= size, F.length(a["rest"])).when(F.locate("\n", head) > 0, nl).otherwise(F.lit(size))
        return F.when(a["rest"] == "", a).otherwise(F.struct(F.concat(a["out"], F.array(F.substring(a["rest"], F.lit(1), cut))).alias("out"), F.substring(a["rest"], cut + 1, F.length(a["rest"])).alias("rest")))

    # Every two consecutive cuts take more than `size` characters, or there is a line to each cut.
    turns = F.size(F.split(F.coalesce(col(c), F.lit("")), "\n", -1)) + F.ceil(F.length(F.coalesce(col(c), F.lit(""))) / size).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.greatest(turns, F.lit(1))), zero, step, lambda a: a["out"])


def _cells(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def table_markdown(rows: DataFrame, order: list[str], columns: list[str], kind: str = "CSV", size: int = TABLE_ROWS) -> DataFrame:
    """(chunk_index, row_start, row_end, content): a table's rows as Markdown, `size` rows a chunk, numbered over the order columns."""
    head = f"Table ({kind}):\n| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    r = numbered(rows.select(*dict.fromkeys(order + columns)), order, "n").select("n", _cells(columns).alias("line")).withColumn("chunk_index", F.floor(F.col("n") / size))
    g = r.groupBy("chunk_index").agg(F.min("n").alias("row_start"), F.max("n").alias("row_end"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return g.select("chunk_index", "row_start", "row_end", F.concat(F.lit(head), F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("content"))


def array_table_markdown(table: Column, prefix: str = "Table:") -> Column:
    """Markdown of an ARRAY<ARRAY<STRING>> whose first row is the header."""
    cell = lambda x: strip(F.coalesce(x, F.lit("")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    head = F.element_at(table, 1)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(table, F.lit(2), F.greatest(F.size(table) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(F.lit(prefix), line(head), rule), body), "\n")


def paragraph_chunks(paragraphs: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """ARRAY<STRUCT<section, content>> of a file's ordered ARRAY<STRUCT<heading BOOLEAN, text STRING>>.

    Paragraphs gather in a buffer that a heading, or `size` characters, ends;
    after the latter the last paragraphs of `overlap` characters in all go on
    as one. Every buffer is packed by sentences.
    """
    kind = "struct<out:array<struct<section:string,text:string>>,section:string,buf:array<string>,n:int>"
    zero = F.struct(F.array().cast("array<struct<section:string,text:string>>").alias("out"), F.lit(None).cast("string").alias("section"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n")).cast(kind)

    def flushed(a: Column) -> Column:
        whole = F.array(F.struct(a["section"].alias("section"), F.array_join(a["buf"], " ").alias("text")))
        return F.when(F.size(a["buf"]) > 0, F.concat(a["out"], whole)).otherwise(a["out"])

    def tail(buf: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("keep"), F.lit(0).alias("n"), F.lit(True).alias("on"))
        take = lambda a, s: F.when(a["on"] & (a["n"] + F.length(s) <= overlap), F.struct(F.concat(F.array(s), a["keep"]).alias("keep"), (a["n"] + F.length(s)).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a["keep"].alias("keep"), a["n"].alias("n"), F.lit(False).alias("on")))
        return F.aggregate(F.reverse(buf), start, take, lambda a: F.array_join(a["keep"], " "))

    def step(a: Column, p: Column) -> Column:
        t = strip(F.coalesce(p["text"], F.lit("")))
        buf, n = F.concat(a["buf"], F.array(t)), a["n"] + F.length(t)
        kept = tail(buf)
        state = lambda out, sec, b, m: F.struct(out.alias("out"), sec.alias("section"), b.alias("buf"), m.alias("n")).cast(kind)
        full = F.struct(a["section"].alias("section"), F.array_join(buf, " ").alias("text"))
        return (
            F.when(F.coalesce(p["heading"], F.lit(False)), state(flushed(a), t, F.array().cast("array<string>"), F.lit(0)))
            .when(t == "", a)
            .when(n >= size, state(F.concat(a["out"], F.array(full)), a["section"], F.when(kept == "", F.array().cast("array<string>")).otherwise(F.array(kept)), F.length(kept)))
            .otherwise(state(a["out"], a["section"], buf, n))
        )

    blocks = F.aggregate(paragraphs, zero, step, flushed)
    return F.flatten(F.transform(blocks, lambda b: F.transform(sentence_chunks(b["text"], size, overlap), lambda c: F.struct(b["section"].alias("section"), c.alias("content")))))
