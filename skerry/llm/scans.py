"""Problem 6: defects of scanned pages found and repaired, in SQL expressions.

Running headers are edge lines whose mask (digits out, confusable glyphs
folded) recurs on pages of the document. Words are grouped by their skeleton
of confusable glyphs; a rare form gives way to a far more frequent one of its
group that its neighbours support. Lines are explodes of one page each; what
crosses pages is one small row per page, and all counts are partially
aggregated. Windows range over a page, or over such page rows, never over
all lines of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.shared import materialise

#: Glyph groups that recognition takes for each other, each written as its parts.
CONFUSABLE = [("m", "rn"), ("d", "cl"), ("w", "vv"), ("u", "ii"), ("h", "li")]
CONFUSABLE_ONE = ("i1|!0o5$8@e9", "lllloossbacg")
_HYPHENS = "\\-\u00ac\u00ad\u2010"


@dataclass
class Settings:
    """A form is misread if another of its skeleton is `ratio` times as frequent; past `sure` times it needs no neighbour. Bitmaps have `slots` bits."""

    ratio: int = 8
    least: int = 4
    sure: int = 400
    slots: int = 1 << 24


def skeleton(c: Column) -> Column:
    """Lower case with every confusable glyph group written alike."""
    c = F.lower(c)
    for one, two in CONFUSABLE:
        c = F.replace(c, F.lit(one), F.lit(two))
    return F.translate(c, *CONFUSABLE_ONE)


def _bare(c: Column) -> Column:
    """A token without outer punctuation."""
    return F.regexp_replace(c, r"^[^\p{L}\p{N}@$|]+|[^\p{L}\p{N}@$|]+$", "")


def _roman(n: Column) -> Column:
    pick = lambda words, d: F.element_at(F.array(*map(F.lit, words)), (d % 10 + 1).cast("int"))
    ones, tens = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"]
    return F.when(n.between(1, 499), F.concat(F.repeat(F.lit("c"), F.floor(n / 100).cast("int")), pick(tens, F.floor(n / 10)), pick(ones, n)))


def page_lines(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Lines of the scanned pages with their kinds.

    (id, doc_id, page, line_no, line, t, header, numbered, body): t is the
    line without outer spaces and with single inner ones where it is body.
    """
    scans = documents.where("source = 'scans' and doc_id is not null").select("doc_id").distinct()
    pages = chunks.where("id is not null and content is not null").select("id", "doc_id", "page_number", "content").join(scans, "doc_id", "left_semi")
    pages = pages.groupBy("id").agg(F.min(F.struct("doc_id", "page_number", "content")).alias("x")).select("id", "x.*")
    ls = F.split("content", "\n", -1)
    full = F.filter(F.transform(ls, lambda x, i: F.when(x.rlike(r"[^\s\p{Cf}]"), i)), lambda i: i.isNotNull())
    lines = pages.select("id", "doc_id", F.col("page_number").alias("page"), F.slice(full, 1, 2).alias("top"), F.slice(F.reverse(full), 1, 2).alias("foot"), F.posexplode(ls).alias("line_no", "line"))
    t = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    edge = F.array_contains("top", F.col("line_no")) | F.array_contains("foot", F.col("line_no"))
    lines = lines.select("id", "doc_id", "page", "line_no", "line", t.alias("t"), edge.alias("edge"))
    alone = F.regexp_replace(F.lower("t"), r"(?<![\p{L}\p{N}])\d+(?![\p{L}\p{N}])|[^\p{L}\p{N}\s|!$@]", " ")
    mask = F.trim(F.regexp_replace(skeleton(alone), r"\s+", " "))
    lines = lines.withColumn("mask", F.when(F.col("edge") & F.col("t").rlike(r"\p{L}{2}"), mask))
    known = lines.where("mask is not null and mask <> ''").groupBy("doc_id", "mask").agg(F.count_distinct("page").alias("n")).where("n >= 2").select("doc_id", "mask", F.lit(True).alias("header"))
    first = pages.groupBy("doc_id").agg(F.min("page_number").alias("first"))
    lines = lines.join(known, ["doc_id", "mask"], "left").join(first, "doc_id", "left")
    core = F.lower(F.regexp_extract("t", r"(?i)^[^\p{L}\p{N}]*(?:(?:page|seite|página|pagina|pág\.?|pag\.?|p\.|s\.|blad)\s*)?([0-9lOI]{1,6}|[ivxlc]{1,9})\s*(?:(?:/|of|sur|von|de|di|van)\s*[0-9lOI]+)?[^\p{L}\p{N}]*$", 1))
    beside = F.coalesce(F.nullif(F.regexp_extract("t", r"^(\d{1,6})\s{2,}\S", 1), F.lit("")), F.nullif(F.regexp_extract("t", r"\S\s{2,}(\d{1,6})$", 1), F.lit("")))
    lines = lines.withColumn("core", F.when(F.col("edge"), core))
    core, digits = F.col("core"), F.translate("core", "lio", "110")
    shown = [F.col("page"), F.col("page") - F.col("first") + 1]
    whole = F.lit(False)
    for n in shown:
        whole = whole | (core == _roman(n)) | (digits == n.cast("string"))
    numbered = F.coalesce(F.col("edge") & (whole | (F.col("header").isNotNull() & (beside == F.col("page").cast("string")))), F.lit(False))
    lines = lines.withColumn("numbered", numbered).withColumn("header", F.coalesce("header", F.lit(False)) & ~F.coalesce(whole, F.lit(False)))
    body = ~F.col("header") & ~F.col("numbered") & F.col("t").rlike(r"[^\s\p{Cf}]")
    return lines.select("id", "doc_id", "page", "line_no", "line", "t", "header", "numbered", body.alias("body"))


def _joined_lines(lines: DataFrame) -> DataFrame:
    """Body lines with the first token of the next body line, over page borders: (..., last, next)."""
    body = lines.where("body").select("id", "doc_id", "page", "line_no", "t")
    body = body.withColumn("first", F.regexp_extract("t", r"^\S+", 0)).withColumn("last", F.regexp_extract("t", r"\S+$", 0))
    on_page = Window.partitionBy("id").orderBy("line_no")
    body = body.withColumn("next_here", F.lead("first").over(on_page)).withColumn("prev_last", F.lag("last").over(on_page))
    top = body.where("prev_last is null").groupBy("doc_id", F.col("page").alias("p")).agg(F.min_by("first", "id").alias("next_there"))
    foot = body.where("next_here is null").groupBy("doc_id", F.col("page").alias("p")).agg(F.max_by("last", "id").alias("prev_there"))
    body = body.join(top.withColumn("p", F.col("p") - 1).withColumnRenamed("doc_id", "d1"), (F.col("doc_id") == F.col("d1")) & (F.col("page") == F.col("p")), "left").drop("d1", "p")
    body = body.join(foot.withColumn("p", F.col("p") + 1).withColumnRenamed("doc_id", "d2"), (F.col("doc_id") == F.col("d2")) & (F.col("page") == F.col("p")), "left").drop("d2", "p")
    return body.select(
        "id", "doc_id", "page", "line_no", "t", "last", "first",
        F.coalesce("next_here", "next_there").alias("next"),
        F.coalesce("prev_last", "prev_there").alias("prev"),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each token stands in a partition's texts; counts go out whenever there are many different ones."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        t = pa.concat_tables(held).group_by("w").aggregate([("m", "sum")])
        return t.rename_columns(["w", "m"]).select(["w", "m"])

    for b in batches:
        flat = pc.list_flatten(pc.ascii_split_whitespace(b.column("content")))
        n = pc.value_counts(flat)
        held.append(pa.table({"w": n.field("values").cast(pa.string()), "m": n.field("counts")}))
        if sum(t.num_rows for t in held) > 1_000_000:
            held = [summed()]
            if held[0].num_rows > 500_000:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if held:
        yield from summed().combine_chunks().to_batches()


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(word, n): lower-case tokens of all chunk texts without outer punctuation.

    Tokens are counted as they stand first, so that only distinct ones go
    through regular expressions.
    """
    raw = chunks.where("content is not null").select("content").mapInArrow(_counted, "w string, m bigint").groupBy("w").agg(F.sum("m").alias("m"))
    return raw.select(F.lower(_bare(F.col("w"))).alias("word"), "m").where("word <> ''").groupBy("word").agg(F.sum("m").alias("n"))


def _slots(keys: DataFrame, key: Column, slots: int) -> DataFrame:
    """A bitmap of hashed keys, (slot, bits): at most slots / 64 rows, however many keys there are."""
    h = F.pmod(key, F.lit(slots))
    bit = F.expr("shiftleft(1L, cast(h % 64 as int))")
    rows = keys.select(h.alias("h")).select(F.expr("h div 64").alias("slot"), bit.alias("b"))
    return rows.groupBy("slot").agg(F.bit_or("b").alias("bits"))


def _maybe(rows: DataFrame, key: Column, keys: DataFrame, slots: int) -> DataFrame:
    """rows whose key may be among keys, by a broadcast bitmap, before anything is shuffled."""
    r = rows.withColumn("_h", F.pmod(key, F.lit(slots)))
    hit = r.join(F.broadcast(keys), F.expr("_h div 64") == F.col("slot"))
    return hit.where("shiftright(bits, cast(_h % 64 as int)) & 1 = 1").drop("_h", "slot", "bits")


def _divided(body: DataFrame, words: DataFrame) -> DataFrame:
    """The body lines whose last word goes on in the next, with the whole word: (id, line_no, whole)."""
    stem = F.regexp_extract("last", rf"([\p{{L}}\d@$|]+)[{_HYPHENS}]$", 1)
    head = F.regexp_extract("next", r"^[\p{L}\d@$|]+", 0)
    ends = body.where(F.col("t").rlike(rf"[\p{{L}}\d@$|][{_HYPHENS}]$") & F.col("next").isNotNull())
    ends = ends.withColumn("stem", stem).withColumn("head", head).where("head <> '' and stem <> ''").where(~F.col("stem").rlike(r"^\p{Lu}\d+$|^\d+$"))
    soft = F.col("last").rlike("[\u00ac\u00ad]$")
    ends = ends.where(soft | F.col("next").rlike(r"^[\p{Ll}\d@$|]")).withColumn("soft", soft)
    ends = ends.withColumn("whole", F.concat("stem", "head"))
    # Whether the corpus writes the two parts as one word or as a compound.
    own = F.lower(F.concat(F.regexp_extract("last", rf"[^\s]*?([\p{{L}}\d\-'’]+)[{_HYPHENS}]$", 1), F.lit("-"), _bare(F.regexp_extract("next", r"^[\p{L}\d\-'’]+", 0))))
    ends = ends.withColumn("compound", own)
    one = words.select(F.col("word").alias("w1"), F.col("n").alias("n1"))
    two = words.where("word like '%-%'").select(F.col("word").alias("w2"), F.col("n").alias("n2"))
    ends = ends.join(one, F.lower("whole") == F.col("w1"), "left").join(two, F.col("compound") == F.col("w2"), "left")
    return ends.where("soft or coalesce(n1, 0) >= coalesce(n2, 0)").select("id", "line_no", "whole")


def _odd(w: Column) -> Column:
    """A digit or sign among letters, or a letter among digits, as no word or code has it."""
    word = w.rlike(r"^[\p{L}'’\-]*(?:\p{L}[0158|$@!]|[0158|$@]\p{L})[\p{L}'’\-0158|$@!]*$") & (F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2) & ~w.rlike(r"^@\p{Lu}|^\p{Lu}{1,4}\d+$|^\d+\p{L}{1,2}$|\d{3}")
    number = w.rlike(r"^[\dlOoIS.,/:\-]+$") & w.rlike(r"\d") & w.rlike(r"[lOoIS]") & ~w.rlike(r"^[IS]\d+$|\d[oS]$")
    code = w.rlike(r"^\p{Lu}{2,4}-?\d*[lO][\dlO\-]*$") & w.rlike(r"\d")
    return word | number | code


def _tokens(body: DataFrame, divided: DataFrame) -> DataFrame:
    """(id, line_no, place, word, before, after, part) of the body's tokens: neighbours on the line in lower case, `part` for a part of a divided word."""
    mark = divided.select("id", "line_no", F.lit(True).alias("cut")).distinct()
    rows = body.join(mark, ["id", "line_no"], "left")
    after = Window.partitionBy("id").orderBy("line_no")
    rows = rows.withColumn("cont", F.coalesce(F.lag("cut").over(after), F.col("prev").rlike(rf"[{_HYPHENS}]$"), F.lit(False)))
    rows = rows.select("id", "line_no", F.coalesce("cut", F.lit(False)).alias("cut"), "cont", F.transform(F.split("t", r"\s+"), _bare).alias("ws"))
    rows = rows.select("id", "line_no", "cut", "cont", "ws", F.posexplode("ws").alias("place", "word")).where("word <> ''")
    near = lambda d: F.lower(F.get("ws", F.col("place") + d))
    part = (F.col("place") == 0) & F.col("cont") | (F.col("place") == F.size("ws") - 1) & F.col("cut")
    return rows.select("id", "line_no", "place", "word", near(-1).alias("before"), near(1).alias("after"), part.alias("part"))


def _misread(body: DataFrame, divided: DataFrame, words: DataFrame, s: Settings) -> DataFrame:
    """Occurrences of wrongly recognised words: (id, line_no, place, word, right), right null where no form is supported.

    Frequent words are never shuffled for what only rare ones need: a bitmap
    of the forms, and one of the word pairs that could support them, thin the
    tokens out first.
    """
    tokens = materialise(_tokens(body, divided), "tokens").withColumn("w", F.lower("word"))
    best = words.where(r"word rlike '^[\\p{L}\'’-]+$'").groupBy(skeleton(F.col("word")).alias("skel")).agg(F.max_by("word", F.struct("n", "word")).alias("right"), F.max("n").alias("n_right"))
    forms = words.withColumn("skel", skeleton(F.col("word"))).join(best, "skel").where(f"word <> right and n_right >= {s.least} and n_right >= {s.ratio} * n and length(word) >= 2")
    forms = materialise(forms.select(F.col("word").alias("w"), "right", "n_right", "n"), "forms")
    hits = _maybe(tokens.where("not part"), F.xxhash64("w"), _slots(forms, F.xxhash64("w"), s.slots), s.slots).join(forms, "w")
    hits = materialise(hits, "hits")
    wanted = hits.select(F.col("before").alias("x"), F.col("right").alias("y")).unionByName(hits.select(F.col("right").alias("x"), F.col("after").alias("y"))).where("x <> '' and y <> ''").distinct()
    wanted = materialise(wanted, "wanted")
    told = _maybe(tokens.where("before <> ''").select(F.col("before").alias("x"), F.col("w").alias("y")), F.xxhash64("x", "y"), _slots(wanted, F.xxhash64("x", "y"), s.slots), s.slots)
    pairs = materialise(told.groupBy("x", "y").agg(F.count("*").alias("m")).join(wanted, ["x", "y"], "left_semi"), "pairs")
    left = pairs.select(F.col("x").alias("before"), F.col("y").alias("right"), F.col("m").alias("m1"))
    right = pairs.select(F.col("x").alias("right"), F.col("y").alias("after"), F.col("m").alias("m2"))
    hits = hits.join(left, ["before", "right"], "left").join(right, ["right", "after"], "left")
    backed = (F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0)) > 0) | (F.col("n_right") >= s.sure * F.col("n"))
    good = hits.where(backed | _odd(F.col("word"))).select("id", "line_no", "place", "word", "right")
    # Of the tokens only those with a sign or digit, or a capital I, l, O or S among digits, can be odd.
    some = tokens.where(F.col("word").rlike(r"[\d|$@!]") & _odd(F.col("word"))).select("id", "line_no", "place", "word")
    plain = some.join(good.select("id", "line_no", "place"), ["id", "line_no", "place"], "left_anti").select("id", "line_no", "place", "word", F.lit(None).cast("string").alias("right"))
    return good.unionByName(plain)


def _parts(chunks: DataFrame, documents: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    # Each is read several times below: written once, never computed again.
    lines = materialise(page_lines(chunks, documents), "lines")
    body = materialise(_joined_lines(lines), "body")
    words = materialise(vocabulary(chunks), "words")
    divided = materialise(_divided(body, words), "divided")
    return lines, body, divided, _misread(body, divided, words, s)


def scan_defects(chunks: DataFrame, documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(chunk_id, line_no, kind) of the defects on scanned pages.

    Pages are the chunks of documents with source `scans`; null ids and
    content give nothing, repeated ids count once, pages without number take
    part but have no page-number lines and do not continue each other. Lines
    of any length are read whole. Extra columns are ignored.
    """
    lines, _, divided, wrong = _parts(chunks, documents, settings or Settings())
    kind = lambda df, k: df.select(F.col("id").alias("chunk_id"), F.col("line_no"), F.lit(k).alias("kind"))
    out = kind(lines.where("header"), "running_header").unionByName(kind(lines.where("numbered"), "page_number"))
    return out.unionByName(kind(divided, "hyphen").distinct()).unionByName(kind(wrong, "misread").distinct())


def repaired_paragraphs(chunks: DataFrame, documents: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, paragraph_no from 0, first_page, text) of the scanned documents.

    Headers, page numbers and blank lines are gone, divided words joined,
    misread words replaced where a form is supported. A paragraph ends with a
    line that closes a sentence well short of the page's width.
    """
    lines, body, divided, wrong = _parts(chunks, documents, settings or Settings())
    fixes = wrong.where("right is not null").groupBy("id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("word", "right")))).alias("fix"))
    rows = body.select("id", "doc_id", "page", "line_no", "t", "prev").join(fixes, ["id", "line_no"], "left").join(divided.select("id", "line_no", "whole"), ["id", "line_no"], "left")
    upper = lambda w, r: F.when(w.rlike(r"^[\p{Lu}]"), F.initcap(r)).otherwise(r)
    token = lambda x, i: F.when(F.col("fix")[i].isNotNull(), F.replace(x, F.col("fix")[i]["word"], upper(F.col("fix")[i]["word"], F.col("fix")[i]["right"]))).otherwise(x)
    fixed = F.array_join(F.transform(F.split("t", r"\s+"), token), " ")
    page = Window.partitionBy("id").orderBy("line_no")
    wide = F.max(F.length("t")).over(Window.partitionBy("id"))
    rows = rows.withColumn("text", F.when(F.col("whole").isNotNull(), F.regexp_replace(fixed, rf"[{_HYPHENS}]$", "")).otherwise(F.concat(fixed, F.lit(" "))))
    rows = rows.withColumn("ends", (F.col("t").rlike(r"[.!?:»”\"]$") & (F.length("t") < 0.6 * wide)).cast("int"))
    rows = rows.withColumn("para", F.coalesce(F.sum("ends").over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per_page = rows.groupBy("doc_id", "page", "id").agg(F.sum("ends").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = per_page.select("id", before.alias("shift"))
    rows = rows.join(shift, "id").withColumn("paragraph_no", F.col("para") + F.col("shift"))
    whole = rows.groupBy("doc_id", "paragraph_no").agg(F.min("page").alias("first_page"), F.array_sort(F.collect_list(F.struct("page", "id", "line_no", "text"))).alias("x"))
    return whole.select("doc_id", F.col("paragraph_no").cast("bigint"), "first_page", F.trim(F.array_join(F.transform("x", lambda s: s["text"]), "")).alias("text"))
