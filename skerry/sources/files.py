"""Files as tables: text, Markdown, CSV, Excel, DOCX, PDF and the audit log."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions.fixed import MAX_FILE_BYTES, UPLOAD_TYPES

AUDIT_SCHEMA = "event_type string, user_id string, timestamp timestamp, action string, resource string, details map<string,string>, ip_address string, user_agent string, success boolean, error_message string, session_id string"


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([^./\\]+)$", 1))


def file_type(path: str | Column) -> Column:
    """PDF, DOCX, CSV, EXCEL, TXT, MARKDOWN or UNKNOWN, by the extension."""
    e = extension(path)
    return F.when(e == "pdf", "PDF").when(e == "docx", "DOCX").when(e == "csv", "CSV").when(e.isin("xlsx", "xls"), "EXCEL").when(e == "txt", "TXT").when(e.isin("md", "markdown"), "MARKDOWN").otherwise("UNKNOWN")


def accepted(path: str | Column, size: Column) -> Column:
    """Whether an upload has an allowed extension and size."""
    return extension(path).isin(UPLOAD_TYPES) & (size <= MAX_FILE_BYTES)


def scan(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of all files below a folder; content is only read if it is used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(folder)


def listing(spark: SparkSession, folder: str, most: int = 20) -> DataFrame:
    return scan(spark, folder).select("path", "length").orderBy("path").limit(most)


def texts(files: DataFrame) -> DataFrame:
    """(path, file_type, text, n_chars, line_count, file_hash, error): UTF-8, else Latin-1; a blank file is an error."""
    text = F.expr("CASE WHEN is_valid_utf8(CAST(content AS STRING)) THEN decode(content, 'UTF-8') ELSE decode(content, 'ISO-8859-1') END")
    t = files.select("path", file_type("path").alias("file_type"), text.alias("text"), F.sha2("content", 256).alias("file_hash"))
    return t.select("path", "file_type", "text", F.length("text").alias("n_chars"), F.size(F.split("text", "\n", -1)).alias("line_count"), "file_hash", F.when(~F.col("text").rlike(r"\S"), "File is empty").alias("error"))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """Header row, commas, inferred types; at scale give spark.read a schema instead."""
    return spark.read.csv(path, header=True, inferSchema=True)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_parts(data: bytes) -> list[tuple[str, str | None, str]]:
    """(kind, section, text): paragraphs in order, a heading opening a section, then the tables under the last section."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    section, out, tables = None, [], []
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            text = text_of(e).strip()
            if style is not None and str(style.get(f"{_W}val", "")).startswith("Heading") and text:
                section = text
            elif text:
                out.append(("text", section, text))
        elif e.tag == f"{_W}tbl":
            tables.append([[text_of(c).strip() for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")])
    for rows in tables:
        if rows:
            line = lambda r: "| " + " | ".join(r) + " |"
            out.append(("table", section, "\n".join(["Table:", line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])))
    return out


def xlsx_rows(data: bytes) -> list[list[str]]:
    """The cells of the first sheet as text; missing ones are empty."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
    out = []
    for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row"):
        cells: list[str] = []
        for c in row.findall(f"{_S}c"):
            at = 0
            for ch in re.sub(r"\d", "", c.get("r", "")):
                at = at * 26 + ord(ch) - 64
            cells += [""] * (at - 1 - len(cells))
            v = c.find(f"{_S}v")
            text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else "" if v is None else v.text or ""
            cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
        out.append(cells)
    return out


def pdf_parts(data: bytes) -> list[tuple[str, int, str]]:
    """(kind, page, text) by an optional library; raises ImportError without one."""
    from pypdf import PdfReader  # optional

    return [("text", i + 1, p.extract_text() or "") for i, p in enumerate(PdfReader(io.BytesIO(data)).pages)]


_PARTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("part_no", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("section", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def parts(files: DataFrame) -> DataFrame:
    """(path, part_no, kind, section, page, text, error) of DOCX, Excel and PDF files; a file that fails gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                kind = path.rpartition(".")[2].lower()
                try:
                    if kind == "docx":
                        found = [(k, s, None, t) for k, s, t in docx_parts(data)]
                    elif kind == "xlsx":
                        found = [("row", None, None, "| " + " | ".join(r) + " |") for r in xlsx_rows(data)]
                    else:
                        found = [(k, None, p, t) for k, p, t in pdf_parts(data)]
                    rows += [(path, i, k, s, p, t, None) for i, (k, s, p, t) in enumerate(found)]
                except Exception as e:  # noqa: BLE001 - a broken file must not end the job
                    rows.append((path, 0, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=_PARTS.names)

    return files.select("path", "content").where(extension("path").isin("docx", "xlsx", "pdf")).mapInPandas(run, _PARTS)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Daily JSONL files with the fixed schema; blank and malformed lines are left out, missing keys are null."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def write_audit(log: DataFrame, path: str) -> None:
    log.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def hashed_embedding(text: str | Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a text's hashed words, for use without a model; zeros for a text without words."""
    from skerry.functions.text import tokens

    @F.pandas_udf("array<float>")
    def unit(slots: pd.Series) -> pd.Series:
        n = slots.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *slots]).astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(n)), n) * dim + flat, minlength=len(n) * dim).reshape(len(n), dim).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(1, keepdims=True))
        return pd.Series(list((counts / np.where(norm > 0, norm, 1.0)).astype(np.float32)))

    return unit(F.transform(tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dim))))
