"""Sources: documents of several formats, Markdown sections, paged text, JSON lines, event logs."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity, text

FORMATS = ("pdf", "docx", "txt", "html", "htm", "md", "markdown")

EVAL_CASE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("relevant", T.ArrayType(T.StringType())),
    T.StructField("retrieved", T.ArrayType(T.StringType())), T.StructField("judge", T.MapType(T.StringType(), T.DoubleType())),
])


@F.pandas_udf(T.StringType())
def _docx_text(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))

    for part in contents:
        yield part.map(read)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_filename, document_type, file_size_bytes, modified, content_hash, text, error) of the files under ``path``.

    Unknown types and PDF (which needs a parser outside this engine) become rows with an error, so
    that one document never stops the others.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = identity.suffix(name)
    raw = F.decode("content", "utf-8")
    said = (
        F.when(kind.isin("md", "markdown", "txt"), raw)
        .when(kind.isin("html", "htm"), text.html_text(raw))
        .when(kind == "docx", _docx_text(F.when(kind == "docx", F.col("content"))))
    )
    error = F.when(~kind.isin(*FORMATS), F.concat(F.lit("unsupported type: "), kind)).when(kind == "pdf", "no PDF parser; give paged text")
    return files.select(
        "path", name.alias("source_filename"), kind.alias("document_type"), F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("modified"), identity.content_hash(F.col("content")).alias("content_hash"), said.alias("text"), error.alias("error"),
    )


def allowed_path(path: str, root: str, tenant: str) -> str:
    """The real path of an upload inside the tenant's folder, of a known type; anything else is an error."""
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", tenant):
        raise ValueError("invalid tenant id")
    home, real = os.path.realpath(os.path.join(root, tenant)), os.path.realpath(path)
    if os.path.commonpath([home, real]) != home or real == home:
        raise PermissionError("the path lies outside the tenant's folder")
    if real.rpartition(".")[2].lower() not in FORMATS:
        raise ValueError("unsupported type")
    return real


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of raw pages."""
    return pages.select("page_id", "url", text.html_title(F.col("html")).alias("title"), text.html_text(F.col("html")).alias("text"))


def markdown_sections(docs: DataFrame, *, key: str = "path", body: str = "text") -> DataFrame:
    """(key, section_no, section): the parts that start with a second-level heading."""
    parts = F.filter(F.split(body, "\n(?=## )"), lambda x: F.startswith(x, F.lit("## ")))
    return docs.select(key, F.posexplode(parts).alias("section_no", "section"))


def clean_pages(pages: DataFrame, *, key: str = "doc_id", number: str = "page_no", body: str = "text") -> DataFrame:
    """Pages with collapsed blanks; those of fewer than three word characters go, the others keep their number."""
    said = text.clean_page(F.col(body))
    return pages.select(key, number, said.alias("text")).where(text.word_characters(F.col("text")) >= 3)


def line_pages(docs: DataFrame, *, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, page_no, text): the lines of a text as its pages, numbered from 1."""
    return docs.select(key, F.posexplode(F.split(body, "\n")).alias("i", "text")).select(key, (F.col("i") + 1).alias("page_no"), "text")


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON-lines file; a malformed line fails the read."""
    return spark.read.schema(EVAL_CASE).option("mode", "FAILFAST").json(path)


def event_log(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Events (ts, event, artifact_key, detail) of an append-only log, those whose name starts with ``prefix``."""
    log = spark.read.schema("ts timestamp, event string, artifact_key string, detail string").json(path)
    return log.where(F.startswith("event", F.lit(prefix)))


def relational(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query in a relational database, by one connection: for what is small, or found by a key."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def relational_parts(spark: SparkSession, url: str, table: str, column: str, *, parts: int = 8, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """A whole table, one connection a range of the integer ``column``; filters and columns are pushed to the database.

    The ranges have equal widths between the column's least and greatest value (asked for where not given). The first range also takes
    what lies below and rows of null, the last what lies above, so every row is read once, whatever the bounds.
    """
    quoted = '"' + column.replace('"', '""') + '"'
    if bounds is None:
        ends = relational(spark, url, f"SELECT MIN({quoted}) AS low, MAX({quoted}) AS high FROM {table}", **options).toDF("low", "high").first()
        bounds = (int(ends["low"] or 0), int(ends["high"] or 0))
    low, high = bounds
    cuts = sorted({low + (high - low) * i // parts for i in range(1, parts)} - {low})
    if not cuts:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    ranges = [f"{quoted} < {cuts[0]} OR {quoted} IS NULL", *(f"{quoted} >= {a} AND {quoted} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)), f"{quoted} >= {cuts[-1]}"]
    return spark.read.jdbc(url, table, predicates=ranges, properties=options)


def accepted(path: Column, root: str) -> Column:
    return F.startswith(path, F.lit(root.rstrip("/") + "/"))
