"""Chunks of documents and their citation metadata."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import importable

SIZE, OVERLAP = 1000, 200
#: Characters of chunks that a worker holds before it passes them on.
HELD = 4_000_000
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
MARKDOWN_SEPARATORS = ("\n# ", "\n## ", "\n### ", *SEPARATORS)


def split_text(body: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that the text has and parts fit under.

    Parts that are too long are cut again by the separators that follow. Neighbouring parts are then
    joined while they fit; each next chunk starts with the last parts of the one before that make up
    at most ``overlap`` characters.
    """
    if len(body) <= size:
        return [body] if body.strip() else []
    at = next((i for i, s in enumerate(separators) if s == "" or s in body), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        first, *rest = body.split(mark)
        parts = [x for x in (first, *(mark + r for r in rest)) if x]
    else:
        parts = [body[i : i + size] for i in range(0, len(body), max(1, size - overlap))]
        return [p for p in parts if p.strip()]
    chunks: list[str] = []
    window: list[str] = []
    held = 0

    def close() -> None:
        made = "".join(window).strip()
        if made:
            chunks.append(made)

    for part in parts:
        if len(part) > size:
            close()
            window, held = [], 0
            chunks += split_text(part, size, overlap, finer or ("",))
            continue
        if held + len(part) > size:
            close()
            while window and (held > overlap or held + len(part) > size):
                held -= len(window.pop(0))
        window.append(part)
        held += len(part)
    close()
    return chunks


def recursive_chunks(docs: DataFrame, *, key: str = "doc_id", body: str = "text", kind: str | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, total_chunks, content); Markdown and PDF texts also part at headings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, index, total, content, held = [], [], [], [], 0
            for i, (text, marked) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                made = split_text(text.as_py() or "", size, overlap, MARKDOWN_SEPARATORS if marked.as_py() else SEPARATORS)
                rows += [i] * len(made)
                index += range(len(made))
                total += [len(made)] * len(made)
                content += made
                held += sum(map(len, made))
                if held > HELD or (i == batch.num_rows - 1 and rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(content, pa.string())], names=[key, "chunk_index", "total_chunks", "content"])
                    rows, index, total, content, held = [], [], [], [], 0

    marked = F.coalesce(F.col(kind).isin("md", "markdown", "pdf"), F.lit(False)) if kind else F.lit(False)
    rows = importable(docs.sparkSession) and docs.select(key, body, marked.alias("__marked"))
    return rows.mapInArrow(cut, f"`{key}` {dict(docs.dtypes)[key]}, chunk_index int, total_chunks int, content string")


def numbered(docs: DataFrame, key: str) -> DataFrame:
    """Chunk arrays as rows with their index and total; no shuffle, as a document's chunks stand in one row."""
    return docs.select(key, F.size("__chunks").alias("total_chunks"), F.posexplode("__chunks").alias("chunk_index", "content")).select(
        key, "chunk_index", "total_chunks", "content"
    )


def packed(parts: Column, most: int, glue: str) -> Column:
    """Neighbouring parts (an array column) joined with ``glue`` while the whole stays within ``most`` characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(state: Column, part: Column) -> Column:
        joined = F.when(state["now"] == "", part).otherwise(F.concat(state["now"], F.lit(glue), part))
        fits = (state["now"] == "") | (F.length(joined) <= most)
        return F.struct(
            F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(state["now"]))).alias("done"),
            F.when(fits, joined).otherwise(part).alias("now"),
        )

    return F.aggregate(parts, empty, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def paragraph_chunks(docs: DataFrame, *, key: str = "doc_id", body: str = "text", most: int = 700, mark: str = r"\n\s*\n", glue: str = "\n\n") -> DataFrame:
    """Greedily packed paragraphs; a paragraph over ``most`` characters stands alone."""
    parts = F.filter(F.transform(F.split(body, mark), X.strip), lambda p: p != "")
    return numbered(docs.select(key, packed(parts, most, glue).alias("__chunks")), key)


def stamped(chunks: DataFrame, *, document: str = "document_id", page: str = "page") -> DataFrame:
    """Chunks with totals, and a page: the given one, else the chunk's ordinal marked as an estimate."""
    own = Window.partitionBy(document)
    return chunks.withColumns({
        "total_chunks": F.count("*").over(own),
        "page_is_estimated": F.col(page).isNull(),
        "page": F.coalesce(F.col(page), F.col("chunk_index") + 1),
    })


def normal_page(raw: Column) -> Column:
    """A loader's page, counted from 0, as a page counted from 1; null for what is no number."""
    return F.when(raw.cast("string").rlike(r"^\d+$"), raw.cast("string").cast("int") + 1)


def with_sections(chunks: DataFrame, *, document: str = "document_id", order: str = "chunk_index", body: str = "content", initial: str | None = None) -> DataFrame:
    """The section of each chunk: the heading it opens with, else the last heading in chunks before it."""
    before = Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = chunks.withColumn("__last", F.try_element_at(X.headings(F.col(body)), F.lit(-1)))
    carried = F.coalesce(X.leading_heading(F.col(body)), F.last("__last", ignorenulls=True).over(before), F.lit(initial))
    return found.withColumn("section", carried).drop("__last")


def rebuilt(artifacts: DataFrame, *, key: str = "artifact_key", chunks: str = "chunks") -> DataFrame:
    """Rows of stored chunk arrays (structs of text and a page that is already counted from 1)."""
    return artifacts.select(key, F.posexplode(chunks).alias("chunk_index", "chunk")).select(key, "chunk_index", "chunk.*")


def citation(fields: dict[str, Column]) -> Column:
    """A citation struct from a payload: blank and "None" are missing; null where collection, document or title is missing."""
    clean = {k: X.missing(v) for k, v in fields.items()}
    page = F.expr("NULL").cast("int") if "page" not in clean else F.when(clean["page"].rlike(r"^\d+$") & (clean["page"] != "0"), clean["page"].cast("int"))
    whole = clean["collection_id"].isNotNull() & clean["document_id"].isNotNull() & clean["book_title"].isNotNull()
    return F.when(
        whole,
        F.struct(
            clean["collection_id"].alias("collection_id"), clean["document_id"].alias("document_id"), clean["book_title"].alias("book_title"),
            page.alias("page"), clean["section"].alias("section"), F.coalesce(F.lower(clean["page_is_estimated"]) == "true", F.lit(False)).alias("page_is_estimated"),
        ),
    )


def sampled_pages(pages: DataFrame, *, key: str = "doc_id", number: str = "page_no", body: str = "text", total: int = 12_000, each: int = 1_500, least: int = 3) -> DataFrame:
    """Pages of each document, cut to ``each`` characters: all, or as many evenly spread ones as ``total`` holds, ``least`` at least."""
    most = max(least, total // each)
    own = Window.partitionBy(key)
    counted = pages.withColumns({"__i": F.row_number().over(own.orderBy(number)) - 1, "__n": F.count("*").over(own)})
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * ((F.col("__n") - 1) / F.lit(float(most - 1)))).cast("int"))
    taken = counted.where((F.col("__n") <= most) | F.array_contains(spread, F.col("__i")))
    return taken.select(key, number, F.left(body, F.lit(each)).alias("text"))
