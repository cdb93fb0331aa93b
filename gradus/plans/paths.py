"""Learning paths over books, and programmes of topics: order, warnings, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

CONFIDENCE = 0.70


def checked(proposals: DataFrame, books: DataFrame, *, confidence: float = CONFIDENCE) -> DataFrame:
    """Proposals (prerequisite, dependent, confidence, ambiguous, evidence arrays of document_id, page, section) with ``accepted`` and their warnings."""
    own = books.select("book_id", "document_id")
    left = own.select(F.col("book_id").alias("prerequisite"), F.col("document_id").alias("__left"))
    right = own.select(F.col("book_id").alias("dependent"), F.col("document_id").alias("__right"))
    rows = proposals.join(left, "prerequisite", "left").join(right, "dependent", "left")

    def backed(evidence: str, document: str) -> Column:
        whole = lambda e: (e["document_id"] == F.col(document)) & e["page"].isNotNull() & (F.coalesce(e["section"], F.lit("")) != "")
        return (F.size(evidence) > 0) & F.forall(evidence, whole)

    unknown = F.col("__left").isNull() | F.col("__right").isNull() | (F.col("prerequisite") == F.col("dependent"))
    bare = ~F.coalesce(backed("prerequisite_evidence", "__left") & backed("dependent_evidence", "__right"), F.lit(False))
    fine = ~unknown & ~bare
    warnings = F.array_compact(F.array(
        F.when(unknown, "invalid_reference"), F.when(~unknown & bare, "missing_evidence"),
        F.when(fine & (F.col("confidence") < confidence), "low_confidence"), F.when(fine & F.col("ambiguous"), "ambiguous_ordering"),
    ))
    return rows.withColumns({"accepted": fine, "warnings": warnings}).drop("__left", "__right")


def ordered(books: DataFrame, edges: DataFrame, *, by: str = "collection_id") -> DataFrame:
    """(by, book_id, position, cyclic): prerequisites first, ties by the given order; with a cycle the given order stands."""
    deep = graph.layers_by(edges.select(by, F.col("dependent").alias("child"), F.col("prerequisite").alias("parent")), books.select(by, F.col("book_id").alias("node")), by=by)
    rows = books.select(by, "book_id", "upload_order").join(deep.withColumnRenamed("node", "book_id"), [by, "book_id"])
    stuck = F.bool_or(F.col("level").isNull()).over(Window.partitionBy(by))
    order = Window.partitionBy(by).orderBy(F.when(~stuck, F.col("level")), "upload_order", "book_id")
    return rows.select(by, "book_id", F.row_number().over(order).alias("position"), F.col("level").isNull().alias("cyclic"))


def offsets(rows: DataFrame, *, by: str, order: str = "position", weeks: str = "week_count") -> DataFrame:
    """Serial books with their first and last global week."""
    run = F.sum(weeks).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("ends_at", run).withColumn("starts_at", F.col("ends_at") - F.col(weeks) + 1)


def shared_chapters(chapters: DataFrame, *, book: str = "book_id", title: str = "title") -> DataFrame:
    """(a, b, shared): pairs of books a < b with equal chapter titles, white space and case aside."""
    rows = chapters.select(F.col(book).alias("book"), F.lower(F.trim(F.col(title))).alias("title")).distinct()
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.title") == F.col("y.title")) & (F.col("x.book") < F.col("y.book")))
    return met.groupBy(F.col("x.book").alias("a"), F.col("y.book").alias("b")).agg(F.array_sort(F.collect_set("x.title")).alias("shared"))


def duplicate_editions(books: DataFrame, *, title: str = "title", edition: str = "edition", book: str = "book_id") -> DataFrame:
    """(title, edition, books) of titles and editions that several books have; a missing edition is one of its own."""
    groups = books.groupBy(F.lower(F.col(title)).alias("title"), F.col(edition).alias("edition")).agg(F.array_sort(F.collect_list(book)).alias("books"))
    return groups.where(F.size("books") > 1)


def disconnected(books: DataFrame, edges: DataFrame) -> DataFrame:
    met = edges.select(F.col("prerequisite").alias("book_id")).unionByName(edges.select(F.col("dependent").alias("book_id")))
    return books.join(met, "book_id", "left_anti")


def approved(path: DataFrame, chosen: DataFrame) -> DataFrame:
    """A path's books in the order that a reviewer selected; books of paths without a selection keep theirs."""
    return path.join(chosen.select("book_id", F.col("position").alias("__chosen")), "book_id", "left").withColumn("position", F.coalesce("__chosen", "position")).drop("__chosen")


def heaviest(topics: DataFrame, *, by: str, hours: str = "total_hours", key: str = "topic_id") -> DataFrame:
    """The topic of most hours of each programme; of equal ones the smallest id."""
    return topics.groupBy(by).agg(F.min_by(key, F.struct((-F.col(hours)).alias("h"), key)).alias(key), F.max(hours).alias(hours), F.round(F.sum(hours), 2).alias("all_hours"))


def coverage(topics: DataFrame, *, by: str, document: str = "document_id") -> DataFrame:
    """(by, document, n_citations): how often each source is cited."""
    return topics.groupBy(by, document).agg(F.count("*").alias("n_citations"))
