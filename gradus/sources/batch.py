"""Batch ingestion: load, chunk and index many documents as one run, with an outcome a document.

A run appends its chunks beside those of earlier runs and is then committed by publishing the list of runs (see ``versions``), so readers
see all of it or nothing. ``current`` reads, of each document, the chunks of the last committed run that has it. What a
lost run wrote is never read, and its id can be used again after ``discard``.

Loading may be an injected function of the raw content; it is tried again, row by row if a batch fails, so one document that cannot be read
costs no other (see ``injected``). Errors that no further attempt can mend are not marked as retryable.

Defined results: documents without text (null, blank, or not loaded) fail with a reason and keep what earlier runs indexed of them;
an empty batch commits a run without chunks; a document that comes twice in one run is an error of its own, as its chunks could not be told apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, injected
from ..session import cut
from . import ingest, sinks, versions

NO_TEXT, TWICE = "NoText", "DuplicateDocument"
RUNS = "run string, number long, n_documents long, n_chunks long"


@dataclass(frozen=True)
class Run:
    """``outcomes``: (key, ok, n_chunks, attempts, error, retryable) a document; ``manifest`` of the commit."""

    outcomes: DataFrame
    manifest: versions.Manifest


def loaded(documents: DataFrame, loader: Callable | None, *, content: str = "content", text: str = "text", attempts: int = ingest.MOST) -> DataFrame:
    """``documents`` with ``text``, attempts and error: by ``loader`` (a function of a pandas series of contents), or the text as it is."""
    if loader is None:
        error = F.col("error") if "error" in documents.columns else F.lit(None).cast("string")
        return documents.withColumns({"attempts": F.lit(1), "error": error})
    made = documents.withColumn("__made", injected.applied(loader, "string", content, attempts=attempts))
    return made.withColumns({text: F.col("__made.value"), "attempts": F.col("__made.attempts"), "error": F.col("__made.error")}).drop("__made", content)


def ingested(documents: DataFrame, path: str, run: str, *, tenant: Column, key: str = "document_id", loader: Callable | None = None, chunks: Callable[..., DataFrame] = chunking.recursive_chunks, attempts: int = ingest.MOST) -> Run:
    """Index ``documents`` (key, text; or content with a ``loader``) under ``path`` as ``run``."""
    spark = documents.sparkSession
    rows = loaded(documents, loader, attempts=attempts)
    twice = F.count("*").over(Window.partitionBy(key)) > 1
    blank = F.coalesce(X.strip(F.col("text")) == "", F.lit(True))
    reason = F.when(twice, TWICE).when(F.col("error").isNotNull(), F.col("error")).when(blank, NO_TEXT)
    judged = cut(rows.select(key, "text", "attempts", reason.alias("error")))

    made = chunks(judged.where("error IS NULL").select(key, "text"), key=key).withColumn("user_id", tenant)
    ingest.index_run([made], f"{path}/chunks", run)
    counts = _chunks(spark, path, run).groupBy(key).agg(F.count("*").alias("n_chunks")) if _wrote(spark, path, run) else judged.where("false").select(key, F.lit(0).cast("long").alias("n_chunks"))
    outcomes = judged.groupBy(key).agg(F.max("attempts").alias("attempts"), F.max("error").alias("error")).join(counts, key, "left")
    final = F.col("error").isin(*ingest.PERMANENT_NAMES, NO_TEXT, TWICE, injected.WRONG_LENGTH)
    outcomes = cut(outcomes.select(key, F.col("error").isNull().alias("ok"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "attempts", "error", (F.col("error").isNotNull() & ~final).alias("retryable")))
    total = outcomes.agg(F.count_if("ok").alias("d"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("c")).first()
    return Run(outcomes, _committed(spark, path, run, total["d"], total["c"]))


def _committed(spark: SparkSession, path: str, run: str, documents: int, chunks: int) -> versions.Manifest:
    """Publish the list of runs with this one; a list that another run has changed meanwhile is read again."""
    store = versions.Store(spark, f"{path}/runs")
    for _ in range(versions.MOST):
        last = store.latest()
        number = last.number if last else 0
        row = spark.createDataFrame([(run, number + 1, documents, chunks)], RUNS)
        runs = store.of(last).unionByName(row) if last else row
        try:
            return store.publish(runs.coalesce(1), expected=number, note=run)
        except versions.Outdated:
            continue
    raise versions.Outdated(f"{path}: other runs were committed {versions.MOST} times")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The committed runs, in the order of their commits."""
    return versions.current(spark, f"{path}/runs")


def _wrote(spark: SparkSession, path: str, run: str) -> bool:
    files, place = ingest._folder(spark, f"{path}/chunks/indexing_run_id={run}")
    return bool(files.exists(place))


def _chunks(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/chunks")
    return rows if run is None else rows.where(F.col("indexing_run_id") == run)


def current(spark: SparkSession, path: str, *, keys: tuple[str, ...] = ("user_id", "document_id")) -> DataFrame:
    """The chunks that count: of each document those of the last committed run that has it."""
    known = runs(spark, path).select(F.col("run").alias("indexing_run_id"), "number")
    return sinks.latest_generation(_chunks(spark, path).join(F.broadcast(known), "indexing_run_id"), keys=keys, generation="indexing_run_id", committed="number").drop("number")


def discard(spark: SparkSession, path: str, run: str) -> bool:
    """Remove what a run that was never committed wrote; a committed one stays."""
    store = versions.Store(spark, f"{path}/runs")
    if store.latest() is not None and not store.read().where(F.col("run") == run).isEmpty():
        return False
    files, place = ingest._folder(spark, f"{path}/chunks/indexing_run_id={run}")
    return bool(files.delete(place, True))
