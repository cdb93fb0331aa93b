"""Sinks: partitioned appends, replacement by key, JSON artifacts, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identity


def append(points: DataFrame, path: str, tenant: str = "user_id") -> None:
    """Append by tenant; the commit protocol publishes all files of the write or none."""
    points.write.mode("append").partitionBy(tenant).parquet(path)


def latest_generation(points: DataFrame, *, keys: tuple[str, ...] = ("user_id", "document_id"), generation: str = "ingestion_id", committed: str | None = None) -> DataFrame:
    """Rows of the last generation of each key: what replacing by key leaves.

    ``committed`` (a time or a sequence number) tells which generation came last: one counts from its last row on,
    one without a time is the oldest, and the id breaks ties. Only numbers may stand for their own order.
    """
    if committed is None and not isinstance(points.schema[generation].dataType, T.NumericType):
        raise ValueError(f"the order of {generation} is not that of commits: name a column of commit times")
    at = generation if committed is None else committed
    newest = points.groupBy(*keys).agg(F.max_by(generation, F.struct(F.col(at).isNotNull(), at, generation)).alias("__newest"))
    same = reduce(lambda a, b: a & b, (points[k].eqNullSafe(newest[k]) for k in keys)) & points[generation].eqNullSafe(newest["__newest"])
    return points.join(newest, same, "left_semi")


def replaced(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("user_id", "document_id")) -> DataFrame:
    """``existing`` without the keys of ``new``, and ``new``."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which ``condition`` is not true; unknown counts as not true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def other_versions(preserve: str, user: str, document: str) -> Column:
    """Points of a document whose generation is not ``preserve``; a missing generation is another one."""
    return (F.col("user_id") == user) & (F.col("document_id") == document) & ~F.col("ingestion_id").eqNullSafe(F.lit(preserve))


def upserted(existing: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key over both, ``changes`` winning ties."""
    both = existing.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)))
    rank = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("__side"))
    return both.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n", "__side")


def weekly_json(rows: DataFrame, path: str, tenant: str = "user_id") -> None:
    """One folder a tenant and week."""
    rows.write.mode("overwrite").partitionBy(tenant, "week").json(path)


def report_markdown(report: dict, cases: list[dict]) -> str:
    """An evaluation report as Markdown."""
    head = ["# Retrieval evaluation", "", "| metric | value | threshold | passed |", "|---|---|---|---|"]
    head += [f"| {m['metric']} | {m['value']} | {m['threshold']} | {'yes' if m['passed'] else 'no'} |" for m in report["metrics"]]
    body = ["", f"Verdict: {'PASS' if report['passed'] else 'FAIL'} over {len(cases)} cases", "", "| case | precision | recall | reciprocal rank |", "|---|---|---|---|"]
    return "\n".join(head + body + [f"| {c['case_id']} | {c['precision']} | {c['recall']} | {c['rr']} |" for c in cases]) + "\n"


def deleted(points: DataFrame, requests: DataFrame, *, tenant: str = "user_id", document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """What is left of ``points``, and (request columns, document, n_deleted) of every request (tenant, collection_id, source_filename).

    The id of a document is derived from its collection and name, never taken from the caller, and points are counted before they go.
    A request for what is not there deletes nothing and says so; equal requests count once.
    """
    made = requests.select(tenant, "collection_id", "source_filename").distinct().withColumn(document, identity.document_id(F.col("collection_id"), F.col("source_filename")))
    counts = points.join(made.select(tenant, document), [tenant, document], "left_semi").groupBy(tenant, document).agg(F.count("*").alias("n_deleted"))
    report = made.join(counts, [tenant, document], "left").withColumn("n_deleted", F.coalesce("n_deleted", F.lit(0)))
    return points.join(made.select(tenant, document), [tenant, document], "left_anti"), report
