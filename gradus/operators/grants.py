"""Grants and artifacts: who may see what, and the life of cached artifacts, replayed from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUILD_TIMEOUT_S = 60


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: the state that an append-only log stands for."""
    ranked = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return events.withColumn("__n", F.row_number().over(ranked)).where("__n = 1").drop("__n")


def active(grants: DataFrame, *, user: str | None = None, collection: str | None = None, titles: list[str] | None = None) -> DataFrame:
    rows = grants.where("state = 'active'")
    if user is not None:
        rows = rows.where(F.col("user_id") == user)
    if collection is not None:
        rows = rows.where(F.col("collection_id") == collection)
    return rows.where(F.col("book_title").isin(titles)) if titles else rows


def authorized(chunks: DataFrame, grants: DataFrame) -> DataFrame:
    """Chunks of documents with an active grant of the same user, decided before any scoring."""
    return chunks.join(grants.where("state = 'active'").select("user_id", "document_id"), ["user_id", "document_id"], "left_semi")


def refcounts(grants: DataFrame) -> DataFrame:
    """(artifact_key, n_active) of every artifact that was ever granted."""
    return grants.groupBy("artifact_key").agg(F.count_if(F.col("state") == "active").alias("n_active"))


def unreferenced(grants: DataFrame) -> DataFrame:
    """Artifacts that were granted once and have no active grant now."""
    alive = grants.where("state = 'active'").select("artifact_key").distinct()
    return grants.select("artifact_key").distinct().join(alive, "artifact_key", "left_anti")


def granted(grants: DataFrame, wanted: DataFrame) -> DataFrame:
    """``grants`` after granting ``wanted``: an equal active grant stays; one on another artifact is revoked; rows are never deleted."""
    keys = ["user_id", "document_id"]
    new = wanted.select(*keys, F.col("artifact_key").alias("__new")).distinct()
    kept = grants.join(new, keys, "left").withColumn(
        "state", F.when((F.col("state") == "active") & F.col("__new").isNotNull() & (F.col("__new") != F.col("artifact_key")), "revoked").otherwise(F.col("state"))
    )
    same = grants.where("state = 'active'").select(*keys, "artifact_key")
    return kept.drop("__new").unionByName(wanted.join(same, [*keys, "artifact_key"], "left_anti").select(*grants.columns))


def revocations(grants: DataFrame, revoked: DataFrame) -> DataFrame:
    """(user_id, document_id, artifact_key, last_reference): what revoking does to each active grant of ``revoked``."""
    gone = grants.where("state = 'active'").join(revoked.select("user_id", "document_id").distinct(), ["user_id", "document_id"])
    lost = gone.groupBy("artifact_key").agg(F.count("*").alias("lost"))
    return gone.join(lost, "artifact_key").join(refcounts(grants), "artifact_key").select("user_id", "document_id", "artifact_key", (F.col("lost") == F.col("n_active")).alias("last_reference"))


#: Events of a cached artifact and the states that they lead to.
STATES = {
    "cache_build_started": "building", "cache_build_recovered": "building", "cache_build_retried": "building",
    "artifact_built": "ready", "artifact_failed": "failed", "artifact_corrupt": "corrupt", "artifact_cleanup": "removed",
}


def state_of(event: Column) -> Column:
    state = F.lit(None).cast("string")
    for name, value in STATES.items():
        state = F.when(event == name, value).otherwise(state)
    return state


def states(events: DataFrame, *, key: str = "artifact_key", order: list[str] | None = None, state: Column | None = None) -> DataFrame:
    """(key, state, since, n_builds): the last state of each artifact; events that change none are passed over."""
    order = order or ["ts", "event_id"]
    moved = events.withColumn("__state", state_of(F.col("event")) if state is None else state).where(F.col("__state").isNotNull())
    return moved.groupBy(key).agg(
        F.max_by("__state", F.struct(*order)).alias("state"), F.max_by("ts", F.struct(*order)).alias("since"),
        F.count_if(F.col("__state") == "building").alias("n_builds"),
    )


def stale(state: Column, since: Column, now: Column, timeout: int = BUILD_TIMEOUT_S) -> Column:
    """A build that started over ``timeout`` seconds ago, or at an unknown time, may be taken over."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return (state == "building") & F.coalesce(age > timeout * 1_000_000, F.lit(True))


def claim(state: Column, is_stale: Column) -> Column:
    """What a builder that asks for an artifact gets."""
    return F.when(state == "ready", "ready").when((state == "building") & ~is_stale, "wait").when(state == "building", "recovered").otherwise("claimed")


def verified(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """(artifact_key, reusable, mismatch): records held against their payloads; the first mismatch is named."""
    joined = records.join(payloads.select("artifact_key", F.col("content_hash").alias("p_hash"), F.col("byte_size").alias("p_size"), "chunk_count"), "artifact_key", "left")
    mismatch = (
        F.when(F.col("p_hash").isNull(), "payload_missing").when(F.col("byte_size") != F.col("p_size"), "length")
        .when(F.col("content_hash") != F.col("p_hash"), "hash").when(F.coalesce("chunk_count", F.lit(0)) == 0, "empty")
    )
    return joined.select("artifact_key", mismatch.isNull().alias("reusable"), mismatch.alias("mismatch"))


def built_once(requests: DataFrame) -> DataFrame:
    """The first request of each artifact builds it; the others wait for it."""
    order = Window.partitionBy("artifact_key").orderBy("ts", "request_id")
    return requests.withColumn("role", F.when(F.row_number().over(order) == 1, "build").otherwise("hit"))


def ingestion_report(results: DataFrame) -> DataFrame:
    """One row over document outcomes (ok, chunks): counts, and whether all, some or none went well."""
    return results.agg(
        F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("chunks"))), F.lit(0)).alias("chunks_indexed")
    ).withColumns({
        "complete": (F.col("failed") == 0) & (F.col("succeeded") > 0), "partial": (F.col("failed") > 0) & (F.col("succeeded") > 0), "total_failure": (F.col("succeeded") == 0) & (F.col("failed") > 0),
    })


def document_list(chunks: DataFrame, *, by: list[str], title: str, order: str = "chunk_index") -> DataFrame:
    """One row a document: its first attributes and its number of chunks."""
    return chunks.groupBy(*by).agg(F.min_by(title, order).alias(title), F.count("*").alias("n_chunks"))


def collection_stats(points: DataFrame, *, vector: str, document: str) -> DataFrame:
    return points.agg(F.count("*").alias("n_points"), F.count(vector).alias("n_vectors"), F.count_distinct(document).alias("n_documents"))
