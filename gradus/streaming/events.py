"""Structured Streaming over event logs: an extension beyond batch state, each query with a batch twin."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: StructType | str, *, files: int | None = None, glob: str | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder; timestamps without zone are taken as UTC."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def windowed(events: DataFrame, *, length: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; works on streams and batches alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    grouped = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_only(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """One event of each key within the watermark: builds of one artifact happen once."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if timed.isStreaming else timed.dropDuplicates(keys)


def artifact_states(events: DataFrame, *, key: str = "artifact_key", timeout_ms: int | None = 60_000) -> DataFrame:
    """(key, state, n_events) after each batch of a stream of events; a build without news for ``timeout_ms`` turns stale.

    A query with timeouts never runs out of batches; give None where it is to end with its input.
    """
    from ..operators.grants import STATES

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, n = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "state": ["stale"], "n_events": [n]})
            return
        now, n = state.get if state.exists else ("absent", 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for event in rows["event"]:
            now = STATES.get(event, now)
        n += len(rows)
        state.update((now, n))
        if now == "building" and timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [keys[0]], "state": [now], "n_events": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, state string, n_events long", "state string, n long", "update", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def drained(stream: DataFrame, name: str, *, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """All that a stream holds now, run to the end into a memory table."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def upserting(merge: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str):
    """Each micro-batch handed to ``merge(rows, batch number)``; the checkpoint makes replays idempotent by number."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
