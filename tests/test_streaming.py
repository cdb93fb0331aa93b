"""Streams run to the end give what their batch twins give."""

import uuid

from pyspark.sql import functions as F

from gradus.session import table
from gradus.streaming import events


def test_windows_equal_batch(spark, sf):
    batch = table(spark, sf, "events")
    source = events.read(spark, sf, batch.schema, glob="events.parquet")
    for length, slide in (("1 day", None), ("2 hours", "1 hour")):
        got = events.drained(events.windowed(source, length=length, slide=slide), f"w{uuid.uuid4().hex}")
        want = events.windowed(batch, length=length, slide=slide)
        cols = ["start", "event_type", "n", F.round("total", 4)]
        assert got.select(*cols).exceptAll(want.select(*cols)).isEmpty() and got.count() == want.count()


def test_sessions_equal_batch(spark, sf):
    batch = table(spark, sf, "events")
    source = events.read(spark, sf, batch.schema, glob="events.parquet")
    got = events.drained(events.sessions(source), f"s{uuid.uuid4().hex}", mode="complete")
    assert got.exceptAll(events.sessions(batch)).isEmpty()


def test_first_only(spark, sf, tmp_path):
    batch = table(spark, sf, "events")
    source = events.read(spark, sf, batch.schema, glob="events.parquet")
    got = events.drained(events.first_only(source, ["user_id"], "1000 days"), f"f{uuid.uuid4().hex}", mode="append")
    assert got.count() == batch.select("user_id").distinct().count()


def test_artifact_states(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a", "cache_build_started"), (2, "2024-01-01 00:00:01", "a", "artifact_built"), (3, "2024-01-01 00:00:02", "b", "artifact_failed")]
    frame = spark.createDataFrame(rows, "event_id long, ts string, artifact_key string, event string").withColumn("ts", F.to_timestamp("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    source = events.read(spark, str(tmp_path / "in"), frame.schema)
    got = events.drained(events.artifact_states(source, timeout_ms=None), f"a{uuid.uuid4().hex}", mode="update")
    assert {r.artifact_key: r.state for r in got.collect()} == {"a": "ready", "b": "failed"}


def test_upserts(spark, sf, tmp_path):
    seen = []
    source = events.read(spark, sf, table(spark, sf, "events").schema, glob="events.parquet")
    events.upserting(lambda rows, n: seen.append((n, rows.count())), source, str(tmp_path / "c")).awaitTermination()
    assert sum(n for _, n in seen) == table(spark, sf, "events").count()
