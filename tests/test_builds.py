"""Live builds against rules by hand and against the batch twin, with restarts from a checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from gradus.streaming import builds, events

SHAPE = "event_id long, t long, artifact_key string, event string"
START = 1_700_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, SHAPE).select("event_id", F.timestamp_seconds(F.lit(START) + F.col("t")).alias("ts"), "artifact_key", "event")


def decided(df):
    return sorted((r.artifact_key, r.at_ms // 1000 - START, r.request_id, r.decision) for r in df.collect())


def test_rules(spark):
    rows = [
        (1, 0, "a", "request"), (2, 1, "a", "request"), (3, 2, "a", "request"), (4, 30, "a", "artifact_failed"), (5, 40, "a", "artifact_built"), (6, 50, "a", "request"), (7, 55, "a", "artifact_corrupt"), (8, 56, "a", "request"),
        (9, 0, "b", "request"), (10, 5, "b", "request"), (11, 70, "b", "request"), (12, 200, "b", "request"),
        (13, 0, "c", "request"), (14, 100, "c", "request"), (15, 101, "c", "artifact_cleanup"), (16, 102, "c", "request"), (17, 103, "c", "something"), (18, 103, "c", "artifact_built"), (19, 104, "c", "request"),
        (20, 5, "d", "artifact_built"), (21, 5, "d", "request"), (20, 5, "d", "artifact_built"), (21, 5, "d", "request"), (22, None, "d", "request"), (23, 6, None, "request"), (24, 7, "d", None),
    ]
    assert decided(builds.replayed(frame(spark, rows))) == sorted([
        ("a", 0, 1, "build"), ("a", 1, 2, "wait"), ("a", 2, 3, "wait"), ("a", 30, 2, "retried"), ("a", 40, 3, "served"), ("a", 50, 6, "reuse"), ("a", 56, 8, "retried"),
        ("b", 0, 9, "build"), ("b", 5, 10, "wait"), ("b", 60, 10, "recovered"), ("b", 70, 11, "wait"), ("b", 120, 11, "recovered"), ("b", 200, 12, "recovered"),
        ("c", 0, 13, "build"), ("c", 100, 14, "recovered"), ("c", 102, 16, "build"), ("c", 104, 19, "reuse"), ("d", 5, 21, "reuse"),
    ])
    assert builds.replayed(frame(spark, rows).limit(0)).count() == 0


def test_a_waiter_gives_up():
    one = builds.Artifact()
    assert one.take(1, 0, "request") == [(0, 1, "build")]
    assert one.take(2, 10, "request") == [(10, 2, "wait")]
    assert one.take(1, 50, "artifact_failed") == [(50, 2, "retried")]  # the build begins anew
    one.take(3, 51, "request")
    one.take(4, 52, "request")
    assert one.until(None, 60) == [(110, 3, "recovered"), (112, 4, "timed_out")]
    assert one.state == "abandoned" and one.idle


def drawn(seed, n, keys=4, span=900):
    rng = random.Random(seed)
    names = ["request"] * 6 + ["artifact_built", "artifact_failed", "artifact_corrupt", "artifact_cleanup", "noise"]
    return [(i, rng.randrange(span), rng.choice("abcdefgh"[:keys]), rng.choice(names)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_live_is_the_batch_twin_after_a_restart(spark, tmp_path, seed):
    """Files arrive one a batch, out of order within the allowed lateness; the query is stopped and goes on from its checkpoint."""
    rows = sorted(drawn(seed, 160), key=lambda r: r[1] + random.Random(r[0]).randrange(60))
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = frame(spark, rows[:1]).schema

    def run():
        stream = builds.live(events.read(spark, folder, schema, files=1), late="90 seconds")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    for part in (rows[:80], rows[80:]):
        for i in range(0, len(part), 27):
            frame(spark, part[i : i + 27]).coalesce(1).write.mode("append").parquet(folder)
        run()
    limit = (START + max(t for _, t, _, _ in rows) - 90) * 1000
    got = decided(spark.read.parquet(out))
    assert got == decided(builds.replayed(frame(spark, rows), until_ms=limit)) and len(got) > 60
    assert {d for *_, d in got} >= {"build", "wait", "served", "reuse", "retried", "recovered"}


class Line(list):
    """Waiters that may not be gone through one by one."""

    def __iter__(self):
        raise AssertionError("all waiters were gone through")


def test_when_something_is_due_does_not_go_through_the_waiters():
    assert builds.Artifact("building", 0, Line([[1, 5], [2, 6]])).due(60) == 60
    assert builds.Artifact("failed", 0, Line([[1, 5], [2, 6]])).due(60) == 65
    assert builds.Artifact().due(60) is None and builds.Artifact("building", 3).due(60) == 63


def test_a_burst_of_requests(spark):
    rows = [(i, 0, "k", "request") for i in range(3000)] + [(3000, 10, "k", "artifact_built")]
    got = decided(builds.replayed(frame(spark, rows)))
    want = [("k", 0, 0, "build")] + [("k", 0, i, "wait") for i in range(1, 3000)] + [("k", 10, i, "served") for i in range(1, 3000)]
    assert got == sorted(want)
