"""Ingestion that fails softly: attempts, runs that are there as a whole or not at all, and checks of what belongs together."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import versions

MOST = 3
#: Errors that no further attempt can mend.
PERMANENT = (FileNotFoundError, IsADirectoryError, NotADirectoryError, PermissionError, ImportError, ValueError, TypeError, KeyError)
PERMANENT_NAMES = ("FileNotFoundError", "IsADirectoryError", "NotADirectoryError", "PermissionError", "ImportError", "ValueError", "TypeError", "KeyError")


def tried(work: Callable[..., Any], *args: Any, most: int = MOST, delay: float = 0.0, permanent: tuple[type[BaseException], ...] = PERMANENT) -> dict[str, Any]:
    """The outcome of ``work(*args)``: value, attempts, error, retryable. Never raises but on cancellation, so one document does not stop a batch."""
    if most < 1:
        raise ValueError("one attempt at least is needed")
    for attempt in range(1, most + 1):
        try:
            return {"value": work(*args), "attempts": attempt, "error": None, "retryable": False}
        except Exception as error:  # the outcome records it
            final = isinstance(error, permanent)
            if final or attempt == most:
                return {"value": None, "attempts": attempt, "error": f"{type(error).__name__}: {error}", "retryable": not final}
        if delay:
            time.sleep(delay)
    raise AssertionError("unreachable")


def attempts(outcomes: Column, most: int = MOST) -> Column:
    """Struct (attempts, ok, error, retryable) of an array of error names in order, null for a success; null where the log is too short to tell."""
    seen = F.slice(outcomes, 1, most)
    marks = F.transform(seen, lambda e, i: F.struct((i + 1).alias("at"), e.alias("error"), (e.isNull() | e.isin(*PERMANENT_NAMES) | (i + 1 == most)).alias("last")))
    last = F.get(F.filter(marks, lambda m: m["last"]), 0)
    error = last["error"]
    made = F.struct(last["at"].alias("attempts"), error.isNull().alias("ok"), error.alias("error"), (error.isNotNull() & ~error.isin(*PERMANENT_NAMES)).alias("retryable"))
    return F.when(last.isNotNull(), made)


def _folder(spark: SparkSession, path: str) -> tuple[Any, Any]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def index_run(batches: Iterable[DataFrame], path: str, run: str) -> int:
    """Append batches as one run; if any fails, what the run wrote goes and older runs stay. Returns the number of batches.

    Each batch is committed by Spark as a whole; the run is a partition of its own, so it is removed as a folder. A run
    that exists already is refused before anything is written, so that a failure never removes what an earlier run wrote.
    """
    if not run.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a run id holds letters, digits, dashes and underscores")
    done, own = 0, None
    try:
        for batch in batches:
            if own is None:
                files, place = _folder(batch.sparkSession, f"{path}/indexing_run_id={run}")
                if files.exists(place):
                    raise FileExistsError(f"the run {run} exists")
                own = files, place
            batch.withColumn("indexing_run_id", F.lit(run)).write.mode("append").partitionBy("indexing_run_id").parquet(path)
            done += 1
    except BaseException:
        if own is not None:
            own[0].delete(own[1], True)
        raise
    return done


def replace_json(rows: DataFrame, path: str) -> None:
    """Replace a JSON table as a whole; see ``versions``. ``read_json`` reads what was published last."""
    versions.publish(rows, path, format="json")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return versions.current(spark, path)


def append_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(path)


def catalog_problems(ids: DataFrame, routes: DataFrame, files: DataFrame, *, key: str = "id") -> DataFrame:
    """(id, problem): ids without a route or a file, and routes and files without an id; none means that they match one to one."""
    side = lambda rows, name: rows.select(key).distinct().withColumn(name, F.lit(True))
    met = side(ids, "i").join(side(routes, "r"), key, "full").join(side(files, "f"), key, "full")
    known, routed, filed = (F.col(c).isNotNull() for c in "irf")
    problems = F.array_compact(F.array(F.when(known & ~routed, "unrouted"), F.when(known & ~filed, "no_file"), F.when(~known & routed, "unknown_route"), F.when(~known & filed, "unknown_file")))
    return met.select(key, F.explode(problems).alias("problem"))


def heartbeat_gaps(beats: DataFrame, *, by: str, ts: str = "ts", order: str = "event_id", most: float = 15.0) -> DataFrame:
    """(by, n_gaps, longest_s): how often a job was silent for more than ``most`` seconds."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    waits = beats.select(by, ((at - F.lag(at).over(Window.partitionBy(by).orderBy(ts, order))) / 1e6).alias("wait"))
    return waits.groupBy(by).agg(F.count_if(F.col("wait") > most).alias("n_gaps"), F.max("wait").alias("longest_s"))
