"""Control-plane state as tables: milestones, counts, plan writes, reuse of finished courses, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("lecture", "quiz", "slides", "section")
READY_STAGES = ("lecture", "quiz", "slides")


def seeded(books: DataFrame, existing: DataFrame | None = None, *, key: str = "book_id", weeks: str = "total_weeks", stages: tuple[str, ...] = STAGES) -> DataFrame:
    """(key, week, stage, status): the grid of every week and stage as pending, without what exists."""
    grid = books.where(F.col(weeks) >= 1).select(key, F.explode(F.sequence(F.lit(1), F.col(weeks).cast("int"))).alias("week"))
    grid = grid.withColumn("stage", F.explode(F.array(*map(F.lit, stages)))).withColumn("status", F.lit("pending"))
    return grid if existing is None else grid.join(existing.select(key, "week", "stage"), [key, "week", "stage"], "left_anti")


def milestones(events: DataFrame, *, keys: list[str], order: list[str], status: str = "status", ts: str = "ts") -> DataFrame:
    """The row that a sequence of upserts leaves for each key: last status, attempts (each run counts), first start, last finish."""
    running, done = F.col(status) == "running", F.col(status).isin("ready", "failed", "deferred")
    return events.groupBy(*keys).agg(
        F.max_by(status, F.struct(*order)).alias("status"), F.count_if(running).alias("attempts"),
        F.min(F.when(running, F.col(ts))).alias("started_at"), F.max(F.when(done, F.col(ts))).alias("finished_at"),
    )


def ready_weeks(marks: DataFrame, *, key: str = "book_id", stages: tuple[str, ...] = READY_STAGES) -> DataFrame:
    """(key, lectures_ready, weeks_complete): weeks whose lecture is ready, and weeks of which all stages are."""
    ready = marks.where((F.col("status") == "ready") & F.col("stage").isin(*stages))
    weeks = ready.groupBy(key, "week").agg(F.count_distinct("stage").alias("n"), F.bool_or(F.col("stage") == "lecture").alias("lecture"))
    return weeks.groupBy(key).agg(F.count_if("lecture").alias("lectures_ready"), F.count_if(F.col("n") == len(stages)).alias("weeks_complete"))


def tail_removed(weeks: DataFrame, last: Column) -> DataFrame:
    return weeks.where(F.col("week") <= last)


def merged_payload(old: Column, new: Column, dropped: tuple[str, ...] = ()) -> Column:
    """A map payload overwritten key by key, without the keys that a rewrite resets."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(new), k) & ~k.isin(*dropped) if dropped else ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def owned_or_null(payload: Column, owner: Column, tenant: Column) -> Column:
    """A quiz that the tenant made is kept on adoption; any other is reset."""
    return F.when(owner.eqNullSafe(tenant), payload)


def donors(wanted: DataFrame, courses: DataFrame, *, key: str = "course_id") -> DataFrame:
    """(key, donor): the earliest finished other course of equal fingerprint and plan."""
    plan = ["fingerprint", "total_weeks"]
    there = courses.where(F.col("finished")).select(F.col(key).alias("donor"), *plan)
    first = there.groupBy(*plan).agg(F.min("donor").alias("first"))
    # a course that is itself the earliest takes the second: two rows a plan, whatever the number of courses
    second = there.join(first, plan).where("donor > first").groupBy(*plan).agg(F.min("donor").alias("second"))
    met = wanted.select(key, *plan).join(first.join(second, plan, "left"), plan)
    return met.select(key, F.when(F.col(key) == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("donor")).where("donor IS NOT NULL").distinct()


def resumable(manifest_hash: Column, manifest_weeks: Column, source_hash: Column, weeks: Column) -> Column:
    """A generation resumes where source and plan are those of its manifest."""
    return manifest_hash.eqNullSafe(source_hash) & manifest_weeks.eqNullSafe(weeks)


def trace(tasks: DataFrame, *, key: str = "run_id") -> DataFrame:
    """(key, llm_calls, tool_calls, refusals, n_failed) over the task records of each run."""
    return tasks.groupBy(key).agg(
        F.sum("llm_calls").alias("llm_calls"), F.sum(F.size("tools")).alias("tool_calls"),
        F.count_if(F.col("state") == "refused").alias("refusals"), F.count_if(F.col("state") == "failed").alias("n_failed"),
    )


def settled(tasks: DataFrame, *, keys: list[str], most: int = 2) -> DataFrame:
    """Whether each stage is settled: succeeded or refused last, or out of attempts."""
    last = tasks.groupBy(*keys).agg(F.max_by("state", "attempt").alias("state"), F.max("attempt").alias("attempts"))
    return last.withColumn("settled", F.col("state").isin("succeeded", "refused") | (F.col("attempts") >= most))


def spans(events: DataFrame, *, by: list[str], ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events with the milliseconds since the one before of the same group."""
    before = F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(*by).orderBy(ts, order))
    return events.withColumn("latency_ms", (F.unix_micros(F.col(ts).cast("timestamp")) - before) / 1000.0)


def completeness(runs: DataFrame, *, key: str = "run_id") -> DataFrame:
    """Runs in which lectures and assessments cover exactly the selected topics."""
    sets = runs.groupBy(key).agg(*(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("topic_id")))).alias(k) for k in ("selected", "lecture", "assessment")))
    return sets.select(key, ((F.col("selected") == F.col("lecture")) & (F.col("selected") == F.col("assessment"))).alias("complete"))


def complete_weeks(artifacts: DataFrame, *, by: str = "book_id", lecture: str = "lecture", script: str = "script") -> DataFrame:
    """(by, n_complete): how many weeks have slides and segments, by the lengths of the lists in their payloads (JSON texts); what is no list counts as none."""
    filled = lambda c, field: F.coalesce(F.json_array_length(F.get_json_object(c, f"$.{field}")) > 0, F.lit(False))
    return artifacts.groupBy(by).agg(F.count_if(filled(lecture, "slides") & filled(script, "segments")).alias("n_complete"))


def trace_details(tasks: DataFrame, *, key: str = "run_id", order: list[str]) -> DataFrame:
    """(key, servings, states): all servings of a run's tasks in order, and the last state of each stage."""
    each = F.array_sort(F.collect_list(F.struct(*order, F.coalesce("servings", F.array().cast(dict(tasks.dtypes)["servings"])).alias("served"))))
    served = tasks.groupBy(key).agg(F.flatten(F.transform(each, lambda x: x["served"])).alias("servings"))
    last = tasks.groupBy(key, "stage").agg(F.max_by("state", F.struct(*order)).alias("state"))
    states = last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "state")))).alias("states"))
    return served.join(states, key)


def compared(a: Column, b: Column) -> Column:
    """Struct (equal, within): whether two arrays have the same members, and whether the first has none that the second lacks; null counts as empty."""
    left, right = (F.coalesce(x, F.array().cast("array<string>")) if isinstance(x, str) else x for x in (a, b))
    within = F.size(F.array_except(left, right)) == 0
    return F.struct((within & (F.size(F.array_except(right, left)) == 0)).alias("equal"), within.alias("within"))
