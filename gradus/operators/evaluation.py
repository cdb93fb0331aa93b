"""Retrieval metrics, the report over cases, and judge scorecards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import injected

RECALL, FAITHFULNESS = 0.60, 0.70


def precision(relevant: Column, retrieved: Column) -> Column:
    """Mean of hits / rank over the ranks at which a relevant id shows for the first time; repeats take up ranks but are no hits."""
    start = F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("total"), F.lit(1).alias("rank"), F.array().cast("array<string>").alias("seen"))

    def step(s: Column, x: Column) -> Column:
        hit = F.array_contains(relevant, x) & ~F.array_contains(s["seen"], x)
        hits = s["hits"] + hit.cast("int")
        return F.struct(
            hits.alias("hits"), (s["total"] + F.when(hit, hits / s["rank"]).otherwise(0.0)).alias("total"), (s["rank"] + 1).alias("rank"),
            F.when(hit, F.concat(s["seen"], F.array(x))).otherwise(s["seen"]).alias("seen"),
        )

    return F.aggregate(retrieved, start, step, lambda s: F.when(s["hits"] == 0, 0.0).otherwise(F.round(s["total"] / s["hits"], 6)))


def recall(relevant: Column, retrieved: Column) -> Column:
    asked = F.array_distinct(relevant)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(asked, retrieved)) / F.size(asked), 6))


def reciprocal_rank(relevant: Column, retrieved: Column) -> Column:
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(F.round(1.0 / F.array_min(ranks), 6), F.lit(0.0))


def scored(cases: DataFrame) -> DataFrame:
    """Cases (relevant, retrieved arrays) with precision, recall and rr."""
    r, t = F.col("relevant"), F.col("retrieved")
    return cases.withColumns({"precision": precision(r, t), "recall": recall(r, t), "rr": reciprocal_rank(r, t)})


def report(scores: DataFrame, *, expected: int | None = None, least_recall: float = RECALL, least_faithfulness: float = FAITHFULNESS) -> DataFrame:
    """One row: case count, rounded means without nulls, and the verdict on thresholds and count."""
    faith = F.round(F.avg("faithfulness"), 6) if "faithfulness" in scores.columns else F.lit(None).cast("double")
    means = scores.agg(
        F.count("*").alias("n_cases"), F.round(F.avg("precision"), 6).alias("context_precision"), F.round(F.avg("recall"), 6).alias("context_recall"),
        F.round(F.avg("rr"), 6).alias("mrr"), faith.alias("faithfulness"),
    )
    fine = (F.col("context_recall") >= least_recall) & (F.col("faithfulness").isNull() | (F.col("faithfulness") >= least_faithfulness))
    fine = fine & (F.col("n_cases") > 0 if expected is None else F.col("n_cases") == expected)
    return means.withColumn("passed", F.coalesce(fine, F.lit(False)))


def judge_scores(raw: Column, allowed: tuple[str, ...] = ("faithfulness", "answer_relevancy", "score", "reasoning")) -> Column:
    """A scorecard struct from a judge's reply; null where the JSON is none, holds other fields, or a score is no number in 0..1."""
    parsed = F.from_json(raw, "map<string,string>")
    keys = F.json_object_keys(raw)
    number = lambda k: F.when(F.get_json_object(raw, f"$.{k}").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), F.get_json_object(raw, f"$.{k}").try_cast("double"))
    faithful, relevancy = F.coalesce(number("faithfulness"), number("score")), F.coalesce(number("answer_relevancy"), number("score"))
    known = F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0
    fine = parsed.isNotNull() & known & faithful.between(0, 1) & relevancy.between(0, 1)
    return F.when(fine, F.struct(faithful.alias("faithfulness"), relevancy.alias("answer_relevancy")))


def judged(cases: DataFrame, judge: Callable | None = None, *, inputs: tuple[str, ...] = ("query", "answer"), attempts: int = injected.ATTEMPTS) -> DataFrame:
    """``cases`` with faithfulness, answer_relevancy, judge_error and judge_attempts of each.

    Without a judge the scores are those that the cases hold (a map ``judge``); with one, a function of pandas series that returns
    a reply (a JSON text) a row, each reply must be a scorecard. A case whose reply is none, or that the judge fails
    for in every attempt, has no scores and the reason: it lowers no mean and stops no other.
    """
    if judge is None:
        held = F.col("judge")
        return cases.withColumns({"faithfulness": held["faithfulness"], "answer_relevancy": held["answer_relevancy"], "judge_error": F.lit(None).cast("string"), "judge_attempts": F.lit(0)})
    made = cases.withColumn("__reply", injected.applied(judge, "string", *inputs, attempts=attempts)).withColumn("__card", judge_scores(F.col("__reply.value")))
    error = F.coalesce(F.col("__reply.error"), F.when(F.col("__card").isNull(), "NoScorecard"))
    scores = {"faithfulness": F.col("__card.faithfulness"), "answer_relevancy": F.col("__card.answer_relevancy"), "judge_error": error, "judge_attempts": F.col("__reply.attempts")}
    return made.withColumns(scores).drop("__reply", "__card")
