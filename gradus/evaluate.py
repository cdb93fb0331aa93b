"""``python -m gradus.evaluate CASES.jsonl``: the retrieval report as Markdown; exit 0 passed, 1 failed, 2 unusable cases."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .session import session
from .sources import readers, sinks


def named(judge: str | None) -> Callable | None:
    """The function that ``package.module:function`` names."""
    if judge is None:
        return None
    module, _, function = judge.partition(":")
    return getattr(importlib.import_module(module), function)


def run(spark: SparkSession, path: str, *, least_recall: float, least_faithfulness: float, judge: Callable | None = None) -> tuple[int, str]:
    """(exit code, report); judge scores are read from the cases, or asked of ``judge`` (query, joined ids of what was retrieved)."""
    try:
        cases = readers.eval_cases(spark, path)
        asked = cases.withColumn("answer", F.array_join("retrieved", " "))
        scored = evaluation.judged(evaluation.scored(asked), judge).cache()
        rows = scored.select(F.col("id").alias("case_id"), "precision", "recall", "rr").orderBy("id").collect()
    except (PySparkException, Py4JError) as error:
        return 2, f"unusable cases: {str(error).splitlines()[0]}\n"
    got = evaluation.report(scored, least_recall=least_recall, least_faithfulness=least_faithfulness).first()
    metrics = [
        {"metric": "context recall", "value": got.context_recall, "threshold": least_recall, "passed": (got.context_recall or 0) >= least_recall},
        {"metric": "faithfulness", "value": got.faithfulness, "threshold": least_faithfulness, "passed": got.faithfulness is None or got.faithfulness >= least_faithfulness},
        {"metric": "context precision", "value": got.context_precision, "threshold": "-", "passed": True},
        {"metric": "mean reciprocal rank", "value": got.mrr, "threshold": "-", "passed": True},
    ]
    return int(not got.passed), sinks.report_markdown({"passed": got.passed, "metrics": metrics}, [r.asDict() for r in rows])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gradus.evaluate")
    parser.add_argument("cases")
    parser.add_argument("--recall", type=float, default=evaluation.RECALL)
    parser.add_argument("--faithfulness", type=float, default=evaluation.FAITHFULNESS)
    parser.add_argument("--judge", help="package.module:function that scores cases; without it their own scores count")
    given = parser.parse_args(argv)
    code, report = run(session("evaluate"), given.cases, least_recall=given.recall, least_faithfulness=given.faithfulness, judge=named(given.judge))
    print(report)
    return code


if __name__ == "__main__":
    sys.exit(main())
