"""Session settings that the operators rely on, and table access."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Repository root, so that Python workers find the package wherever they start.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let the Python workers of this session import the package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where unset on one machine, a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, rows: int = 500_000) -> DataFrame:
    """``df`` dealt by keys to parts of some ``rows`` rows, so that what a task sorts or holds does not grow with the table."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *keys)


def session(name: str = "gradus", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings override."""
    builder = SparkSession.builder.appName(name)
    chosen = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | settings
    for key, value in chosen.items():
        builder = builder.config(key, value)
    return importable(builder.getOrCreate())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
