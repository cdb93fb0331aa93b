"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_folder, cut, importable  # noqa: F401

#: Bytes of an Arrow batch: documents can be long, so batches are bounded by size.
BATCH_BYTES = 2_000_000


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep Arrow batches of texts small."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """The one large object that a Python worker keeps from task to task; another key drops the one before."""
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        if make is not None:
            _KEPT[key] = make()
    return _KEPT.get(key)


def alone() -> None:
    """Drop what earlier operators kept in this worker: workers outlive stages."""
    kept("", None)


def batches(function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table]) -> Callable:
    """A function for mapInArrow that applies ``function`` to each batch."""

    def over(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for batch in source:
            if batch.num_rows:
                made = function(batch)
                yield from made.to_batches() if isinstance(made, pa.Table) else [made]

    return over


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
