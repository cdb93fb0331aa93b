"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its mean and a covariance shrunk towards its diagonal, ``(1 - g) S + g diag(S)``.
The score of a document is the logistic of the difference of the two log densities plus the log
prior odds; each density needs a Mahalanobis distance, computed with the inverse of the class's
Cholesky factor, which is factored once at fitting and kept in the model.

Fitting gathers only ``n``, the sums and the cross products of each class: one aggregation whose
partial sums are made per task, and a driver state of the size of two covariance matrices.

Defined results: null and empty texts are scored as texts of zero words; equal texts get equal
scores; with an empty table the result is empty; where a class has fewer than two rows, or none is
labelled, every score is the smoothed share of good labels (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, ready
from .textstats import NAMES, stats

FEATURES = (
    "words", "word_length", "symbols", "bangs", "capitals", "repeats", "twins", "bars", "stops", "commas", "kinds", "digits", "dup_lines",
)


def transform(counts: np.ndarray) -> np.ndarray:
    """Features (rows x FEATURES) of counts (rows x NAMES): logs and logged shares, near to normal within a class."""
    c = dict(zip(NAMES, counts.astype(np.float64).T, strict=True))
    words, chars, lines = (np.maximum(c[x], 1.0) for x in ("n_words", "word_chars", "n_lines"))

    def share(top: str, bottom: np.ndarray, floor: float) -> np.ndarray:
        return np.log(c[top] / bottom + floor)

    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, share("n_symbols", chars, 1e-3), share("n_bangs", chars, 1e-3),
            share("n_upper", chars, 1e-3), share("n_repeat_words", words, 5e-3), share("n_twins", words, 5e-3),
            share("n_bars", words, 1e-3), share("n_stops", words, 5e-3), share("n_commas", words, 5e-3),
            c["n_kinds"] / words**0.9, share("n_digits", chars, 1e-3), share("n_dup_lines", lines, 1e-2),
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, inverse Cholesky factor, log determinant of the factor."""

    log_prior: tuple[float, float]
    means: np.ndarray | None
    inverse_factors: np.ndarray | None
    log_dets: tuple[float, float]

    def score(self, features: np.ndarray) -> np.ndarray:
        logs = []
        for c in (0, 1):
            log = np.full(len(features), self.log_prior[c])
            if self.means is not None:
                z = (features - self.means[c]) @ self.inverse_factors[c].T
                log += -0.5 * (z * z).sum(axis=1) - self.log_dets[c]
            logs.append(log)
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -60.0, 60.0)))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, features array<double>) of every row; the text goes no further than this pass."""
    ready(docs.sparkSession)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = transform(np.array([stats(x.as_py()) for x in batch.column(1)], dtype=np.int64))
        made = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1])
        return pa.RecordBatch.from_arrays([batch.column(0), made.cast(pa.list_(pa.float64()))], names=[key, "features"])

    shape = T.StructType([docs.schema[key], T.StructField("features", T.ArrayType(T.DoubleType()))])
    return docs.select(key, text).mapInArrow(batches(count), shape)


def fit(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", shrinkage: float = 0.05) -> Model:
    """Fit on the rows of ``measured`` that ``labels`` (key, label 0/1) marks; null labels do not count."""
    width = len(FEATURES)
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("label"))

    def partial(source):
        total = np.zeros((2, 1 + width + width * width))
        for batch in source:
            x = np.array(batch.column(1).flatten()).reshape(-1, width)
            y = np.array(batch.column(0))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total))], names=["label", "sums"])

    sums = (
        measured.join(marks, key).select(F.col("label").cast("int"), "features")
        .mapInArrow(partial, "label int, sums array<double>")
        .select("label", F.posexplode("sums").alias("i", "v")).groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    )  # fmt: skip  # 2 * (1 + width + width^2) rows
    total = np.zeros((2, 1 + width + width * width))
    for row in sums:
        total[row["label"], row["i"]] = row["v"]
    n = total[:, 0]
    log_prior = tuple(math.log((n[c] + 1) / (n.sum() + 2)) for c in (0, 1))
    if n.min() < 2:
        return Model(log_prior, None, None, (0.0, 0.0))
    means, inverses, dets = [], [], []
    for c in (0, 1):
        mean = total[c, 1 : 1 + width] / n[c]
        cov = (total[c, 1 + width :].reshape(width, width) - n[c] * np.outer(mean, mean)) / (n[c] - 1)
        spread = np.maximum(np.diag(cov), 1e-4)
        factor = np.linalg.cholesky((1 - shrinkage) * (cov + np.diag(spread - np.diag(cov))) + shrinkage * np.diag(spread))
        means.append(mean)
        inverses.append(np.linalg.inv(factor))
        dets.append(float(np.log(np.diag(factor)).sum()))
    return Model(log_prior, np.array(means), np.array(inverses), tuple(dets))


def score(measured: DataFrame, model: Model, *, key: str = "doc_id") -> DataFrame:
    """(key, score) of every row of ``measured``."""

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column(1).flatten()).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=[key, "score"])

    return measured.mapInArrow(batches(apply), T.StructType([measured.schema[key], T.StructField("score", T.DoubleType())]))
