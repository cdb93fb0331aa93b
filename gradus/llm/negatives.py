"""Hard negatives by a vector-approximation file: rows of another label whose score lies in a window below a positive's.

Rows are dealt into groups of at most GROUP. A group's approximation cuts each dimension into CELLS cells at
its own quantiles and keeps a cell number a component, two of them in a byte. For an anchor, a table of 256 entries a byte
holds the least and the greatest that the two components can add to the score (from the least and greatest value in
each cell), so one pass of table lookups over the cell numbers bounds every row's score from both sides. Exact integer scores are
made of those rows alone that may still enter the answer:

* positives: the k-th best lower bound is a floor; rows of the same label whose upper bound reaches it;
* negatives of a window: rows of other labels whose bounds meet the window, and whose upper bound reaches the k-th best lower
  bound of the rows that surely lie in it.

Anchors travel to every group as rows and stream past its file in Arrow batches, so neither is broadcast nor collected;
what leaves a group is at most k rows an anchor (and window), ranked over all groups afterwards. Both rounds are one plan
of two shuffles each, and the rows are checkpointed between them. Groups come from row numbers of the checkpointed
rows, so an id or a vector that a third of all rows share is spread as any other.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part. A component x counts
as floor(scale * x), held within +-LARGEST. Vectors of different lengths are compared over the components that both have.
Rows of an anchor's own id are not its positives or negatives. Rows that repeat an id take part each on its own, so
repeated anchors and positives repeat their results. Higher scores come first, ties by smaller id. An anchor without
another row of its label, and a window without a row, give no row. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alone, cut, ready

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Rows of one group at most: 64 dimensions of them are some 80 MB in a worker.
GROUP = 131_072
#: Rows that a group has at least, however many partitions there are: each group sends k rows an anchor on.
FEWEST = 1024
CELLS = 16
#: What a scaled component is held within: scores of 100 dimensions and more then fit 64 bits.
LARGEST = 2.0**28


class Approximation:
    """The rows of one group, sorted by label, with their cell numbers and the bounds of each cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        rows, dims = self.vectors.shape
        even = dims + dims % 2
        codes = np.zeros((even, rows), dtype=np.uint8)
        self.low, self.high = np.zeros((even, CELLS)), np.zeros((even, CELLS))
        for d in range(dims):
            own = self.vectors[:, d]
            ordered = np.sort(own)
            edges = ordered[[i * rows // CELLS for i in range(1, CELLS)]]
            codes[d] = np.searchsorted(edges, own, side="right")
            # a cell holds the sorted values from one edge up to the next
            ends = np.concatenate([np.searchsorted(ordered, edges, side="left"), [rows]])
            starts = np.concatenate([[0], ends[:-1]])
            some = ends > starts
            self.low[d, some], self.high[d, some] = ordered[starts[some]], ordered[ends[some] - 1]
        self.codes = np.ascontiguousarray(codes[0::2] * CELLS + codes[1::2])
        self.largest = np.abs(self.vectors).max(axis=0, initial=0).astype(np.float64)

    def bounds(self, anchor: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that each row can have, by table lookup."""
        weight = np.zeros((len(self.low), 1))
        weight[: len(anchor), 0] = anchor
        one, other = weight * self.low, weight * self.high
        both = np.minimum(one, other) + 1j * np.maximum(one, other)
        table = (both[0::2, :, None] + both[1::2, None, :]).reshape(-1, CELLS * CELLS)
        total = np.zeros(self.codes[:, rows].shape[1], dtype=np.complex128)
        for k in range(len(self.codes)):
            total += table[k].take(self.codes[k, rows])
        slack = 1e-12 * float(np.abs(anchor) @ self.largest)  # beyond the rounding of large sums
        return total.real - slack, total.imag + slack

    def best(self, anchor: np.ndarray, at: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of these rows by exact score, within the window."""
        scores = self.vectors[at] @ anchor
        if low is not None:
            inside = (scores >= low) & (scores <= high)
            at, scores = at[inside], scores[inside]
        first = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[first]], scores[first]

    def fitted(self, anchor: np.ndarray) -> np.ndarray:
        """The anchor over the components that this group has."""
        own = np.zeros(self.vectors.shape[1], dtype=np.int64)
        own[: len(anchor)] = anchor[: len(own)]
        return own

    def positives(self, ident: int, label: int, anchor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = slice(*np.searchsorted(self.labels, [label, label + 1]))
        own = np.arange(rows.start, rows.stop)
        other = self.ids[rows] != ident
        low, high = self.bounds(anchor, rows)
        own, low, high = own[other], low[other], high[other]
        if len(own) > k:
            own = own[high >= np.partition(low, -k)[-k]]
        return self.best(anchor, own, k)

    def negatives(self, ident: int, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        low, high = self.bounds(anchor, slice(None))
        other = (self.labels != label) & (self.ids != ident)
        found = []
        for least, most in windows:
            may = other & (high >= least) & (low <= most)
            sure = low[may & (low >= least) & (high <= most)]
            if len(sure) > k:
                may &= high >= np.partition(sure, -k)[-k]
            found.append(self.best(anchor, np.flatnonzero(may), k, least, most))
        return found


def prepared(vectors: DataFrame, key: str, label: Column, vector: str, anchor: Column, scale: int) -> DataFrame:
    """(row, id, label, vector, anchor) of the rows that take part; ``row`` is a number of the checkpointed row."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
        F.when(~odd, F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-LARGEST)), F.lit(LARGEST))))).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    ).where("id is not null and label is not null and vector is not null")
    return cut(rows).withColumn("row", F.monotonically_increasing_id())


def _met(rows: DataFrame, anchors: DataFrame, groups: int, work, shape: str) -> DataFrame:
    """``work(file, ident, label, anchor, aims)`` of every anchor in every group: its columns after (row, id)."""
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "row", "id", "label", "vector", F.lit(None).cast("array<long>").alias("aims"))
    each = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    asked = anchors.select(each, F.lit(1).alias("kind"), "row", "id", "label", "vector", "aims")
    together = held.unionByName(asked).repartition(groups, "group").sortWithinPartitions("group", "kind")
    names = [x.split()[0] for x in shape.split(", ")]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        now, file, waiting = None, None, []
        for batch in batches:
            group, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(group) | np.diff(kind)) + 1
            for s, e in zip([0, *edges], [*edges, len(group)], strict=True):
                if s == e:
                    continue
                if group[s] != now:
                    now, file, waiting = group[s], None, []
                part = batch.slice(s, e - s)
                if kind[s] == 0:
                    waiting.append(part)
                    continue
                if file is None:
                    file, waiting = _file(waiting), []
                if file is not None:
                    out = _answers(file, part, work)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return together.mapInArrow(over, shape)


def _file(parts: list[pa.RecordBatch]) -> Approximation | None:
    if not parts:
        return None
    ids, labels = (np.concatenate([x.column(i).to_numpy() for x in parts]) for i in (3, 4))
    lists = [(x.column(5).value_lengths().to_numpy(), x.column(5).flatten().to_numpy()) for x in parts]
    sizes = np.concatenate([x for x, _ in lists])
    vectors = np.zeros((len(ids), int(sizes.max(initial=0))), dtype=np.int64)
    vectors[np.arange(vectors.shape[1]) < sizes[:, None]] = np.concatenate([x for _, x in lists])
    return Approximation(ids, labels, vectors)


def _answers(file: Approximation, asked: pa.RecordBatch, work) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = []
    vectors, aims = asked.column(5), asked.column(6)
    for i, (row, ident, label) in enumerate(zip(*(asked.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
        anchor = file.fitted(vectors[i].values.to_numpy())
        for more in work(file, ident, label, anchor, aims[i].as_py()):
            found.append([np.full(len(more[-1]), x, dtype=np.int64) if np.isscalar(x) else x for x in (row, ident, *more)])
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * work.width


def _first(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Positives:
    width = 4

    def __init__(self, k: int) -> None:
        self.k = k

    def __call__(self, file: Approximation, ident: int, label: int, anchor: np.ndarray, aims) -> Iterator[tuple]:
        yield file.positives(ident, label, anchor, self.k)


class _Negatives:
    width = 5

    def __init__(self, k: int, low: int, high: int) -> None:
        self.k, self.low, self.high = k, low, high

    def __call__(self, file: Approximation, ident: int, label: int, anchor: np.ndarray, aims: list[int]) -> Iterator[tuple]:
        windows = [(-(-self.low * x // 100), self.high * x // 100) for x in aims]
        for place, made in enumerate(file.negatives(ident, label, anchor, windows, self.k)):
            yield (place, *made)


def mine(
    vectors: DataFrame, anchor: Column, *, key: str = "vec_id", label: Column | None = None, vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, group: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that ``anchor`` holds for, its first ``positives`` other rows of the same label; for each of these the first
    ``negatives`` rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = ready(vectors.sparkSession)
    rows = prepared(vectors, key, F.col("label") if label is None else label, vector, anchor, scale)
    n = rows.count()
    groups = max(1, -(-n // group), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // FEWEST))
    asked = rows.where("anchor").drop("anchor")

    near = _met(rows, asked.withColumn("aims", F.lit(None).cast("array<long>")), groups, _Positives(positives), "row long, id long, other long, score long")
    chosen = _first(near, ["row"], "score", "other", positives).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("chosen"))
    aimed = cut(asked.join(chosen, "row").withColumn("aims", F.transform("chosen", lambda x: x["score"])))

    far = _met(rows, aimed, groups, _Negatives(negatives, low, high), "row long, id long, place long, other long, score long")
    ranked = _first(far, ["row", "place"], "score", "other", negatives)
    positive = F.element_at("chosen", (F.col("place") + 1).cast("int"))
    return ranked.join(aimed.select("row", "chosen"), "row").select(
        F.col("id").alias("anchor_id"), positive["other"].alias("positive_id"), "rank", F.col("other").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"),
    )
