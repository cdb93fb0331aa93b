"""Exact nearest neighbours by cosine, with balls of vectors that no near vector can lie in left out.

Vectors are scaled to length 1 and dealt to the nearest of at most CENTRES centres (rows of a hash-ordered sample of
that size, the one thing that is collected). A ball is a centre c with the largest distance r of its
vectors. By Cauchy and Schwarz no vector of a ball scores over q.c + r for a query q of length 1, so:

1. each query is scored in its home ball, the one of the nearest centre; its k-th best score there is a floor;
2. it is scored in those other balls alone whose bound reaches the floor.

Queries are rows throughout: they are dealt to balls by a shuffle and stream past a ball's vectors in Arrow batches. Balls of
over PART vectors are split, so the memory of a task is bounded however many vectors are alike.

Defined results: rows and queries with a null vector, or a null or NaN component, take no part; vectors of length 0 score
0; of repeated query ids the smallest vector counts; repeated keys are rows of their own; an empty side gives an empty result;
vectors of different dimensions are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, importable

CENTRES, PART = 64, 20_000
#: Queries whose scores are held at once.
BLOCK = 256
#: Scores are compared to six digits, so bounds leave that much room.
DIGITS, ROOM = 6, 2e-6


def whole(vector: str) -> Column:
    """Whether a vector can take part."""
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of length 1 (or 0)."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different dimensions: {lengths.tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), int(lengths[0]) if len(lengths) else 0)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _same(rows: np.ndarray, centres: np.ndarray) -> None:
    if rows.shape[1] != centres.shape[1]:
        raise ValueError(f"vectors of {rows.shape[1]} and {centres.shape[1]} dimensions")


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))


def _centres(vectors: DataFrame, key: str, vector: str, most: int) -> np.ndarray | None:
    """At most ``most`` rows, whatever the table holds."""
    some = vectors.select(vector).orderBy(F.xxhash64(key), vector).limit(most).collect()
    return np.unique(_matrix(pa.array([r[0] for r in some], pa.list_(pa.float64()))), axis=0) if some else None


def _dealt(vectors: DataFrame, key: str, vector: str, given) -> DataFrame:
    """(ball, key, unit, reach)"""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = given.value
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1))
                _same(rows, centres)
                ball = ((rows @ centres.T) - (centres**2).sum(axis=1) / 2).argmax(axis=1)
                reach = np.linalg.norm(rows - centres[ball], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ball.astype(np.int32)), batch.column(0), _lists(rows), pa.array(reach)], names=["ball", key, "unit", "reach"])

    return vectors.select(key, F.col(vector).cast("array<double>")).mapInArrow(over, f"ball int, `{key}` {dict(vectors.dtypes)[key]}, unit array<double>, reach double")


def _asked(queries: DataFrame, qid: str, vector: str, given) -> DataFrame:
    """(qid, unit, home, bounds): the nearest ball, and of every ball the most that a vector of it can score."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius = given.value
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1))
                _same(rows, centres)
                near = rows @ centres.T
                home = np.where(radius >= 0, near, -np.inf).argmax(axis=1).astype(np.int32)
                bounds = np.where(radius >= 0, near + radius, -np.inf)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows), pa.array(home), _lists(bounds)], names=["qid", "unit", "home", "bounds"])

    one = queries.groupBy(F.col(qid).alias("qid")).agg(F.min(F.col(vector).cast("array<double>")).alias("unit"))
    return one.mapInArrow(over, f"qid {dict(queries.dtypes)[qid]}, unit array<double>, home int, bounds array<double>")


class _Cell:
    """The vectors of one part of a ball, with the place of each key among them."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        self.keys = pa.concat_arrays([p.column(3) for p in parts])
        self.rows = np.concatenate([_flat(p.column(4)) for p in parts])
        self.place = np.empty(len(self.keys), dtype=np.int64)
        self.place[pc.sort_indices(self.keys).to_numpy()] = np.arange(len(self.keys))

    def best(self, asked: np.ndarray, k: int, block: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for at in range(0, len(asked), block):
            for i, scores in enumerate(np.round(asked[at : at + block] @ self.rows.T, DIGITS)):
                some = np.arange(len(scores))
                if len(scores) > k:
                    some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
                some = some[np.lexsort((self.place[some], -scores[some]))[:k]]
                yield at + i, some, scores[some]


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _met(cells: DataFrame, asked: DataFrame, key: str, kinds: tuple[str, str], k: int, block: int) -> DataFrame:
    """(qid, key, score): the k best of each query in each cell that it is dealt to."""
    qid_kind, key_kind = kinds
    held = cells.select("cell", F.lit(0).alias("kind"), F.lit(None).cast(qid_kind).alias("qid"), F.col(key).alias("__key"), "unit")
    sent = asked.select("cell", F.lit(1).alias("kind"), "qid", F.lit(None).cast(key_kind).alias("__key"), "unit")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, waiting = None, None, []
        for batch in batches:
            ids, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *edges], [*edges, len(ids)], strict=True):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if ids[s] != now:
                    now, cell, waiting = ids[s], None, []
                if kind[s] == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    cell, waiting = _Cell(waiting), []
                if cell is not None:
                    found = list(cell.best(_flat(part.column(4)), k, block))
                    asked_at = np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found])
                    rows, scores = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                    yield pa.RecordBatch.from_arrays([part.column(2).take(pa.array(asked_at)), cell.keys.take(pa.array(rows)), pa.array(scores)], names=["qid", key, "score"])

    together = held.unionByName(sent).repartition("cell").sortWithinPartitions("cell", "kind")
    return together.mapInArrow(over, f"qid {qid_kind}, `{key}` {key_kind}, score double")


def _first(scored: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, *, qid: str, key: str, vector: str, k: int, centres: int = CENTRES, part: int = PART, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The hits (qid, key, score, rank), and what they cost: (qid, n_scored, n_vectors) of each query."""
    spark: SparkSession = importable(vectors.sparkSession)
    kinds = (dict(queries.dtypes)[qid], dict(vectors.dtypes)[key])
    vectors, queries = vectors.where(whole(vector)), queries.where(whole(vector))
    middle = _centres(vectors, key, vector, centres)
    if middle is None:
        nothing = spark.createDataFrame([], f"qid {kinds[0]}, `{key}` {kinds[1]}, score double, rank int")
        return nothing, queries.select(F.col(qid).alias("qid"), F.lit(0).cast("long").alias("n_scored"), F.lit(0).cast("long").alias("n_vectors")).distinct()

    dealt = cut(_dealt(vectors, key, vector, spark.sparkContext.broadcast(middle)))
    stats = {r["ball"]: r for r in dealt.groupBy("ball").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).collect()}  # a row a centre
    counts = [stats[b]["n"] if b in stats else 0 for b in range(len(middle))]
    radius = np.array([stats[b]["radius"] if b in stats else -1.0 for b in range(len(middle))])
    parts = [-(-n // part) for n in counts]
    first = np.concatenate([[0], np.cumsum(parts)]).tolist()
    listed = lambda values: F.array(*(F.lit(int(x)) for x in values))
    cells = dealt.withColumn("cell", F.get(listed(first), F.col("ball")) + F.pmod(F.monotonically_increasing_id(), F.get(listed(parts), F.col("ball"))).cast("int"))
    asked = cut(_asked(queries, qid, vector, spark.sparkContext.broadcast((middle, radius))))

    def sent(rows: DataFrame, ball: Column) -> DataFrame:
        return rows.select("qid", "unit", F.explode(F.sequence(F.get(listed(first), ball), F.get(listed(first), ball + 1) - 1)).alias("cell"))

    near = cut(_first(_met(cells, sent(asked, F.col("home")), key, kinds, k, block), key, k))
    floor = near.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    open_ = F.filter(F.sequence(F.lit(0), F.lit(len(middle) - 1)), lambda b: (b != F.col("home")) & (F.get(listed(parts), b) > 0) & (F.get("bounds", b) + ROOM >= F.coalesce("floor", F.lit(-2.0))))
    aimed = cut(asked.join(floor, "qid", "left").select("qid", "unit", "home", open_.alias("open")))
    far = _met(cells, sent(aimed.select("qid", "unit", F.explode("open").alias("__ball")), F.col("__ball")), key, kinds, k, block)
    hits = _first(near.drop("rank").unionByName(far), key, k).select("qid", key, "score", "rank")
    scored = F.aggregate(F.array_append("open", F.col("home")), F.lit(0).cast("long"), lambda n, b: n + F.get(F.array(*(F.lit(int(x)).cast("long") for x in counts)), b))
    return hits, aimed.select("qid", scored.alias("n_scored"), F.lit(sum(counts)).cast("long").alias("n_vectors"))
