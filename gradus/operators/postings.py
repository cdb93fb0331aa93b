"""BM25 over a stored index: postings in blocks with the greatest contribution of each, and blocks skipped that no answer can come from.

The index of a corpus is three tables:

* ``stats``: one row, the number of documents and their mean length;
* ``terms``: (term, df, most, best): in how many documents a term is, the greatest contribution of one of its postings, and the TOP greatest ones;
* ``blocks``: (segment, term, most, keys, parts): postings of like contribution together, at most BLOCK in each, with the greatest of them.

A segment is some SEGMENT words of whole documents that one task reads, so its postings are grouped where they stand, and a document's postings are all in one segment.
A contribution is that of the term frequency and length alone; the weight of a term in the whole corpus is applied when asking.

Asking. Of a query's terms, one whose k-th greatest contribution, weighted, is the greatest sets a floor: k documents score that much by
this term alone. A block's documents score its own maximum and those of the query's other terms at most; where that stays below
the floor, the block is not opened: what is in it is no answer, and no answer loses a part of its score, as every block of an answer reaches the floor.
The result is exactly that of ``retrieval.bm25``.

Opened blocks are shuffled by segment, once however many queries open them; a segment's scores are summed there, and its k best rows of each query go on.

Hot terms: a segment is bounded, so no group grows with the corpus.

Defined results: null texts hold no word and have no length; queries without a known term have no row; of repeated query ids the terms are pooled; an empty corpus gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut, importable
from . import blocks
from . import retrieval

BLOCK, TOP, LEVELS = 128, 64, 64
#: Words of the documents of a segment, and cells of a query and a document that are summed at once.
SEGMENT, CELLS = 2_000_000, 8_000_000
K1, B = 1.2, 0.75
#: Scores are compared to six digits, so floors leave that much room.
ROOM = 2e-6


@dataclass(frozen=True)
class Index:
    stats: DataFrame
    terms: DataFrame
    blocks: DataFrame

    def write(self, path: str) -> None:
        """Terms and blocks are sorted by term, so a reader's filter on terms passes over files and row groups."""
        self.stats.write.parquet(f"{path}/stats")
        for name, rows in (("terms", self.terms), ("blocks", self.blocks)):
            rows.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("stats", "terms", "blocks")))


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _listed(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def _pieces(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.Table]:
    """The rows in tables of some ``words`` words, or of one row."""
    held, n = [], 0
    for batch in batches:
        said = np.cumsum(batch.column(3).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = said[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(said, before + words - n, "right")))
            held.append(batch.slice(at, end - at))
            n, at = n + int(said[end - 1] - before), end
            if n >= words or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _postings(rows: pa.Table, mean: float, k1: float, b: float, block: int) -> list[pa.Array] | None:
    """The blocks of a segment as columns (term, most, keys, parts, df, best); the last two stand in the first block of each term, where df is not 0."""
    keys, said, lengths = (_one(c) for c in rows.columns[:3])
    texts = said.flatten()
    owner = np.repeat(np.arange(len(keys)), said.value_lengths().to_numpy(zero_copy_only=False))
    length = lengths.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    words = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = texts.flatten().dictionary_encode()
    n = len(coded.dictionary)
    if not n:
        return None
    pairs, tf = np.unique(np.repeat(np.arange(len(texts)), words) * n + coded.indices.to_numpy(), return_counts=True)
    text, code = pairs // n, pairs % n
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[text] / mean))
    row, df_of = owner[text], np.bincount(code, minlength=n)
    if len(texts) > len(keys):  # what the texts of a key contribute is one posting
        pairs, own = np.unique(row * n + code, return_inverse=True)
        row, code, part = pairs // n, pairs % n, np.bincount(own, part)
    order = np.lexsort((-part, code))
    row, code, part = row[order], code[order], part[order]
    level = np.floor(part / (k1 + 1) * LEVELS)
    new = np.concatenate([[True], code[1:] != code[:-1]])
    alike = np.flatnonzero(new | np.concatenate([[True], level[1:] != level[:-1]]))
    start = np.flatnonzero((np.arange(len(code)) - np.repeat(alike, np.diff(np.append(alike, len(code))))) % block == 0)
    first = new[start]
    df = np.zeros(len(start), dtype=np.int64)
    df[first] = df_of[code[new]]
    shown = np.zeros(len(start), dtype=np.int64)
    shown[first] = np.minimum(np.diff(np.append(np.flatnonzero(new), len(code))), TOP)
    ends = np.concatenate([[0], np.cumsum(shown)])
    best = np.repeat(start - ends[:-1], shown) + np.arange(ends[-1])
    edges = np.append(start, len(code))
    return [coded.dictionary.take(pa.array(code[start])), pa.array(part[start]), _listed(edges, keys.take(pa.array(row))), _listed(edges, pa.array(part)), pa.array(df), _listed(ends, pa.array(part[best]))]


def build(docs: DataFrame, *, key: str = "doc_id", body: str = "text", k1: float = K1, b: float = B, block: int = BLOCK, segment: int = SEGMENT) -> Index:
    words = F.regexp_extract_all(F.lower(body), F.lit(X.TOKEN), F.lit(0))
    split = importable(docs.sparkSession) and docs.select(F.col(key).alias("key"), words.alias("words"))
    stats = cut(split.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")))
    mean = stats.first()["mean"] or 1.0
    if retrieval.repeated(docs, key):  # texts of one key and length count as one, and those of a key stay together
        same = split.where("size(words) > 0").groupBy("key", F.size("words").alias("length")).agg(F.flatten(F.collect_list("words")).alias("words"))
        held = same.groupBy("key").agg(F.collect_list(F.struct("words", "length")).alias("held"))
        given = held.select("key", F.transform("held", lambda x: x["words"]).alias("words"), F.transform("held", lambda x: x["length"]).alias("lengths"))
    else:
        given = split.select("key", F.array("words").alias("words"), F.array(F.size("words")).alias("lengths"))
    given = given.withColumn("n", F.aggregate("words", F.lit(0), lambda n, x: n + F.coalesce(F.size(x), F.lit(0))))
    names = ["segment", "term", "most", "keys", "parts", "df", "best"]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, rows in enumerate(_pieces(batches, segment)):
            made = _postings(rows, mean, k1, b, block)
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar((TaskContext.get().partitionId() << 32) + i), len(made[0])), *made], names=names)

    kind = dict(split.dtypes)["key"]
    rows = cut(given.mapInArrow(over, f"segment long, term string, most double, keys array<{kind}>, parts array<double>, df long, best array<double>"))
    # the greatest of some segments first, so that no group holds all segments of a hot term
    greatest = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), 1, TOP).alias("best")
    some = rows.where("df > 0").groupBy("term", F.pmod(F.xxhash64("segment"), F.lit(LEVELS)).alias("salt")).agg(F.sum("df").alias("df"), F.max("most").alias("most"), greatest("best"))
    terms = cut(some.groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"), greatest("best")))
    return Index(stats, terms, rows.select("segment", "term", "most", "keys", "parts"))


def _asked(index: Index, queries: DataFrame, qid: str, terms: Column, k: int) -> DataFrame:
    """(qid, term, weight, room): a posting of the term below ``room`` belongs to no answer."""
    rows = queries.select(F.col(qid).alias("qid"), F.explode(terms).alias("term")).distinct()
    rows = F.broadcast(rows) if rows.count() <= retrieval.BROADCAST_TERMS else rows
    weight = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    met = index.terms.join(rows, "term").crossJoin(F.broadcast(index.stats)).select("qid", "term", weight.alias("weight"), "most", "best")
    own = Window.partitionBy("qid")
    kth = F.coalesce(F.get("best", F.lit(k - 1)), F.lit(0.0)) if k <= TOP else F.lit(0.0)
    floor = F.max(F.col("weight") * kth).over(own)
    others = F.sum(F.col("weight") * F.col("most")).over(own) - F.col("weight") * F.col("most")
    return met.select("qid", "term", "weight", ((floor - others - ROOM) / F.col("weight")).alias("room"))


def _open(index: Index, queries: DataFrame, qid: str, terms: Column, k: int) -> DataFrame:
    asked = cut(_asked(index, queries, qid, terms, k))
    few = asked.count() <= retrieval.BROADCAST_TERMS
    return index.blocks.join(F.broadcast(asked) if few else asked, "term").where(F.col("most") >= F.col("room"))


def _best(rows: pa.Table, asked: tuple, k: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(queries, keys, sums) of the k best of one segment's rows (term, most, keys, parts) for each query, some queries at a time."""
    terms, start, query, weight, room = asked
    keys, parts = _one(rows["keys"]), _one(rows["parts"])
    coded = keys.flatten().dictionary_encode(null_encoding="encode")
    document, part, known = coded.indices.to_numpy(), parts.flatten().to_numpy(), coded.dictionary
    place = np.empty(len(known), dtype=np.int64)
    place[pc.sort_indices(known, null_placement="at_start").to_numpy()] = np.arange(len(known))
    held = keys.value_lengths().to_numpy()
    first = np.concatenate([[0], np.cumsum(held)])
    code = pc.index_in(rows["term"], value_set=terms).to_numpy()
    many = start[code + 1] - start[code]
    row = np.repeat(np.arange(len(code)), many)
    pair = np.repeat(start[code], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    opened = rows["most"].to_numpy()[row] >= room[pair]
    row, pair = row[opened], pair[opened]
    order = np.argsort(query[pair], kind="stable")
    row, pair = row[order], pair[order]
    own, at = np.unique(query[pair], return_index=True)
    at, reach = np.append(at, len(pair)), np.concatenate([[0], np.cumsum(held[row])])
    i = 0
    while i < len(own):
        j = max(i + 1, min(i + CELLS // len(known), int(np.searchsorted(reach[at], reach[at[i]] + CELLS, "right")) - 1))
        r, p = row[at[i] : at[j]], pair[at[i] : at[j]]
        times = held[r]
        posting = np.repeat(first[r], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        cell = np.repeat(np.searchsorted(own, query[p]) - i, times) * len(known) + document[posting]
        sums = np.bincount(cell, np.repeat(weight[p], times) * part[posting], minlength=(j - i) * len(known)).reshape(j - i, -1)
        least = np.partition(sums, -k, axis=1)[:, -k] - ROOM if k < len(known) else np.zeros(j - i)
        q, d = np.nonzero((sums > 0) & (sums >= least[:, None]))
        score = blocks._six(sums[q, d])
        order = np.lexsort((place[d], -score, q))
        q, d = q[order], d[order]
        near = np.concatenate([[True], q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(np.flatnonzero(near), np.diff(np.append(np.flatnonzero(near), len(q))))
        q, d = q[rank < k], d[rank < k]
        yield own[i + q], known.take(pa.array(d)), sums[q, d]
        i = j


def search(index: Index, queries: DataFrame, *, qid: str = "item_id", body: str = "text", key: str = "doc_id", k: int = retrieval.LIMIT) -> DataFrame:
    """(qid, key, score, rank) of the k best documents of each query."""
    spark, kind = importable(queries.sparkSession), dict(index.blocks.dtypes)["keys"][6:-1]
    asked = cut(_asked(index, queries, qid, X.tokens(F.col(body)), k))
    parts = max(1, -(-asked.count() // retrieval.BROADCAST_TERMS))
    shape = f"qid {dict(queries.dtypes)[qid]}, `{key}` {kind}, sum double"

    def summed(some: DataFrame) -> DataFrame:
        rows = some.orderBy("term").toArrow().combine_chunks()  # BROADCAST_TERMS or so
        if not rows.num_rows:
            return spark.createDataFrame([], shape)
        terms, of = _one(rows["term"]).dictionary_encode(), _one(rows["qid"]).dictionary_encode(null_encoding="encode")
        start = np.concatenate([[0], np.cumsum(np.bincount(terms.indices.to_numpy()))])
        given = spark.sparkContext.broadcast((of.dictionary, (terms.dictionary, start, of.indices.to_numpy(), rows["weight"].to_numpy(), rows["room"].to_numpy())))

        def meet(group: pa.Table) -> pa.Table:
            qids, about = given.value
            found = [pa.RecordBatch.from_arrays([qids.take(pa.array(q)), keys, pa.array(sums)], names=["qid", key, "sum"]) for q, keys, sums in _best(group, about, k)]
            return pa.Table.from_batches(found) if found else pa.table({"qid": qids[:0], key: _one(group["keys"]).flatten()[:0], "sum": pa.array([], pa.float64())})

        opened = index.blocks.join(F.broadcast(some.groupBy("term").agg(F.min("room").alias("room"))), "term").where(F.col("most") >= F.col("room"))
        return opened.select("segment", "term", "most", "keys", "parts").groupBy("segment").applyInArrow(meet, shape)

    each = reduce(DataFrame.unionByName, (summed(asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)) for i in range(parts)))
    return retrieval.top(each.select("qid", key, F.round("sum", 6).alias("score")), ["qid"], "score", key, k).select("qid", key, "score", "rank")


def cost(index: Index, queries: DataFrame, *, qid: str = "item_id", body: str = "text", k: int = retrieval.LIMIT) -> DataFrame:
    """(qid, n_read, n_postings): how many postings a query opens of those that its terms have."""
    read = _open(index, queries, qid, X.tokens(F.col(body)), k).groupBy("qid").agg(F.sum(F.size("keys")).alias("n_read"))
    whole = queries.select(F.col(qid).alias("qid"), F.explode(X.tokens(F.col(body))).alias("term")).distinct().join(index.terms, "term").groupBy("qid").agg(F.sum("df").alias("n_postings"))
    return whole.join(read, "qid", "left").select("qid", F.coalesce("n_read", F.lit(0)).alias("n_read"), "n_postings")
