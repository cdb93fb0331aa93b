"""Scores of rows against a block of queries, summed in the task that reads the row.

A block holds the terms of some queries and, for each term, the queries that have it; it is broadcast. A row's words are looked up in the block,
each found word adds its part to the queries that have it, and a task passes on its k best rows of each query alone: what is
shuffled are k rows a query and task, however many pairs there are.

Pairs are summed MATCHES at a time, and a task holds k rows of each query besides, so its memory does not grow with the corpus.
Rows of equal keys are rows of their own here: callers see to it that keys do not repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches of a word and a query that are summed at once, and the most rows of a query that a task sorts out by itself.
MATCHES, MOST = 2_000_000, 1_000


@dataclass(frozen=True)
class Block:
    """Queries with their sizes; the queries of term t are ``query[start[t]:start[t + 1]]``."""

    qids: pa.Array
    sizes: np.ndarray
    terms: pa.Array
    start: np.ndarray
    query: np.ndarray
    weight: np.ndarray | None = None

    @staticmethod
    def of(rows: DataFrame) -> Block | None:
        """From (qid, qsize, term), of a bounded number of rows; None without any. Repeated rows count as often as they stand."""
        held = rows.groupBy("qid", "qsize").agg(F.collect_list("term").alias("terms")).toArrow().combine_chunks()
        if not held.num_rows:
            return None
        lists = pa.chunked_array(held["terms"]).combine_chunks() if held["terms"].num_chunks != 1 else held["terms"].chunk(0)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())
        start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
        qids = held["qid"].combine_chunks()
        return Block(qids.chunk(0) if isinstance(qids, pa.ChunkedArray) else qids, held["qsize"].to_numpy().astype(np.float64), coded.dictionary, start, owner[np.argsort(code, kind="stable")])


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))


def coded(docs: DataFrame, key: str, words: str, given) -> DataFrame:
    """(key, size, codes, counts): how many words a row has, those that the block has by their place in it, and how often each stands there."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = given.value.terms
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column(1)
            sizes = listed.value_lengths()
            found = pc.index_in(listed.flatten(), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes.fill_null(0).to_numpy(zero_copy_only=False))
            pairs, counts = np.unique((row * len(terms) + found)[found >= 0], return_counts=True)
            ends = np.cumsum(np.bincount(pairs // len(terms), minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes.cast(pa.int32()), _lists(ends, pairs % len(terms)), _lists(ends, counts)], names=[key, "size", "codes", "counts"])

    return docs.select(key, words).mapInArrow(over, f"`{key}` {dict(docs.dtypes)[key]}, size int, codes array<int>, counts array<int>")


def holders(rows: DataFrame, n: int) -> DataFrame:
    """(code, df): how many rows have each of the n terms; one row a task and term at most before they are added."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["code", "df"])

    return rows.select("codes").mapInArrow(over, "code int, df long").groupBy("code").agg(F.sum("df").alias("df"))


def _six(scores: np.ndarray) -> np.ndarray:
    """Scores in millionths, rounded as Spark's round does: by the digits that a double is written with, halves up."""
    scaled = scores * 1e6
    whole = np.floor(scaled + 0.5)
    close = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(close):
        values, at = np.unique(scores[close], return_inverse=True)
        exact = [float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6)) for v in values]
        whole[close] = np.array(exact)[at]
    return whole


class _Best:
    """The k best rows of each query so far: by score in millionths, then by key."""

    def __init__(self, n: int, k: int, least: float) -> None:
        self.k, self.floor, self.held = k, np.full(n, least), None

    def add(self, query: np.ndarray, scores: np.ndarray, sums: np.ndarray, keys: pa.Array, row: np.ndarray, sizes: np.ndarray) -> None:
        near = np.flatnonzero(scores >= self.floor[query] / 1e6 - 1e-6)
        level = _six(scores[near])
        fine = level >= self.floor[query[near]]
        some, level = near[fine], level[fine]
        if not len(some):
            return
        new = (query[some], level, sums[some], sizes[row[some]], keys.take(pa.array(row[some])))
        if self.held is not None:
            new = (*(np.concatenate(x) for x in zip(self.held[:4], new[:4], strict=True)), pa.concat_arrays([self.held[4], new[4]]))
        if self.k > MOST:
            self.held = new
            return
        place = np.empty(len(new[4]), dtype=np.int64)
        place[pc.sort_indices(new[4]).to_numpy()] = np.arange(len(place))
        order = np.lexsort((place, -new[1], new[0]))
        own = new[0][order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
        kept = order[rank < self.k]
        self.held = (*(x[kept] for x in new[:4]), new[4].take(pa.array(kept)))
        full = order[rank == self.k - 1]
        self.floor[new[0][full]] = np.maximum(self.floor[new[0][full]], new[1][full])

    def taken(self, block: Block, key: str) -> Iterator[pa.RecordBatch]:
        if self.held is not None:
            query, _, sums, sizes, keys = self.held
            self.held = None
            yield pa.RecordBatch.from_arrays([block.qids.take(pa.array(query)), keys, pa.array(sums), pa.array(block.sizes[query]), pa.array(sizes.astype(np.int32))], names=["qid", key, "sum", "qsize", "size"])


def best(rows: DataFrame, key: str, qid_kind: str, given, part: Callable, score: Callable, k: int, floor: float = 0.0) -> DataFrame:
    """(qid, key, sum, qsize, size) of what ``coded`` gives: the k best rows of each query in each task, and all that reach ``floor`` where k is over MOST.

    ``part(counts, sizes)`` is what a word adds, before its weight; ``score(sums, query_sizes, sizes)`` is what counts.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = given.value
        n, many = len(block.qids), np.diff(block.start)
        kept = _Best(n, k, floor * 1e6)
        for batch in batches:
            keys, sizes = batch.column(0), batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            codes = batch.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            value = part(batch.column(3).flatten().to_numpy().astype(np.float64), sizes[row])
            value = value if block.weight is None else value * block.weight[codes]
            reach = np.cumsum(many[codes])
            last = np.append(np.searchsorted(row, np.arange(batch.num_rows), "right"), 0)  # words up to the end of each row
            total = np.concatenate([[0], reach])[last[:-1]]
            at = 0
            while at < batch.num_rows:
                before = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, before + MATCHES, "right")))
                s, e = (last[at - 1] if at else 0), last[end - 1]
                if e > s:
                    times = many[codes[s:e]]
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    cell = (np.repeat(row[s:e] - at, times) * n) + block.query[np.repeat(block.start[codes[s:e]], times) + step]
                    parts = np.repeat(value[s:e], times)
                    if (end - at) * n <= 4 * MATCHES:
                        sums = np.bincount(cell, parts, minlength=(end - at) * n)
                        pairs = np.flatnonzero(sums)
                        sums = sums[pairs]
                    else:
                        pairs, inverse = np.unique(cell, return_inverse=True)
                        sums = np.bincount(inverse, parts)
                    query, own = pairs % n, pairs // n + at
                    kept.add(query, score(sums, block.sizes[query], sizes[own]), sums, keys, own, sizes)
                at = end
            if k > MOST:
                yield from kept.taken(block, key)
        yield from kept.taken(block, key)

    return rows.mapInArrow(over, f"qid {qid_kind}, `{key}` {dict(rows.dtypes)[key]}, sum double, qsize double, size int")


def weighed(block: Block, weight: np.ndarray) -> Block:
    return replace(block, weight=weight)
