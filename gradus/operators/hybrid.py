"""Lexical and dense rankings of one corpus, fused; ordering and joining of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval

#: What stands between passages, and in place of none.
SEPARATOR, NOTHING = "\n\n---\n\n", "No relevant documents found."


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, *, qid: str = "qid", key: str = "doc_id", body: str = "text", vector: str = "embedding", k: int = retrieval.LIMIT, prefetch: int = retrieval.PREFETCH) -> DataFrame:
    """(qid, key, score, rank): the best ``prefetch`` by BM25 and by cosine, fused by reciprocal rank.

    Queries and rows without a vector take part in the lexical branch alone.
    """
    lexical = retrieval.bm25(queries, docs, qid=qid, key=key, body=body, k=prefetch)
    known = F.col(vector).isNotNull()
    near = retrieval.dense(queries.where(known), vectors.where(known), qid=qid, key=key, vector=vector, k=prefetch)
    return retrieval.fused([lexical, near], by=["qid"], key=key, k=k)


def in_order(chunks: DataFrame, *, by: str, index: str = "chunk_index", ties: list[str]) -> DataFrame:
    """Chunks with their place in the document: by index, those without one last."""
    order = Window.partitionBy(by).orderBy(F.asc_nulls_last(index), *ties)
    return chunks.withColumn("place", F.row_number().over(order))


def joined_passages(queries: DataFrame, passages: DataFrame, block: Column, *, by: str = "qid", rank: str = "rank") -> DataFrame:
    """(by, context): the blocks of each query's passages in order of rank, a limit's worth; a fixed sentence where there are none."""
    blocks = passages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), block.alias("block")))).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["block"]), SEPARATOR)
    return queries.select(by).join(blocks, by, "left").select(by, F.coalesce(text, F.lit(NOTHING)).alias("context"))
