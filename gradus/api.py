"""A facade bound to one tenant: the engine's verbs as typed methods that return DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import chunking, grants, guardrails, pipeline, retrieval
from .plans import planner, workload
from .sources import batch


class Refused(PermissionError):
    """The query was not safe; the rules that matched."""


class Mismatch(TypeError):
    """What a tool was given, or gave, is not of its contract."""


@dataclass(frozen=True)
class Tool:
    """A verb with its contract: the columns that each of its tables needs, and those that each of its results has."""

    name: str
    summary: str
    call: Callable[..., Any]
    needs: dict[str, tuple[str, ...]]
    gives: tuple[tuple[str, ...], ...]

    def __call__(self, **given: Any) -> Any:
        """``call`` between two checks: of the schemas alone, so nothing runs for them."""
        for name, columns in self.needs.items():
            if not isinstance(given.get(name), DataFrame):
                raise Mismatch(f"{self.name} needs a table {name}")
            _has(given[name], columns, f"{self.name}: {name}")
        made = self.call(**given)
        for i, (table, columns) in enumerate(zip(made if isinstance(made, tuple) else (made,), self.gives, strict=True)):
            _has(table, columns, f"{self.name}: result {i}")
        return made


def _has(table: DataFrame, columns: tuple[str, ...], where: str) -> None:
    lost = [c for c in columns if c not in table.columns]
    if lost:
        raise Mismatch(f"{where} lacks {', '.join(lost)}")


#: The contracts of the verbs whose results are tables.
CONTRACTS: dict[str, tuple[dict[str, tuple[str, ...]], tuple[tuple[str, ...], ...]]] = {
    "list_documents": ({}, (("document_id",),)),
    "retrieve": ({"queries": ("qid", "query")}, (("qid", "passage_id", "content"), ("qid", "n_passages", "refusal"))),
    "locate": ({"requests": ("document_id", "want")}, (("document_id", "refusal", "excerpt"),)),
    "ingest": ({"documents": ("document_id", "text")}, (("document_id", "chunk_index", "content", "user_id"),)),
    "plan_programme": ({"topics": ("topic_id", "position", "pages", "difficulty", "parents", "keep_with")}, (("topic_id", "term"),)),
}


class Tenant:
    """Reads of one tenant over ``chunks`` (user_id, document_id, chunk_index, content, ...) under ``grants``."""

    def __init__(self, user_id: str, chunks: DataFrame, granted: DataFrame, *, reranker: Callable | None = None) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", user_id):
            raise ValueError("invalid tenant id")
        self.user_id, self.reranker = user_id, reranker
        self.grants = granted.where(F.col("user_id") == user_id)
        self.chunks = grants.authorized(chunks.where(F.col("user_id") == user_id), self.grants)

    def list_documents(self) -> DataFrame:
        return grants.document_list(self.chunks, by=["document_id"], title="content")

    def retrieve(self, queries: DataFrame, *, limit: int = retrieval.LIMIT, coverage: float = retrieval.COVERAGE) -> tuple[DataFrame, DataFrame]:
        """(passages, outcomes) of a batch of queries (qid, query): grounded passages, or the reason for none.

        Each query is judged for itself: one that is not safe has its own refusal and stops no other. A batch with nothing safe in it is refused as a whole.
        """
        judged = guardrails.screen_queries(queries.select("qid", "query"), "query")
        unsafe = judged.where(~F.col("is_safe")).select("matched_rules").limit(1).collect()
        if unsafe and judged.where("is_safe").isEmpty():
            raise Refused(", ".join(unsafe[0].matched_rules))
        whole, queries = judged.select("qid", "is_safe"), judged.where("is_safe").select("qid", "query")
        spots = self.chunks.withColumn("key", F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))).withColumn("text", F.col("content"))
        hits = retrieval.token_overlap(queries.withColumn("text", F.col("query")), spots, qid="qid", key="key", k=limit * retrieval.OVERFETCH).drop("rank")
        found = hits.join(queries.select("qid", "query"), "qid").join(spots.select("key", "document_id", "content"), "key")
        ranked = retrieval.reranked(found, by=["qid"], key="key", scorer=self.reranker, k=limit)
        cited = ranked.drop("rank").withColumn("citable", F.col("document_id").isNotNull())
        passages = retrieval.grounded(cited, coverage=coverage)
        allowed = F.lit(not self.grants.where("state = 'active'").isEmpty())
        ends = retrieval.outcomes(whole, cited, passages, granted=allowed).join(whole, "qid")
        return passages, ends.withColumn("refusal", F.when(~F.col("is_safe"), pipeline.UNSAFE).otherwise(F.col("refusal"))).drop("is_safe")

    def search(self, queries: DataFrame, **options: Any) -> pipeline.Found:
        """The whole retrieval plan for queries (qid, query; sub_queries, document_ids, book_titles) over chunks with book_title; see ``pipeline.retrieve``."""
        place = F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))
        chunks = self.chunks if "key" in self.chunks.columns else self.chunks.withColumn("key", place)
        for name, value in (("book_title", F.lit(None).cast("string")), ("total_chunks", F.lit(None).cast("int"))):
            chunks = chunks if name in chunks.columns else chunks.withColumn(name, value)
        return pipeline.retrieve(queries.withColumn("user_id", F.lit(self.user_id)), chunks, self.grants, **options)

    def locate(self, requests: DataFrame) -> DataFrame:
        return retrieval.located(requests.withColumn("user_id", F.lit(self.user_id)), self.chunks, self.grants)

    def ingest(self, documents: DataFrame, *, key: str = "document_id") -> DataFrame:
        """Chunks of documents (key, text), ready to append."""
        made = chunking.recursive_chunks(documents, key=key)
        return made.withColumn("user_id", F.lit(self.user_id))

    def plan_programme(self, topics: DataFrame, *, by: str, capacity: float = workload.CAPACITY, most: int = workload.MOST_TERMS) -> DataFrame:
        """(by, topic_id, term) of topics (pages, difficulty, position, parents, keep_with)."""
        hours = topics.withColumns(workload.estimate(F.col("pages"), F.col("difficulty")))
        return workload.packed(hours, by=by, capacity=capacity, most=most)

    def plan(self, topics: DataFrame, *, by: str, **options: Any) -> planner.Plan:
        """The whole programme plan of evidence-backed topics; see ``planner.plan``."""
        return planner.plan(topics, by=by, **options)

    def index(self, documents: DataFrame, path: str, run: str, **options: Any) -> batch.Run:
        """Load, chunk and index documents as one run under ``path``, with an outcome a document; see ``batch.ingested``."""
        return batch.ingested(documents, path, run, tenant=F.lit(self.user_id), **options)

    def tools(self) -> dict[str, Tool]:
        """The verbs by name, with what they do and what they need and give."""
        found = {}
        for name, (needs, gives) in CONTRACTS.items():
            verb = getattr(self, name)
            found[name] = Tool(name, (verb.__doc__ or "").strip().split("\n")[0], verb, needs, gives)
        return found

    def call_tool(self, name: str, **given: Any) -> Any:
        """A verb by name; an unknown one is an error that names those that exist."""
        tools = self.tools()
        if name not in tools:
            raise Mismatch(f"no tool {name}; there are {', '.join(sorted(tools))}")
        return tools[name](**given)

    def manifest(self) -> list[dict[str, Any]]:
        """The verbs as plain records."""
        return [{"name": t.name, "summary": t.summary, "needs": {k: list(v) for k, v in t.needs.items()}, "gives": [list(g) for g in t.gives]} for t in self.tools().values()]
