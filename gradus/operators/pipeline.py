"""The whole retrieval as one plan over a batch of queries: scopes, search, deduplication, reranking, citation, screening, grounding.

A scope is a row: a query in one of its wordings (the original and its accepted rewrites) under one filter (a granted document
each, else a title each, else the tenant's all). Every scope is ranked on its own, so no document is crowded out by another; the hits
of a query's scopes are then merged, the best of each chunk. Nothing is collected and no query is handled apart from the others.

Defined results: a query that is not safe, and one all of whose requested documents are not granted, has no scope and its own refusal. Empty lists
of documents, titles and rewrites count as none. Chunks without an active grant of their tenant are never searched. Null contents match nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import guardrails, retrieval

UNSAFE = "unsafe_query"


@dataclass(frozen=True)
class Found:
    """``scopes`` that were searched, ``hits`` after reranking, ``passages`` that may be cited, and an ``outcomes`` row a query."""

    scopes: DataFrame
    hits: DataFrame
    passages: DataFrame
    outcomes: DataFrame


def _some(queries: DataFrame, name: str, kind: str) -> Column:
    """A list column, empty where it is null or missing."""
    none = F.array().cast(f"array<{kind}>")
    return F.coalesce(F.col(name), none) if name in queries.columns else none


def _active(grants: DataFrame) -> DataFrame:
    return grants.where("state = 'active'").select("user_id", "document_id").distinct()


def scopes(queries: DataFrame, grants: DataFrame, *, rewrites: bool = True) -> DataFrame:
    """(qid, user_id, own, position, query, variant, document_id, book_title): every wording of a query under every filter.

    ``queries`` has qid, user_id, query and, as they apply, sub_queries, document_ids, book_titles. Repeated documents and titles count once.
    """
    kind = dict(grants.dtypes)["document_id"]
    rows = queries.select("qid", "user_id", F.col("query").alias("own"), _some(queries, "document_ids", kind).alias("wanted"), F.array_distinct(_some(queries, "book_titles", "string")).alias("titles"))
    unsafe = F.size(guardrails.rules(F.coalesce("query", F.lit("")), guardrails.DIRECT, guardrails.MAX_QUERY)) > 0
    asked = queries.select("qid", "query", (_some(queries, "sub_queries", "string") if rewrites else F.array().cast("array<string>")).alias("sub_queries"))
    words = retrieval.accepted_rewrites(asked, unsafe=unsafe).select("qid", "position", "query")

    each = rows.select("qid", "user_id", F.posexplode(F.array_distinct("wanted")).alias("variant", "document_id"))
    documents = each.join(_active(grants), ["user_id", "document_id"], "left_semi").select("qid", "variant", "document_id", F.lit(None).cast("string").alias("book_title"))
    free = rows.where(F.size("wanted") == 0)
    titles = free.select("qid", F.posexplode("titles").alias("variant", "book_title")).select("qid", "variant", F.lit(None).cast(kind).alias("document_id"), "book_title")
    all_ = free.where(F.size("titles") == 0).select("qid", F.lit(0).alias("variant"), F.lit(None).cast(kind).alias("document_id"), F.lit(None).cast("string").alias("book_title"))
    return rows.select("qid", "user_id", "own").join(words, "qid").join(documents.unionByName(titles).unionByName(all_), "qid")


def lexical(scoped: DataFrame, chunks: DataFrame, k: int, floor: float = retrieval.FLOOR) -> DataFrame:
    """(qid, position, variant, key, score, rank): token overlap of every scope with the chunks that its filter lets through, k each.

    Postings meet query terms of their own tenant alone; a common term's rows spread over its tenants.
    """
    terms = scoped.select("qid", "position", "variant", "user_id", "document_id", "book_title", X.tokens(F.col("query")).alias("__t"))
    terms = terms.select(*terms.columns[:-1], F.size("__t").alias("qsize"), F.explode("__t").alias("term"))
    if terms.count() <= retrieval.BROADCAST_TERMS:
        terms = F.broadcast(terms)
    said = chunks.select("key", "user_id", F.col("document_id").alias("__document"), F.col("book_title").alias("__title"), X.tokens(F.col("content")).alias("__t"))
    said = said.select("key", "user_id", "__document", "__title", F.size("__t").alias("size"), F.explode("__t").alias("term"))
    fits = (F.col("document_id").isNull() | (F.col("document_id") == F.col("__document"))) & (F.col("book_title").isNull() | (F.col("book_title") == F.col("__title")))
    met = said.join(terms, ["user_id", "term"]).where(fits).groupBy("qid", "position", "variant", "key", "qsize", "size").agg(F.count("*").alias("overlap"))
    scored = met.withColumn("score", F.round(X.token_score(F.col("overlap"), F.col("qsize"), F.col("size")), 6)).where(F.col("score") >= floor)
    return retrieval.top(scored, ["qid", "position", "variant"], "score", "key", k).select("qid", "position", "variant", "key", "score", "rank")


def promoted(hits: DataFrame, nested: str = "metadata", fields: tuple[str, ...] = ("collection_id", "book_title", "section", "document_id")) -> DataFrame:
    """``hits`` with citation fields that are missing taken from the nested map; pages as digits, the estimate as a word."""
    if nested not in hits.columns:
        return hits
    held = F.col(nested)
    known = lambda c: F.when(F.col(c).cast("string").isNull() | (F.col(c).cast("string") == ""), None).otherwise(F.col(c))
    more = {f: F.coalesce(known(f), X.missing(held[f]).cast(dict(hits.dtypes)[f])) if f in hits.columns else X.missing(held[f]) for f in fields}
    page = F.coalesce(X.missing(held["page_number"]), X.missing(held["page"]))
    digits = F.when(X.strip(page).rlike(r"^[0-9]+$"), X.strip(page).try_cast("int"))
    more["page_number"] = F.coalesce(F.col("page_number"), digits) if "page_number" in hits.columns else digits
    guess = F.lower(X.strip(held["page_is_estimated"])) == "true"
    more["page_is_estimated"] = F.coalesce(guess, F.col("page_is_estimated")) if "page_is_estimated" in hits.columns else guess
    return hits.withColumns(more)


def retrieve(
    queries: DataFrame, chunks: DataFrame, grants: DataFrame, *, search: Callable[[DataFrame, DataFrame, int], DataFrame] = lexical, scorer: Callable | Column | None = retrieval.LEXICAL,
    rewrites: bool = True, limit: int = retrieval.LIMIT, coverage: float = retrieval.COVERAGE, least: float | None = None,
) -> Found:
    """Queries (see ``scopes``) over chunks (key, user_id, document_id, book_title, chunk_index, total_chunks, content; page_number, section and a map metadata as known).

    ``search(scopes, chunks, k)`` returns (qid, position, variant, key, score, rank) of each scope; ``scorer`` is what ``retrieval.reranked`` takes.
    """
    judged = guardrails.screen_queries(queries, "query").withColumn("__safe", F.col("is_safe")).drop("matched_rules", "is_safe")
    allowed = chunks.join(retrieval.small(_active(grants)), ["user_id", "document_id"], "left_semi")
    scoped = scopes(judged.where("__safe"), grants, rewrites=rewrites)
    found = search(scoped, allowed, limit * (1 if scorer is None else retrieval.OVERFETCH))
    best = retrieval.deduplicated(found, by=["qid"], key="key", arrival=["position", "variant", "rank"]).drop("rank")

    details = [c for c in ("document_id", "book_title", "page_number", "section", "chunk_index", "total_chunks", "content", "metadata", "page_is_estimated", "collection_id") if c in allowed.columns]
    whole = retrieval.small(best.join(queries.select("qid", "query"), "qid")).join(allowed.select("key", *details), "key")
    ranked = promoted(retrieval.reranked(whole, by=["qid"], key="key", scorer=scorer, k=limit))
    has = lambda c, other: F.col(c) if c in ranked.columns else F.lit(other)
    line = X.citation_line(F.col("rank"), has("book_title", None), has("page_number", None), F.coalesce(has("section", ""), F.lit("")), has("chunk_index", None), has("total_chunks", None), X.shown_score(F.col("score")))
    cited = ranked.withColumns({"citation": line, "citable": F.col("document_id").isNotNull()})
    hits = guardrails.screen_sources(cited, "content").withColumn("source_injection_flagged", ~F.col("is_safe")).withColumnRenamed("matched_rules", "source_injection_rules").drop("is_safe")
    passages = retrieval.grounded(hits.drop("rank"), coverage=coverage, least=least)

    reached = scoped.select("qid").distinct().withColumn("__granted", F.lit(True))
    asked = judged.select("qid", "__safe").join(reached, "qid", "left")
    ends = retrieval.outcomes(asked, hits, passages, granted=F.col("__granted").isNotNull())
    ends = ends.join(judged.select("qid", "__safe"), "qid").withColumn("refusal", F.when(~F.col("__safe"), UNSAFE).otherwise(F.col("refusal"))).drop("__safe")
    return Found(scoped, hits, passages, ends)


def packed(found: Found) -> DataFrame:
    """One row a query: (qid, refusal, n_passages, passages), the passages in order with their ids and citations."""
    item = F.struct("rank", "passage_id", "key", "score", "term_coverage", "citation", "content", "source_injection_flagged")
    lists = found.passages.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("passages"))
    return found.outcomes.join(lists, "qid", "left").withColumn("passages", F.coalesce("passages", F.array().cast(dict(lists.dtypes)["passages"])))
