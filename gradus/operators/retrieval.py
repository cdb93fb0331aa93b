"""Retrieval over batches of queries: lexical, dense and fused ranking, grounding and refusal.

Every function takes DataFrames; what counts terms or cuts lineage runs at once, all else is lazy. Rankings run on scores rounded to six digits with ids
as ties, so equal inputs rank equally whatever the partitioning. Query terms are few next to
postings: the corpus is cut to postings of query terms before anything is grouped. Blocks
of queries are broadcast to them, so the pairs of a query and a document are summed and cut to the best of each task where they stand (see ``blocks``); only those
best are shuffled. Where a key repeats, its rows count together: documents are then dealt by key first, and pairs are grouped by key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut, importable
from . import blocks as B
from . import injected, neighbours

PREFETCH, LIMIT, OVERFETCH, COVERAGE, FLOOR = 20, 5, 3, 0.34, 0.08
#: Query terms that may be broadcast at once: some 30 bytes each.
BROADCAST_TERMS = 500_000
#: Pairs of a query and a document that a task may sum at once: some 100 bytes each.
PAIRS = 2_000_000
NO_GRANT, NO_HITS, UNCITABLE, UNGROUNDED = "no_grant", "no_passages", "uncitable", "no_grounding"


def equality(**wanted: object) -> Column | None:
    """The conjunction of equalities; null values are left out, and None stands for no condition."""
    parts = [F.col(k) == F.lit(v) for k, v in wanted.items() if v is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def variants(base: dict[str, object], documents: list[str] | None = None, titles: list[str] | None = None) -> list[dict[str, object]]:
    """The filters of a scope: one a document, else one a title, else the base alone; each gets a ranking of its own."""
    if documents:
        return [base | {"document_id": d} for d in documents]
    return [base | {"book_title": t} for t in titles] if titles else [base]


def postings(docs: DataFrame, terms: Column, *, key: str = "doc_id") -> DataFrame:
    """(key, size, term) of the distinct terms of each row."""
    return docs.select(key, terms.alias("__terms")).select(key, F.size("__terms").alias("size"), F.explode("__terms").alias("term"))


def _query_terms(queries: DataFrame, terms: Column, qid: str) -> tuple[list[DataFrame], DataFrame, bool, int]:
    """Blocks of (qid, qsize, term), each to broadcast; all distinct terms, whether these are few enough to broadcast, and how many queries there are in the largest block or so."""
    rows = queries.select(F.col(qid).alias("qid"), terms.alias("__t")).select("qid", F.size("__t").alias("qsize"), F.explode("__t").alias("term"))
    n, asked = rows.agg(F.count("*"), F.approx_count_distinct("qid")).first()
    wanted, blocks = rows.select("term").distinct(), max(1, -(-n // BROADCAST_TERMS))
    if blocks == 1:
        return [F.broadcast(rows)], F.broadcast(wanted), True, asked
    rows = cut(rows)
    dealt = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    return [F.broadcast(rows.where(dealt == b)) for b in range(blocks)], wanted, False, -(-asked // blocks)


def dealt(docs: DataFrame, key: str, queries: int) -> DataFrame:
    """Rows by key, in as many parts as keep PAIRS in each, so that the work of a task does not grow with the corpus."""
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * max(1, queries) // PAIRS))
    return docs.repartition(parts, key)


def small(rows: DataFrame) -> DataFrame:
    """``rows``, computed once, to broadcast where they are few: what they meet is then not shuffled."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_TERMS else rows


def repeated(docs: DataFrame, key: str) -> bool:
    """Whether a key stands in more rows than one, or is null."""
    return not docs.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty()


def _overlap_in_place(queries: DataFrame, docs: DataFrame, blocks: list[DataFrame], qid: str, key: str, body: str, k: int | None, floor: float) -> DataFrame:
    said, kinds = importable(docs.sparkSession) and docs.select(key, X.tokens(F.col(body)).alias("words")), dict(queries.dtypes)
    once, share = lambda counts, sizes: np.ones(len(counts)), lambda sums, asked, sizes: sums / np.sqrt(asked * np.maximum(sizes, 1))
    score = F.round(X.token_score(F.col("overlap"), F.col("qsize"), F.col("size")), 6)

    def scored(block: DataFrame) -> DataFrame:
        given = docs.sparkSession.sparkContext.broadcast(B.Block.of(block))
        if given.value is None:
            return docs.sparkSession.createDataFrame([], f"qid {kinds[qid]}, `{key}` {dict(docs.dtypes)[key]}, overlap long, score double, rank int")
        met = B.best(B.coded(said, key, "words", given), key, kinds[qid], given, once, share, B.MOST + 1 if k is None else k, floor)
        counted = met.select("qid", key, F.col("sum").cast("long").alias("overlap"), F.col("qsize").cast("int").alias("qsize"), "size")
        found = counted.withColumn("score", score).where(F.col("score") >= floor)
        return found if k is None else top(found, ["qid"], "score", key, k)

    return reduce(DataFrame.unionByName, map(scored, blocks)).select("qid", key, "overlap", "score", *["rank"][: k is not None])


def _bm25_in_place(queries: DataFrame, docs: DataFrame, blocks: list[DataFrame], qid: str, key: str, body: str, k: int, k1: float, b: float, idf: bool) -> DataFrame:
    spark, kinds = importable(docs.sparkSession), dict(queries.dtypes)
    said = docs.select(key, F.regexp_extract_all(F.lower(body), F.lit(X.TOKEN), F.lit(0)).alias("words"))

    def scored(rows: DataFrame) -> DataFrame:
        block = B.Block.of(rows.withColumn("qsize", F.lit(0)))  # terms of repeated query ids are pooled
        nothing = spark.createDataFrame([], f"qid {kinds[qid]}, `{key}` {dict(docs.dtypes)[key]}, score double, rank int")
        if block is None:
            return nothing
        coded = cut(B.coded(said, key, "words", spark.sparkContext.broadcast(block)))
        n, mean = coded.agg(F.count("*"), F.avg("size")).first()
        if not mean:
            return nothing
        df = np.zeros(len(block.terms))
        for held in B.holders(coded, len(df)).toArrow().to_batches():  # as many rows as the block has terms at most
            df[held.column(0).to_numpy()] = held.column(1).to_numpy()
        given = spark.sparkContext.broadcast(B.weighed(block, np.log1p((n - df + 0.5) / (df + 0.5)) if idf else np.ones(len(df))))
        part = lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        met = B.best(coded, key, kinds[qid], given, part, lambda sums, asked, sizes: sums, k)
        return top(met.select("qid", key, F.round("sum", 6).alias("score")), ["qid"], "score", key, k)

    return reduce(DataFrame.unionByName, map(scored, blocks)).select("qid", key, "score", "rank")


def top(scored: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """Rows of the k best scores of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def token_overlap(queries: DataFrame, docs: DataFrame, *, qid: str = "item_id", key: str = "doc_id", body: str = "text", k: int | None = LIMIT, floor: float = FLOOR) -> DataFrame:
    """(qid, key, overlap, score, rank): shared tokens over the root of both sizes, from ``floor`` up; without ``k`` all of them, unranked."""
    blocks, _, _, asked = _query_terms(queries, X.tokens(F.col(body)), qid)
    if not repeated(docs, key):
        return _overlap_in_place(queries, docs, blocks, qid, key, body, k, floor)
    held = postings(dealt(docs.select(key, body), key, asked), X.tokens(F.col(body)), key=key)

    def scored(block: DataFrame) -> DataFrame:
        counted = held.join(block, "term").groupBy("qid", key, "qsize", "size").agg(F.count("*").alias("overlap"))
        score = F.round(X.token_score(F.col("overlap"), F.col("qsize"), F.col("size")), 6)
        found = counted.withColumn("score", score).where(F.col("score") >= floor)
        return found if k is None else top(found, ["qid"], "score", key, k)

    return reduce(DataFrame.unionByName, map(scored, blocks)).select("qid", key, "overlap", "score", *["rank"][: k is not None])


def bm25(queries: DataFrame, docs: DataFrame, *, qid: str = "item_id", key: str = "doc_id", body: str = "text", k: int = LIMIT, k1: float = 1.2, b: float = 0.75, idf: bool = True) -> DataFrame:
    """(qid, key, score, rank) by BM25; ``idf=False`` ranks by saturated term frequencies alone."""
    blocks, wanted, few, asked = _query_terms(queries, X.tokens(F.col(body)), qid)
    if not repeated(docs, key):
        return _bm25_in_place(queries, docs, blocks, qid, key, body, k, k1, b, idf)
    words = F.regexp_extract_all(F.lower(body), F.lit(X.TOKEN), F.lit(0)).alias("words")
    stats = docs.select(words).agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    said = dealt(docs.select(key, body), key, asked).select(key, words).select(key, F.size("words").alias("length"), F.explode("words").alias("term"))
    tf = (said.join(wanted, "term", "left_semi") if few else said).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    df = (df if few else df.join(wanted, "term", "left_semi")).crossJoin(F.broadcast(stats))  # one row of totals
    df = cut(df)  # as many rows as the queries have terms at most
    weight = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) if idf else F.lit(1.0)
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    def scored(block: DataFrame) -> DataFrame:
        weighed = F.broadcast(block.select("qid", "term").join(df, "term"))
        summed = tf.join(weighed, "term").groupBy("qid", key).agg(F.round(F.sum(part), 6).alias("score"))
        return top(summed, ["qid"], "score", key, k)

    return reduce(DataFrame.unionByName, map(scored, blocks)).select("qid", key, "score", "rank")


def dense(queries: DataFrame, vectors: DataFrame, *, qid: str = "qid", key: str = "vec_id", vector: str = "embedding", k: int = LIMIT, centres: int = neighbours.CENTRES, block: int = neighbours.BLOCK) -> DataFrame:
    """(qid, key, score, rank): the exact k best vectors of every query by cosine; see ``neighbours`` for how, and for odd rows."""
    return neighbours.search(queries, vectors, qid=qid, key=key, vector=vector, k=k, centres=centres, block=block)[0]


def fused(branches: list[DataFrame], *, by: list[str], key: str, k: int = LIMIT, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked branches: the sum of 1 / (constant + rank)."""
    both = reduce(DataFrame.unionByName, [b.select(*by, key, "rank") for b in branches])
    summed = both.groupBy(*by, key).agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 6).alias("score"))
    return top(summed, by, "score", key, k)


def deduplicated(hits: DataFrame, *, by: list[str], key: str | list[str], score: str = "score", arrival: list[str]) -> DataFrame:
    """The best hit of each id (one column or several); of equal scores the first to arrive."""
    order = Window.partitionBy(*by, *([key] if isinstance(key, str) else key)).orderBy(F.desc(score), *arrival)
    return hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def lexical_score(query: Column, content: Column) -> Column:
    """Share of the query's distinct words, cut at white space, that the content has; inside the JVM."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    asked = words(query)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, words(content))) / F.size(asked))


#: The default scorer: ``lexical_score`` of query and content.
LEXICAL = "lexical"


def reranked(hits: DataFrame, *, by: list[str], key: str, scorer: Callable | Column | str | None = LEXICAL, k: int = LIMIT, attempts: int = injected.ATTEMPTS) -> DataFrame:
    """Hits by the scorer, cut to k after sorting; ``original_score`` and ``rerank_score`` tell both.

    The scorer is a column, LEXICAL, or a function of two pandas series (query, content). A query keeps the order of its own
    scores without a scorer, where it has one hit, and where the function failed for any of its hits (see ``injected``).
    """
    own, whole = F.col("score"), Window.partitionBy(*by)
    if scorer is None:
        ranked = hits.withColumns({"original_score": own, "rerank_score": F.lit(None).cast("double")})
        return top(ranked, by, "score", key, k)
    if callable(scorer) and not isinstance(scorer, Column):
        made = hits.withColumn("__scored", injected.applied(scorer, "double", "query", "content", attempts=attempts))
        score = F.when(~F.bool_or(F.col("__scored.value").isNull()).over(whole), F.col("__scored.value"))
    else:
        made, score = hits, lexical_score(F.col("query"), F.col("content")) if isinstance(scorer, str) else scorer
    ranked = made.withColumns({"original_score": own, "rerank_score": F.when(F.count("*").over(whole) > 1, score)}).drop("__scored")
    return top(ranked.withColumn("score", F.round(F.coalesce("rerank_score", "original_score"), 6)), by, "score", key, k)


def accepted_rewrites(queries: DataFrame, *, qid: str = "qid", query: str = "query", subs: str = "sub_queries", unsafe: Column | None = None, most: int = 4) -> DataFrame:
    """(qid, position, query): the original and its safe rewrites in order, distinct, ``most`` in all.

    A rewrite is not blank, has 500 characters at most and no control character, and shares a token
    of two characters or more with its original.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    rows = queries.select(qid, F.col(query).alias("__own"), F.posexplode(F.concat(F.array(query), F.coalesce(F.transform(subs, X.strip), F.array().cast("array<string>")))).alias("__at", "query"))
    safe = (F.col("query") != "") & (F.length("query") <= 500) & ~F.col("query").rlike(r"[\x00-\x1f\x7f]") & F.arrays_overlap(words(F.col("query")), words(F.col("__own")))
    if unsafe is not None:
        safe = safe & ~unsafe
    first = rows.where((F.col("__at") == 0) | F.coalesce(safe, F.lit(False))).groupBy(qid, "query").agg(F.min("__at").alias("__at"))
    order = Window.partitionBy(qid).orderBy("__at")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most).select(qid, "position", "query")


def accepted_expansion(query: Column, expansion: Column) -> Column:
    """The expansion if it has 50 words at most and shares a token with the query, else the query."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    fine = (F.size(F.split(X.strip(expansion), r"\s+")) <= 50) & F.arrays_overlap(words(query), words(expansion)) & (X.strip(expansion) != "")
    return F.when(fine, X.strip(expansion)).otherwise(query)


def grounded(hits: DataFrame, *, by: str = "qid", coverage: float = COVERAGE, least: float | None = None) -> DataFrame:
    """Passages that may be cited: with content, a citation and enough of the query's terms, renumbered S1, S2, ... by score."""
    fine = (X.strip(F.col("content")) != "") & F.col("citable")
    if least is not None:
        fine = fine & (F.col("score") >= least)
    share = F.round(X.term_coverage(X.content_terms(F.col("query")), X.content_terms(F.col("content"))), 6)
    kept = hits.where(fine).withColumn("term_coverage", share).where(F.col("term_coverage") >= coverage)
    order = Window.partitionBy(by).orderBy(F.desc("score"), "key")
    return kept.withColumn("rank", F.row_number().over(order)).withColumn("passage_id", F.concat(F.lit("S"), F.col("rank").cast("string")))


def outcomes(queries: DataFrame, hits: DataFrame, passages: DataFrame, *, granted: Column | None = None, by: str = "qid") -> DataFrame:
    """(by, n_passages, refusal): passages, or the first reason why there are none, never both."""
    found = hits.groupBy(by).agg(F.count("*").alias("n_hits"), F.count_if("citable").alias("n_citable"))
    kept = passages.groupBy(by).agg(F.count("*").alias("n_passages"))
    joined = queries.join(found, by, "left").join(kept, by, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    reason = F.when(~granted, NO_GRANT) if granted is not None else F.when(F.lit(False), NO_GRANT)
    reason = reason.when(n("n_hits") == 0, NO_HITS).when(n("n_citable") == 0, UNCITABLE).when(n("n_passages") == 0, UNGROUNDED)
    return joined.select(by, n("n_passages").alias("n_passages"), reason.alias("refusal"))


def merged_evidence(passages: DataFrame, *, group: str, keys: list[str], limit: int) -> DataFrame:
    """Evidence of all seeds of a group: the best passage of each place, renumbered, ``2 * limit`` at most."""
    best = deduplicated(passages, by=[group], key=keys, arrival=["seed", "rank"])
    order = Window.partitionBy(group).orderBy(F.desc("score"), *keys)
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * limit)
    return ranked.withColumn("passage_id", F.concat(F.lit("S"), F.col("rank").cast("string")))


def resolved_citations(cited: DataFrame, passages: DataFrame, *, by: str = "qid") -> DataFrame:
    """Cited passage ids, trimmed, upper-cased, well-formed and distinct, with the place of each; ``known`` tells unknown ones."""
    clean = F.array_distinct(F.filter(F.transform("source_ids", lambda s: F.upper(X.strip(s))), lambda s: s.rlike(r"^S\d+$")))
    rows = cited.select(by, F.posexplode(clean).alias("position", "passage_id"))
    return rows.join(passages, [by, "passage_id"], "left").withColumn("known", F.col("document_id").isNotNull())


def located(requests: DataFrame, chunks: DataFrame, grants: DataFrame, *, excerpt: int = 600) -> DataFrame:
    """The source of a document (and chunk): its first chunk by index, or a reason; only for documents that the user is granted."""
    allowed = requests.join(grants.where("state = 'active'").select("user_id", "document_id").distinct().withColumn("granted", F.lit(True)), ["user_id", "document_id"], "left")
    wanted = F.col("want").isNull() | (F.col("want") == F.col("chunk_index"))
    met = allowed.join(chunks.select("user_id", "document_id", "chunk_index", "content"), ["user_id", "document_id"], "left")
    first = met.groupBy("user_id", "document_id", "want").agg(
        F.max("granted").alias("granted"), F.min(F.when(wanted & F.col("chunk_index").isNotNull(), F.struct("chunk_index", "content"))).alias("hit")
    )
    reason = F.when(F.col("granted").isNull(), NO_GRANT).when(F.col("hit").isNull(), NO_HITS)
    return first.select("user_id", "document_id", "want", reason.alias("refusal"), F.when(reason.isNull(), F.left("hit.content", F.lit(excerpt))).alias("excerpt"))


def nearest(value: Column, valid: Column) -> Column:
    """The member of an array nearest to ``value``; of two as near, the one that comes first."""
    far = F.transform(valid, lambda p, i: F.struct(F.abs(p - value).alias("far"), i.alias("i"), p.alias("p")))
    return F.array_min(far)["p"]
