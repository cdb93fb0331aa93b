"""Named queries of hybrid retrieval, ingestion, programmes, path review and course rows; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _TERMS, BM25, ESTIMATE, GROUNDED, LINES, _cited_hits, _estimated, line_chunks, query
from .functions import text as X
from .operators import contracts, hybrid, lifecycle, retrieval, sections
from .plans import approval, chapters, overlap, paths, programme, workload
from .session import spread, table
from .sources import ingest

# Retrieval

HYBRID_BM25 = BM25.replace("FROM benchmark", "FROM hq").replace("item_id", "qid")


@query(f"""WITH hq AS (SELECT doc_id AS qid, text, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 100 = 0), {HYBRID_BM25},
near AS (SELECT qid, vec_id AS doc_id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS score FROM hq CROSS JOIN embeddings),
both_ AS (SELECT qid, doc_id, rank FROM bhits WHERE rank <= 20 UNION ALL SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= 20),
f AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM both_ GROUP BY ALL)
SELECT qid, doc_id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INT AS rank FROM f QUALIFY rank <= 5""")
def retrieve_hybrid(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = docs.where("doc_id % 100 = 0").join(vectors, "doc_id").select(F.col("doc_id").alias("qid"), "text", "embedding")
    return hybrid.hybrid(asked, docs, vectors)


_CLIP = "CASE WHEN length(d.text) > 1200 THEN rtrim(d.text[1:1200]) || '…' ELSE d.text END"
_ESCAPED = f"replace(replace(replace(replace(replace({_CLIP}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH {GROUNDED}, j AS (SELECT item_id, string_agg('<untrusted_data label="passage">' || chr(10) || {_ESCAPED} || chr(10) || '</untrusted_data>', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM kept JOIN documents d USING (doc_id) GROUP BY item_id)
SELECT item_id, coalesce(context, 'No relevant documents found.') AS context FROM benchmark LEFT JOIN j USING (item_id)""")
def retrieve_joined(spark, sf_dir):
    passages = retrieval.grounded(_cited_hits(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return hybrid.joined_passages(asked, passages, X.data_block("passage", X.clipped(F.col("content"), 1200))).withColumnRenamed("qid", "item_id")


@query(f"WITH {LINES}, n AS (SELECT document_id, chunk_index AS line, CASE WHEN chunk_index % 4 <> 0 THEN chunk_index END AS i FROM lines) SELECT document_id, line::INT AS line, (row_number() OVER (PARTITION BY document_id ORDER BY i NULLS LAST, line))::INT AS place FROM n")
def chunks_nulls_last(spark, sf_dir):
    rows = line_chunks(spark, sf_dir).select("document_id", F.col("chunk_index").alias("line"), F.when(F.col("chunk_index") % 4 != 0, F.col("chunk_index")).alias("i"))
    return hybrid.in_order(rows, by="document_id", index="i", ties=["line"]).select("document_id", "line", "place")


@query("""WITH c AS (SELECT c.conv_id, c.turn, c.text AS q, n.text AS e FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
t AS (SELECT *, regexp_replace(e, '^\\s+|\\s+$', '', 'g') AS s FROM c)
SELECT conv_id, turn, CASE WHEN s <> '' AND len(regexp_split_to_array(s, '\\s+')) <= 50 AND list_has_any(regexp_extract_all(lower(q), '[a-z0-9]{2,}'), regexp_extract_all(lower(e), '[a-z0-9]{2,}')) THEN s ELSE q END AS query FROM t""")
def query_expansion(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    after = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("e"))
    return said.join(after, ["conv_id", "turn"]).select("conv_id", "turn", retrieval.accepted_expansion(F.col("text"), F.col("e")).alias("query"))


# Ingestion


@query("""WITH o AS (SELECT doc_id, [CASE WHEN doc_id % 2 = 0 THEN 'TimeoutError' WHEN doc_id % 7 = 0 THEN 'ValueError' END, CASE WHEN doc_id % 3 = 0 THEN 'OSError' WHEN doc_id % 5 = 0 THEN 'KeyError' END, CASE WHEN doc_id % 4 = 0 THEN 'TimeoutError' END, 'late'] AS os FROM documents),
x AS (SELECT doc_id, unnest(range(1, 4)) AS i, unnest(os[1:3]) AS e FROM o), p AS (SELECT *, e IN ('FileNotFoundError', 'IsADirectoryError', 'NotADirectoryError', 'PermissionError', 'ImportError', 'ValueError', 'TypeError', 'KeyError') AS permanent FROM x)
SELECT doc_id, i::INT AS attempts, e IS NULL AS ok, e AS error, e IS NOT NULL AND NOT permanent AS retryable FROM p WHERE e IS NULL OR permanent OR i = 3 QUALIFY i = min(i) OVER (PARTITION BY doc_id)""")
def ingest_attempts(spark, sf_dir):
    i = F.col("doc_id")
    said = F.array(
        F.when(i % 2 == 0, "TimeoutError").when(i % 7 == 0, "ValueError"), F.when(i % 3 == 0, "OSError").when(i % 5 == 0, "KeyError"), F.when(i % 4 == 0, "TimeoutError"), F.lit("late"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", ingest.attempts(said).alias("x")).select("doc_id", "x.*")


@query("""WITH i AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 5 <> 0), r AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0), f AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 11 <> 0)
SELECT id, 'unrouted' AS problem FROM i WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'no_file' FROM i WHERE id NOT IN (SELECT id FROM f)
UNION ALL SELECT id, 'unknown_route' FROM r WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT id, 'unknown_file' FROM f WHERE id NOT IN (SELECT id FROM i)""")
def prompt_catalog_problems(spark, sf_dir):
    some = lambda n: table(spark, sf_dir, "part").where(f"p_partkey % {n} <> 0").select(F.col("p_partkey").alias("id"))
    return ingest.catalog_problems(some(5), some(7), some(11))


@query("""WITH w AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0::DOUBLE AS wait FROM events)
SELECT user_id, count(*) FILTER (wait > 3600) AS n_gaps, max(wait) AS longest_s FROM w GROUP BY user_id""")
def heartbeat_gaps(spark, sf_dir):
    return ingest.heartbeat_gaps(table(spark, sf_dir, "events"), by="user_id", most=3600.0)


# Programmes


@query(f"""WITH {LINES}, p AS (SELECT document_id, CASE WHEN chunk_index % 5 <> 0 THEN chunk_index // 3 END AS page FROM lines)
SELECT document_id, count(DISTINCT page) AS pages, greatest(1, count(DISTINCT page)) AS page_span FROM p GROUP BY document_id""")
def pages_per_document(spark, sf_dir):
    page = F.when(F.col("chunk_index") % 5 != 0, F.floor(F.col("chunk_index") / 3))
    return programme.page_counts(line_chunks(spark, sf_dir).withColumn("page", page), by="document_id")


@query("""WITH t AS (SELECT s_nationkey AS collection_id, s_suppkey AS topic_id, 'topic ' || (s_suppkey % 7)::VARCHAR AS n, ['topic ' || (s_suppkey * 3 % 9)::VARCHAR, 'topic ' || (s_suppkey % 5)::VARCHAR] AS needs FROM supplier),
ids AS (SELECT collection_id, n, max(topic_id) AS prerequisite_id FROM t GROUP BY ALL), a AS (SELECT collection_id, topic_id, unnest(range(0, 2)) AS place, unnest(needs) AS n FROM t)
SELECT collection_id, topic_id, place::INT AS place, prerequisite_id FROM a JOIN ids USING (collection_id, n)""")
def topic_prerequisites(spark, sf_dir):
    k = F.col("s_suppkey")
    named = lambda start, n, end: F.concat(F.lit(start), n.cast("string"), F.lit(end))
    topics = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("collection_id"), k.alias("topic_id"), k.alias("position"), named("Topic ", k % 7, "").alias("title"),
        F.array(named(" TOPIC ", k * 3 % 9, "\n"), named("topic ", k % 5, "")).alias("prerequisites"),
    )
    return programme.prerequisite_ids(topics, by="collection_id")


@query("""WITH c AS (SELECT l_orderkey AS programme, l_linenumber AS i, l_partkey % 2 AS d, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 END AS page, l_returnflag AS s FROM lineitem),
f AS (SELECT programme, i FROM c QUALIFY row_number() OVER (PARTITION BY programme, d, page, s ORDER BY i) = 1) SELECT programme, i, (row_number() OVER (PARTITION BY programme ORDER BY i))::INT AS citation_no FROM f""")
def citations_distinct(spark, sf_dir):
    k = F.col("l_partkey")
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("programme"), F.col("l_linenumber").alias("i"), (k % 2).alias("document_id"), F.when(k % 3 > 0, k % 3).alias("page"), F.col("l_returnflag").alias("section"))
    return programme.distinct_citations(cited, by="programme", order=["i"]).select("programme", "i", "citation_no")


@query("SELECT l_orderkey AS run_id, sum(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber END + l_partkey % 4)::BIGINT AS citation_count FROM lineitem GROUP BY 1")
def citation_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "run_id")
    lists = lambda n: F.array_repeat(F.lit("c"), n.cast("int"))
    lectures = rows.select("run_id", F.when(F.col("l_linenumber") % 3 != 0, lists(F.col("l_linenumber"))).alias("citations"))
    return programme.citation_counts(lectures, rows.select("run_id", lists(F.col("l_partkey") % 4).alias("citations")), by="run_id")


@query("""WITH c AS (SELECT l_orderkey AS book_id, l_linenumber AS i, min(l_returnflag) AS t, l_linenumber * 200 AS s, min(l_partkey) % 120 + 1 AS n FROM lineitem GROUP BY l_orderkey, l_linenumber), m AS (SELECT book_id, median(n) AS m, count(*) AS k FROM c GROUP BY book_id),
z AS (SELECT c.*, CASE WHEN n <= greatest(3, m * 0.35::DOUBLE) THEN 'tiny' WHEN n <= greatest(6, m * 0.65::DOUBLE) THEN 'small' WHEN n >= 80 AND (k = 1 OR n >= m * 1.65::DOUBLE) THEN 'large' ELSE 'standard' END AS size FROM c JOIN m USING (book_id))
SELECT book_id, string_agg('[ch' || i || '] ' || t || ' | pages ' || s || '-' || (s + n - 1) || ' | ' || n || ' pages | size=' || size, chr(10) ORDER BY i) AS inventory FROM z GROUP BY book_id""")
def chapter_inventory(spark, sf_dir):
    i, n = F.col("l_linenumber"), F.col("l_partkey") % 120 + 1
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"))
    rows = one.select(
        F.col("l_orderkey").alias("book_id"), i.alias("chapter_no"), F.concat(F.lit("ch"), i.cast("string")).alias("chapter_id"), F.col("l_returnflag").alias("title"),
        (i * 200).alias("start_page"), (i * 200 + n - 1).alias("end_page"), n.alias("page_count"),
    )
    return programme.inventory_text(chapters.sized(rows))


PACKED = ESTIMATE + """, o AS (SELECT programme, topic_id, total_hours, row_number() OVER (PARTITION BY programme ORDER BY topic_id) AS i FROM h),
w AS (SELECT programme, topic_id, i, total_hours, 1 AS term, total_hours AS used FROM o WHERE i = 1
  UNION ALL SELECT o.programme, o.topic_id, o.i, o.total_hours, CASE WHEN used + o.total_hours > 120 AND term < 8 THEN term + 1 ELSE term END, CASE WHEN used + o.total_hours > 120 AND term < 8 THEN o.total_hours ELSE used + o.total_hours END FROM w JOIN o ON o.programme = w.programme AND o.i = w.i + 1)"""
_NEED = "greatest(1, ceil(round(total / 120, 6)))::BIGINT::VARCHAR"


@query(f"""WITH RECURSIVE {PACKED},
a AS (SELECT programme, round(sum(total_hours), 2) AS total, count(*) AS n, arg_min(topic_id, (-total_hours, topic_id)) AS top, max(total_hours) AS most FROM h GROUP BY programme),
terms AS (SELECT programme, term, count(*) AS n, round(sum(total_hours), 2) AS hours FROM w GROUP BY ALL),
laid AS (SELECT programme, count(*) AS k, round(sum(hours), 2) AS total, string_agg('term ' || term || ' has ' || n || ' with ' || hours || ' h', ', ' ORDER BY term) AS b, string_agg(term::VARCHAR, ' ' ORDER BY term) FILTER (hours > 120) AS over_ FROM terms GROUP BY programme)
SELECT programme, 'workload-total' AS decision_id, 'workload' AS kind, 'hours: ' || total || ', topics: ' || n AS summary,
  'longest: T' || top || ' with ' || most || ' h by pages; a term holds 120.0 h; terms needed: ' || {_NEED} AS rationale FROM a
UNION ALL SELECT programme, 'semester-layout', 'semester', 'terms: ' || k,
  CASE WHEN k = 1 THEN 'one term of 120.0 h takes ' || total || ' h: ' || b ELSE 'hours ask for ' || {_NEED} || ', prerequisites for the rest: ' || b END
  || coalesce('; no further term was allowed, so these are too full: ' || over_, '') FROM laid""")
def programme_decisions(spark, sf_dir):
    none = F.array().cast("array<bigint>")
    topics = _estimated(spark, sf_dir).withColumns({"title": F.concat(F.lit("T"), F.col("topic_id").cast("string")), "basis": F.lit("pages"), "position": F.col("topic_id"), "parents": none, "keep_with": none})
    packed = workload.packed(topics, by="programme").join(topics.select("topic_id", "total_hours"), "topic_id")
    return programme.workload_decision(topics, by="programme").unionByName(programme.layout_decision(packed, by="programme"))


@query("""WITH b AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, count(*) AS k, string_agg('Book ' || lang || ' x ' || n, ', ' ORDER BY lang) AS d FROM b GROUP BY source)
SELECT source, 'coverage-sources' AS decision_id, 'coverage' AS kind, 'books: ' || k AS summary, 'citations a book: ' || d AS rationale FROM s""")
def coverage_decisions(spark, sf_dir):
    cited = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("document_id"), F.concat(F.lit("Book "), F.col("lang")).alias("book_title"))
    return programme.coverage_decision(cited, by="source")


@query("""WITH e AS (SELECT s_suppkey AS topic_id, s_suppkey * 3 % 50 + 1 AS prerequisite_id FROM supplier), m AS (SELECT s_suppkey AS absorbed, s_suppkey - 1 AS keeper FROM supplier WHERE s_suppkey % 4 = 0)
SELECT DISTINCT * FROM (SELECT coalesce(a.keeper, topic_id) AS topic_id, coalesce(b.keeper, prerequisite_id) AS prerequisite_id FROM e LEFT JOIN m a ON a.absorbed = topic_id LEFT JOIN m b ON b.absorbed = prerequisite_id) WHERE topic_id <> prerequisite_id""")
def overlap_prerequisites(spark, sf_dir):
    k, rows = F.col("s_suppkey"), table(spark, sf_dir, "supplier")
    merged = rows.where("s_suppkey % 4 = 0").select(k.alias("absorbed"), (k - 1).alias("keeper"))
    return overlap.rewritten(rows.select(k.alias("topic_id"), (k * 3 % 50 + 1).alias("prerequisite_id")), merged)


@query(f"""SELECT doc_id, array_to_string(list_sort({_TERMS.format("lang || ' ' || source || ' deep sorting quoted ' || text || ' Part Two'")}), ' ') AS terms FROM documents""")
def topic_signature(spark, sf_dir):
    evidence = F.array(F.struct(F.concat(F.lit("quoted "), F.col("text")).alias("quote"), F.struct(F.lit("Part Two").alias("section")).alias("location")))
    found = overlap.signature(F.col("lang"), F.col("source"), F.array(F.lit("deep"), F.lit("sorting")), evidence)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(found), " ").alias("terms"))


# Review of learning paths: eight books a collection; proposals lead to books of the next collection now and then

PATHS = """pb AS (SELECT s_suppkey // 8 AS c, s_suppkey AS b, s_suppkey % 8 AS i, 'book ' || (s_suppkey % 8 // 3)::VARCHAR AS title, CASE WHEN s_suppkey % 4 < 2 THEN 'e1' END AS edition, 'part ' || (s_suppkey % 5)::VARCHAR AS chapter FROM supplier),
pp AS (SELECT c, i + 1 AS no, b AS p, c * 8 + (i * 3 + c) % 10 AS d, (b % 10) / 10.0 AS conf, b % 5 = 0 AS amb, b % 6 <> 0 AS backed FROM pb WHERE c % 4 <> 3),
pk AS (SELECT *, p = d OR d NOT IN (SELECT b FROM pb WHERE pb.c = pp.c) AS bad FROM pp), pe AS (SELECT DISTINCT c, p, d FROM pk WHERE NOT bad AND backed),
pr AS (SELECT c, d AS a, p AS z FROM pe UNION SELECT pr.c, pr.a, pe.p FROM pr JOIN pe ON pe.c = pr.c AND pe.d = pr.z),
ps AS (SELECT DISTINCT x.c, x.a FROM pr x JOIN pr y ON y.c = x.c AND y.a = x.z AND y.z = x.z),
pw AS (SELECT c, kind || '-' || printf('%02d', no) AS warning_id, kind, p || ',' || d AS book_ids FROM (SELECT *, unnest(list_filter([CASE WHEN bad THEN 'invalid_reference' END, CASE WHEN NOT bad AND NOT backed THEN 'missing_evidence' END, CASE WHEN NOT bad AND backed AND conf < 0.7 THEN 'low_confidence' END, CASE WHEN NOT bad AND backed AND amb THEN 'ambiguous_ordering' END], lambda x: x IS NOT NULL)) AS kind FROM pk)
UNION ALL SELECT c, 'cycle-01', 'cycle', string_agg(a::VARCHAR, ',' ORDER BY a) FROM ps GROUP BY c
UNION ALL SELECT c, 'disconnected-01', 'disconnected_books', string_agg(b::VARCHAR, ',' ORDER BY i) FROM pb WHERE c IN (SELECT c FROM pp) AND b NOT IN (SELECT p FROM pe) AND b NOT IN (SELECT d FROM pe) GROUP BY c
UNION ALL SELECT c, 'duplicate-' || printf('%02d', row_number() OVER (PARTITION BY c ORDER BY min(i))), 'duplicate_edition', string_agg(b::VARCHAR, ',' ORDER BY i) FROM pb GROUP BY c, title, edition HAVING count(*) > 1
UNION ALL SELECT x.c, 'overlap-' || printf('%02d', row_number() OVER (PARTITION BY x.c ORDER BY x.i, y.i)), 'overlap', x.b || ',' || y.b FROM pb x JOIN pb y ON y.c = x.c AND y.chapter = x.chapter AND y.i > x.i)"""


def _path(spark, sf_dir):
    """(books, proposals, chapters) of collections of eight suppliers."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k, F.floor(k / 8).alias("collection_id"), (k % 8).alias("i"))
    text = lambda start, n: F.concat(F.lit(start), n.cast("string"))
    books = rows.select("collection_id", k.alias("book_id"), (k * 10).alias("document_id"), text("Book ", F.floor(F.col("i") / 3)).alias("title"), F.when(k % 4 < 2, "e1").alias("edition"), F.col("i").alias("upload_order"))
    place = lambda d, page: F.array(F.struct(d.alias("document_id"), page.alias("page"), F.lit("Part").alias("section")))
    c, end = F.col("collection_id"), F.col("dependent")
    made = rows.where(c % 4 != 3).select("collection_id", (F.col("i") + 1).alias("proposal_no"), k.alias("prerequisite"), (c * 8 + (F.col("i") * 3 + c) % 10).alias("dependent"), k)
    # a book of another collection is unknown in this one
    inside = F.when(F.floor(end / 8) == c, end).otherwise(-end)
    made = made.withColumns({
        "shown": end, "dependent": inside, "confidence": (k % 10) / 10.0, "ambiguous": k % 5 == 0,
        "prerequisite_evidence": place(k * 10, F.lit(1)), "dependent_evidence": place(end * 10, F.when(k % 6 != 0, 2)),
    })
    proposals = paths.checked(made, books).withColumn("dependent", F.col("shown")).drop("shown", "s_suppkey")
    return books, proposals, rows.select("collection_id", k.alias("book_id"), F.concat(text(" PART ", k % 5), F.lit(" ")).alias("title"))


@query(f"WITH RECURSIVE {PATHS} SELECT c AS collection_id, warning_id, kind, book_ids FROM pw")
def learning_path_warnings(spark, sf_dir):
    found = approval.warnings(*_path(spark, sf_dir))
    return found.withColumn("book_ids", F.array_join(F.col("book_ids").cast("array<string>"), ","))


@query(f"""WITH RECURSIVE {PATHS}, g AS (SELECT c, list(warning_id) AS ids, bool_or(kind = 'cycle') AS cyc FROM pw GROUP BY c),
r AS (SELECT DISTINCT c, CASE WHEN c % 9 = 0 THEN 'v0' ELSE 'v1' END AS s, CASE WHEN c % 7 = 0 THEN 2 ELSE 1 END AS v, c % 2 = 0 AS all_ FROM pb),
x AS (SELECT r.c, CASE WHEN s <> 'v1' THEN 'schema_version' WHEN v <> 1 THEN 'plan_version' WHEN ids IS NOT NULL AND NOT all_ THEN 'unresolved_warnings' WHEN cyc THEN 'cycle_order' END AS reason FROM r LEFT JOIN g USING (c))
SELECT c AS collection_id, reason IS NULL AS approved, reason FROM x""")
def learning_path_approval(spark, sf_dir):
    books, proposals, heads = _path(spark, sf_dir)
    found, c = approval.warnings(books, proposals, heads), F.col("collection_id")
    every = found.groupBy("collection_id").agg(F.collect_set("warning_id").alias("ids"))
    asked = books.select("collection_id").distinct().join(every, "collection_id", "left").select(
        "collection_id", F.when(c % 9 == 0, "v0").otherwise("v1").alias("schema_version"), F.when(c % 7 == 0, 2).otherwise(1).alias("plan_version"),
        F.when(c % 2 == 0, F.col("ids")).alias("overrides"), F.lit(None).cast("array<bigint>").alias("chosen"),
    )
    plans = books.select("collection_id", F.lit("v1").alias("schema_version"), F.lit(1).alias("plan_version")).distinct()
    ways = approval.cycle_alternatives(books, proposals.where("accepted"))
    return approval.reviewed(asked, plans, found, ways).select("collection_id", "approved", "reason")


# Course rows


@query("""WITH c AS (SELECT user_id % 20 AS tenant_id, event_id % 7 AS week, event_id, ts, event_type = 'error' AS refused FROM events) SELECT tenant_id, week, event_id AS payload FROM c QUALIFY row_number() OVER (PARTITION BY tenant_id, week ORDER BY ts DESC, event_id DESC) = 1 AND NOT refused""")
def section_packs(spark, sf_dir):
    i = F.col("event_id")
    changes = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("tenant_id"), (i % 7).alias("week"), "ts", i.alias("payload"), (F.col("event_type") == "error").alias("refused"))
    return sections.packs(changes, keys=["tenant_id", "week"], order=["ts", "payload"]).select("tenant_id", "week", "payload")


@query("""WITH a AS (SELECT 'a' || l_orderkey || ':' || l_linenumber AS artifact_id, l_orderkey AS book_id, 's' || (l_orderkey % 5) AS student_id, l_linenumber AS week, any_value('week ' || l_linenumber) AS title, min(l_partkey) AS lecture, 's' || (min(l_partkey) % 5) AS quiz_owner FROM lineitem GROUP BY l_orderkey, l_linenumber),
w AS (SELECT o_orderkey AS book_id, 's' || (o_orderkey % 5) AS student_id, o_orderkey + 1 AS donor FROM orders WHERE o_orderkey % 3 = 0),
m AS (SELECT coalesce(t.artifact_id, 'n' || w.book_id || ':' || g.week) AS artifact_id, w.book_id, w.student_id, g.week, g.title, g.lecture, CASE WHEN t.quiz_owner = w.student_id THEN t.quiz_owner END AS quiz_owner FROM w JOIN a g ON g.book_id = w.donor LEFT JOIN a t ON t.book_id = w.book_id AND t.week = g.week)
SELECT artifact_id, book_id, student_id, week, title, lecture, artifact_id AS lecture_id, lecture AS kept_key, quiz_owner FROM m
UNION ALL SELECT artifact_id, book_id, student_id, week, title, lecture, artifact_id, lecture, quiz_owner FROM a WHERE (book_id, week) NOT IN (SELECT (book_id, week) FROM m)""")
def course_adoption(spark, sf_dir):
    k, owner = F.col("l_orderkey"), F.concat(F.lit("s"), (F.col("l_partkey") % 5).cast("string"))
    named = lambda start, *parts: F.concat(F.lit(start), F.concat_ws(":", *(p.cast("string") for p in parts)))
    own = named("a", k, F.col("l_linenumber"))
    quiz = F.to_json(F.struct(F.lit(sections.QUIZ_SCHEMA).alias("schema_version"), owner.alias("owner_student_id"), k.alias("owner_book_id"), F.lit("g1").alias("generation_id")))
    # counted from the file and dealt before rows are made wide: the join of weeks then keeps these parts
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", rows=250_000)
    one = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    rows = one.select(
        own.alias("artifact_id"), k.alias("book_id"), named("s", k % 5).alias("student_id"), F.col("l_linenumber").alias("week"), F.concat(F.lit("week "), F.col("l_linenumber").cast("string")).alias("title"), F.col("l_partkey").alias("lecture"),
        F.create_map(F.lit("lectureId"), own, F.lit("kept"), F.col("l_partkey").cast("string")).alias("script"), F.lit("{}").alias("slides"), quiz.alias("quiz"),
    )
    o = F.col("o_orderkey")
    wanted = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(o.alias("book_id"), named("s", o % 5).alias("student_id"), (o + 1).alias("donor"))
    found = sections.adopted(rows, wanted, named("n", F.col("book_id"), F.col("week")))
    return found.select("artifact_id", "book_id", "student_id", "week", "title", "lecture", F.col("script")["lectureId"].alias("lecture_id"), F.col("script")["kept"].cast("long").alias("kept_key"), F.get_json_object("quiz", "$.owner_student_id").alias("quiz_owner"))


@query("""WITH p AS (SELECT event_id, (user_id % 30)::VARCHAR AS programme_id, event_id % 3 AS v, user_id % 10 AS tenant_id, event_id % 6 AS week, ts FROM events), g AS (SELECT s_suppkey::VARCHAR AS programme_id, s_suppkey % 3 AS v FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT tenant_id, week, arg_max(event_id, (ts, event_id)) AS section_pack_id FROM p JOIN g USING (programme_id, v) GROUP BY ALL""")
def section_checkpoint(spark, sf_dir):
    i, k = F.col("event_id"), F.col("s_suppkey")
    made = table(spark, sf_dir, "events").select(i.alias("section_pack_id"), (F.col("user_id") % 30).cast("string").alias("programme_id"), (i % 3).alias("approved_plan_version"), (F.col("user_id") % 10).alias("tenant_id"), (i % 6).alias("week"), F.col("ts").alias("created_at"))
    programmes = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 3).alias("plan_version"), F.when(k % 4 != 0, "approved").otherwise("draft").alias("status"))
    return sections.approved_packs(made, programmes, keys=["tenant_id", "week"])


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 AND o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) THEN 'plan ' || o_custkey ELSE o_orderpriority END AS plan FROM orders""")
def latest_book_plan(spark, sf_dir):
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student_id"), F.col("o_orderpriority").alias("plan"))
    plans = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("student_id"), F.concat(F.lit("plan "), F.col("c_custkey").cast("string")).alias("plan"))
    return sections.latest_updated(books, plans).select("id", "plan")


@query("""SELECT o_custkey AS student_id, l_linenumber AS week, arg_max(l_partkey, (o_orderkey, l_partkey)) AS artifact_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0 GROUP BY ALL""")
def last_week_artifact(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), F.col("o_custkey").alias("student_id"))
    artifacts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("week"), F.col("l_partkey").alias("artifact_id")).join(orders, "book_id")
    return sections.last_artifacts(artifacts, orders.where("book_id % 2 = 0").select(F.col("book_id").alias("id")))


@query("""SELECT o_orderkey AS pack_id, 's' || o_custkey AS user_id, 'book-' || o_orderkey AS course_id, '2' AS plan_version, o_orderpriority AS body FROM orders""")
def section_rekeyed(spark, sf_dir):
    old = F.struct(F.lit("someone").alias("user_id"), F.lit("book-0").alias("course_id"), F.lit("1").alias("plan_version"), F.col("o_orderpriority").alias("body"))
    made = sections.rekeyed(old, user_id=F.concat(F.lit("s"), F.col("o_custkey").cast("string")), course_id=F.concat(F.lit("book-"), F.col("o_orderkey").cast("string")), plan_version=F.lit("2"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id"), made.alias("p")).select("pack_id", "p.*")


@query("""SELECT o_orderkey AS book_id, o_orderkey % 3 = 0 AND o_orderkey % 4 < 2 AND o_orderkey % 5 <> 1 AS lecture_done, o_orderkey % 2 = 0 AND o_orderkey % 7 > 1 AND o_orderkey % 3 <> 1 AS quiz_done FROM orders""")
def checkpoints_valid(spark, sf_dir):
    i = F.col("o_orderkey")
    script = F.when(i % 3 == 0, '{"segments": [{"text": "a"}]}').when(i % 3 == 1, '{"segments": []}').otherwise("not json")
    lecture = F.when(i % 4 == 0, '{"slides": []}').when(i % 4 == 1, '{"slides": [1]}').when(i % 4 == 2, '{"slides": {"a": 1}}')
    slides = F.when(i % 5 == 1, "[1]").otherwise('{"deck": []}')
    start = F.concat(F.lit('{"schema_version": "learner-assessment-bank-v1", "owner_student_id": "'), F.when(i % 2 == 0, "me").otherwise("you"), F.lit('", "owner_book_id": '), i.cast("string"))
    quiz = F.concat(start, F.when(i % 7 == 0, "").when(i % 7 == 1, ', "generation_id": " "').otherwise(', "generation_id": "g"'), F.when(i % 3 == 1, ', "questions": []}').otherwise(', "questions": [1, 2]}'))
    done = {"lecture_done": sections.lecture_checkpoint(script, lecture, slides), "quiz_done": sections.quiz_checkpoint(quiz, F.lit("me"), i)}
    return table(spark, sf_dir, "orders").select(i.alias("book_id"), *(v.alias(k) for k, v in done.items()))


@query("""SELECT l_orderkey AS book_id, l_linenumber AS week FROM lineitem WHERE l_linenumber <= l_orderkey % 5 + 1""")
def weeks_tail_removed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("week"))
    return lifecycle.tail_removed(rows, F.col("book_id") % 5 + 1)


@query("""WITH r AS (SELECT l_orderkey AS run_id, l_linenumber % 3 AS kind, l_partkey % 2 AS t FROM lineitem), s AS (SELECT run_id, list_sort(list(DISTINCT t) FILTER (kind = 0)) AS a, list_sort(list(DISTINCT t) FILTER (kind = 1)) AS b, list_sort(list(DISTINCT t) FILTER (kind = 2)) AS c FROM r GROUP BY run_id)
SELECT run_id, coalesce(a, []) = coalesce(b, []) AND coalesce(a, []) = coalesce(c, []) AS complete FROM s""")
def run_completeness(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("selected"), F.lit("lecture"), F.lit("assessment")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return lifecycle.completeness(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), kind.alias("kind"), (F.col("l_partkey") % 2).alias("topic_id")))


@query("""WITH t AS (SELECT user_id, event_id % 4 AS step, ts, event_id, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'refused' ELSE 'failed' END AS state FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, step ORDER BY ts, event_id) AS attempt FROM t)
SELECT user_id, step, arg_max(state, attempt) AS state, max(attempt)::INT AS attempts, arg_max(state, attempt) IN ('succeeded', 'refused') OR max(attempt) >= 2 AS settled FROM n GROUP BY ALL""")
def steps_settled(spark, sf_dir):
    state = F.expr("CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'refused' ELSE 'failed' END")
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4).alias("step"), "ts", "event_id", state.alias("state"))
    numbered = rows.withColumn("attempt", F.expr("row_number() OVER (PARTITION BY user_id, step ORDER BY ts, event_id)"))
    return lifecycle.settled(numbered, keys=["user_id", "step"])


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'asks without a question code' WHEN doc_id % 3 <> 0 AND doc_id % 2 = 1 THEN 'a question code without asking' END AS problem,
  NOT (doc_id % 5 = 0) AND doc_id % 4 = 1 AS resumes FROM documents""")
def triage_and_resume(spark, sf_dir):
    i = F.col("doc_id")
    problem = contracts.triage_problem(F.when(i % 3 == 0, "ask_question").otherwise("escalate"), F.when(i % 2 == 1, "Q1"))
    resumes = lifecycle.resumable(F.when(i % 5 != 0, "h"), i % 4, F.lit("h"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", problem.alias("problem"), resumes.alias("resumes"))


@query("""SELECT doc_id, regexp_replace(source || ' / ' || lang || '-' || doc_id || '_x!', '[^\\p{L}\\p{N}_-]', '', 'g') AS slug, trim(translate(regexp_replace('my_' || source || '-file.v2.pdf', '\\.[^.]*$', ''), '_-', '  ')) AS title FROM documents""")
def names_and_slugs(spark, sf_dir):
    name = F.concat(F.lit("my_"), F.col("source"), F.lit("-file.v2.pdf"))
    raw = F.concat(F.col("source"), F.lit(" / "), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("_x!"))
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(raw).alias("slug"), X.title_from_name(name).alias("title"))


@query("""SELECT doc_id, lang || '2' AS lang, CASE WHEN doc_id % 2 = 0 THEN 'old' END AS kept, source AS added FROM documents""")
def payload_merged(spark, sf_dir):
    pair = lambda *xs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    old = F.when(F.col("doc_id") % 2 == 0, pair("lang", F.col("lang"), "kept", "old", "quiz", "gone"))
    both = lifecycle.merged_payload(old, pair("lang", F.concat("lang", F.lit("2")), "added", F.col("source")), ("quiz",))
    rows = table(spark, sf_dir, "documents").select("doc_id", both.alias("m"))
    return rows.select("doc_id", *(F.col("m")[k].alias(k) for k in ("lang", "kept", "added")))
