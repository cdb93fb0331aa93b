"""Named queries over records of courses: deletion by derived ids, fingerprints, finished weeks, traces, section packs; see ``catalog`` for the roles of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import identity
from .operators import contracts, evaluation, lifecycle, replies, sections
from .plans import graph
from .session import table
from .sources import sinks


@query("""SELECT 'u' || (doc_id % 5)::VARCHAR AS user_id, source AS collection_id, doc_id::VARCHAR || '.md' AS source_filename, len(string_split(text, chr(10))) AS n_deleted FROM documents WHERE doc_id % 4 = 1
UNION ALL SELECT DISTINCT 'u' || ((doc_id + 1) % 5)::VARCHAR, source, doc_id::VARCHAR || '.md', 0 FROM documents WHERE doc_id % 4 = 2""")
def delete_derived(spark, sf_dir):
    """One document in four is deleted by its owner, one by somebody else, who has none of that name."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    user, name = lambda n: F.concat(F.lit("u"), ((k + n) % 5).cast("string")).alias("user_id"), F.concat(k.cast("string"), F.lit(".md"))
    points = docs.select(user(0), identity.document_id(F.col("source"), name).alias("document_id"), F.explode(F.split("text", "\n")).alias("content"))
    asked = docs.where(k % 4 == 1).select(user(0), F.col("source").alias("collection_id"), name.alias("source_filename"))
    asked = asked.unionByName(asked).unionByName(docs.where(k % 4 == 2).select(user(1), F.col("source").alias("collection_id"), name.alias("source_filename")))
    return sinks.deleted(points, asked)[1].drop("document_id")


@query("""SELECT doc_id, sha256(array_to_string(['schema:1', 'planner:2', 'lecture_writer:3', 'target_semester_weeks:8', 'max_semester_weeks:12', 'normal_semester_chapters:10', 'max_chapters_per_semester:12', 'max_chapters_per_week:2',
  'lecture_minutes_min:45', 'lecture_minutes_max:120', 'minutes_per_page:' || printf('%.4f', 2 + doc_id % 3 / 8.0), 'spoken_words_per_minute:150', 'narration_sentences_per_slide:4', 'slides_per_batch:5', 'min_lecture_questions:15', 'prompts:' || lang, 'generation_model:' || source], chr(10))) AS fingerprint FROM documents""")
def identity_course_fingerprint(spark, sf_dir):
    made = identity.course_fingerprint(
        schema="1", planner="2", lecture_writer="3", target_semester_weeks=8, max_semester_weeks=12, normal_semester_chapters=10, max_chapters_per_semester=12, max_chapters_per_week=2, lecture_minutes_min=45, lecture_minutes_max=120,
        minutes_per_page=2 + F.col("doc_id") % 3 / 8.0, spoken_words_per_minute=150, narration_sentences_per_slide=4, slides_per_batch=5, min_lecture_questions=15, prompts=F.col("lang"), generation_model=F.col("source"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("fingerprint"))


@query("""SELECT l_orderkey AS book_id, count(*) FILTER (l_partkey % 4 IN (0, 1) AND l_suppkey % 3 = 0) AS n_complete FROM lineitem GROUP BY l_orderkey""")
def complete_weeks(spark, sf_dir):
    lists = lambda *texts: F.array(*map(F.lit, texts))
    lecture = F.get(lists('{"slides": [1]}', '{"slides": [{"a": []}, 2]}', '{"slides": []}', '{"slides": "[1]"'), (F.col("l_partkey") % 4).cast("int"))
    script = F.get(lists('{"segments": ["x"]}', "{}", '{"segments": {"n": 1}}'), (F.col("l_suppkey") % 3).cast("int"))
    return lifecycle.complete_weeks(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), lecture.alias("lecture"), script.alias("script")))


@query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations), s AS (SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN role || turn::VARCHAR || ' ' || length(text)::VARCHAR ELSE role || turn::VARCHAR END, ' ' ORDER BY turn, role, text) AS servings FROM t WHERE turn % 3 <> 0 GROUP BY conv_id),
l AS (SELECT conv_id, role, arg_max(turn % 4, (turn, text)) AS state FROM t GROUP BY ALL), m AS (SELECT conv_id, string_agg(role || ':' || state::VARCHAR, ' ' ORDER BY role) AS states FROM l GROUP BY conv_id)
SELECT conv_id AS run_id, coalesce(servings, '') AS servings, states FROM m LEFT JOIN s USING (conv_id)""")
def trace_details(spark, sf_dir):
    turn = F.col("turn")
    name = F.concat("role", turn.cast("string"))
    served = F.when(turn % 3 != 0, F.when(turn % 2 == 0, F.array(name, F.length("text").cast("string"))).otherwise(F.array(name)))
    tasks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), "turn", "role", "text", F.col("role").alias("stage"), (turn % 4).cast("string").alias("state"), served.alias("servings"))
    made = lifecycle.trace_details(tasks, order=["turn", "role", "text"])
    states = F.array_join(F.transform(F.array_sort(F.map_entries("states")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")
    return made.select("run_id", F.array_join("servings", " ").alias("servings"), states.alias("states"))


@query("""WITH a AS (SELECT l_orderkey, list(DISTINCT l_partkey % 3) FILTER (l_linenumber % 2 = 0) AS x, list(DISTINCT l_partkey % 3) FILTER (l_linenumber % 2 = 1) AS y FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS run_id, len(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(y, []), v))) = 0 AS within, list_sort(coalesce(x, [])) = list_sort(coalesce(y, [])) AS equal FROM a""")
def sets_compared(spark, sf_dir):
    part = F.col("l_partkey") % 3
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, part)).alias("x"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, part)).alias("y"))
    return sets.select("run_id", lifecycle.compared(F.col("x"), F.col("y")).alias("c")).select("run_id", "c.within", "c.equal")


@query("""WITH d AS (SELECT o_custkey AS draft_id, o_custkey % 4 + 1 AS n, o_orderkey AS k, o_orderkey % 4 + 1 AS cited FROM orders),
p AS (SELECT draft_id, any_value(n) AS n, sum(k % 40) AS minutes, max(cited) AS most, count(*) AS titles, count(DISTINCT 'title ' || (k % 60)::VARCHAR) AS kinds, count(*) FILTER (k % 3 = 0) AS examples, count(*) FILTER (k % 5 = 0) AS todos,
  count(*) FILTER (k % 11 = 0) AS bare FROM d GROUP BY draft_id),
j AS (SELECT *, CASE WHEN greatest(most, 1) > n OR (examples > 0 AND n < 2) THEN 'a cited passage is not in the evidence' WHEN bare > 0 THEN 'a part cites nothing' WHEN minutes NOT BETWEEN 30 AND 120 THEN 'minutes outside the budget' WHEN kinds < titles THEN 'titles repeat or are blank' END AS problem FROM
  (SELECT p.* REPLACE (coalesce((SELECT max(cited) FROM d WHERE d.draft_id = p.draft_id AND k % 11 <> 0), 0) AS most) FROM p))
SELECT draft_id, minutes::BIGINT AS total_minutes, problem, CASE WHEN problem IS NULL THEN CASE WHEN examples = 0 AND todos = 0 THEN 'no_content' WHEN examples = 0 THEN 'no_worked_example' WHEN todos = 0 THEN 'no_actionable_todo' END END AS refusal,
  CASE WHEN problem IS NULL AND examples > 0 AND todos > 0 THEN titles + examples END::BIGINT AS n_citations FROM j""")
def section_packs_built(spark, sf_dir):
    """Orders as the parts of their customer's draft; a draft may cite as many passages as its number allows."""
    k, d = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    one = F.when(k % 11 != 0, F.array(F.concat(F.lit(" s"), (k % 4 + 1).cast("string")), F.concat(F.lit("S"), (k % 4 + 1).cast("string"), F.lit(" "))))
    activity = F.struct(F.concat(F.lit("title "), (k % 60).cast("string")).alias("title"), F.lit("what to do").alias("description"), (k % 40).alias("duration_minutes"), one.alias("source_ids"))
    step = F.struct(F.lit(1).alias("step"), F.lit("why").alias("explanation"), F.array(F.lit("s2")).alias("source_ids"))
    example = F.struct(k.alias("order"), F.lit("show").alias("prompt"), F.lit("so").alias("conclusion"), F.array(F.lit("S1")).alias("source_ids"), F.array(step).alias("steps"))
    todo = F.struct(F.lit("try").alias("text"), F.lit(5).alias("time_box_minutes"), F.array(F.lit("S1")).alias("source_ids"))
    drafts = orders.groupBy(d.alias("draft_id")).agg(F.collect_list(activity).alias("activities"), F.collect_list(F.when(k % 3 == 0, example)).alias("examples"), F.collect_list(F.when(k % 5 == 0, todo)).alias("todos")).withColumn("objectives", F.array(F.lit("know")))
    passages = orders.select(d.alias("draft_id")).distinct().select("draft_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draft_id") % 4 + 1)).alias("n")).select("draft_id", F.concat(F.lit("S"), F.col("n").cast("string")).alias("passage_id"), F.col("n").alias("page"))
    made = sections.built(drafts, passages)
    cited = lambda c: F.aggregate(F.transform(c, lambda p: F.size(p["citations"])), F.lit(0), lambda a, b: a + b)
    return made.select("draft_id", "total_minutes", "problem", "refusal", (cited("activities") + cited("examples")).cast("long").alias("n_citations"))


# Rules on material that the tables hold: the SQL evaluates the rules themselves


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH q AS (SELECT doc_id, string_split(text, chr(10))[1] AS question, string_split(text, ' ') AS w FROM documents),
c AS (SELECT doc_id, question, w[2] AS answer, list_transform(w[2:5], lambda o: lower({_STRIP.format("regexp_replace(" + _STRIP.format("o") + ", '^[A-Da-d][).:]\\s*', '')")})) AS options FROM q)
SELECT doc_id, CASE WHEN length({_STRIP.format("question")}) = 0 THEN 'question is blank' WHEN len(options) <> 4 THEN 'wrong number of options' WHEN list_contains(options, '') THEN 'an option is blank'
  WHEN len(list_distinct(options)) <> 4 THEN 'options repeat' WHEN coalesce(upper({_STRIP.format("left(answer, 1)")}), '') NOT IN ('A', 'B', 'C', 'D') THEN 'answer is no label' END AS problem FROM c""")
def quiz_of_texts(spark, sf_dir):
    """The first line asks, the second to fifth word are the options, the second begins with the answer."""
    words = F.split("text", " ")
    problem = contracts.quiz_problem(F.get(F.split("text", "\n"), F.lit(0)), F.slice(words, 2, 4), F.left(F.get(words, F.lit(1)), F.lit(1)))
    return table(spark, sf_dir, "documents").select("doc_id", problem.alias("problem"))


_REPLY = """CASE event_type WHEN 'view' THEN '{"faithfulness": ' || n || ', "answer_relevancy": ' || k || 'e-2}' WHEN 'click' THEN '{"score": ' || n || '}' WHEN 'signup' THEN '{"score": ' || n || ', "note": 1}'
  WHEN 'error' THEN '{"faithfulness": "' || n || '", "score": ' || k || 'e-2, "reasoning": "x"}' ELSE '{"faithfulness": ' || n END"""


@query(f"""WITH e AS (SELECT event_id, event_type, round(value * 100)::BIGINT::VARCHAR || 'e-4' AS n, json_extract_string(props, '$.k') AS k FROM events), r AS (SELECT event_id, {_REPLY} AS raw FROM e),
v AS (SELECT event_id, raw, json_valid(raw) AS ok FROM r), f AS (SELECT event_id, CASE WHEN ok THEN json_keys(raw) END AS keys,
  CASE WHEN ok THEN coalesce(TRY_CAST(json_extract_string(raw, '$.faithfulness') AS DOUBLE), TRY_CAST(json_extract_string(raw, '$.score') AS DOUBLE)) END AS faithful,
  CASE WHEN ok THEN coalesce(TRY_CAST(json_extract_string(raw, '$.answer_relevancy') AS DOUBLE), TRY_CAST(json_extract_string(raw, '$.score') AS DOUBLE)) END AS relevant FROM v)
SELECT event_id, CASE WHEN fine THEN faithful END AS faithfulness, CASE WHEN fine THEN relevant END AS answer_relevancy FROM
  (SELECT *, coalesce(len(list_filter(keys, lambda y: y NOT IN ('faithfulness', 'answer_relevancy', 'score', 'reasoning'))) = 0 AND faithful BETWEEN 0 AND 1 AND relevant BETWEEN 0 AND 1, false) AS fine FROM f)""")
def judge_replies(spark, sf_dir):
    """Replies of a judge made of the values of events: numbers in and out of range, one score for both, unknown fields, cut-off JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("e-4")).alias("n"), F.get_json_object("props", "$.k").alias("k"))
    card = evaluation.judge_scores(F.col("raw"))
    return rows.select("event_id", F.expr(_REPLY).alias("raw")).select("event_id", card["faithfulness"].alias("faithfulness"), card["answer_relevancy"].alias("answer_relevancy"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_returnflag AS f, l_returnflag || l_linestatus || l_linenumber % 3 AS t, l_linestatus = 'O' AS o FROM lineitem),
a AS (SELECT l_orderkey, sum(q) AS total, count(*) AS n, count(DISTINCT f) AS flags, count(DISTINCT t) AS titles, count(*) FILTER (f = 'N') AS examples, count(*) FILTER (o) AS todos FROM l GROUP BY l_orderkey),
b AS (SELECT a.*, total + (round(o_totalprice * 100)::BIGINT % 10 = 0)::INT AS budget FROM a JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey AS section_id, CASE WHEN budget NOT BETWEEN 30 AND 120 THEN 'budget outside 30 to 120 minutes' WHEN total <> budget THEN 'minutes do not make up the budget' WHEN flags < n THEN 'objectives repeat or are blank'
  WHEN titles < n THEN 'titles repeat or are blank' WHEN examples = 0 THEN 'no grounded example' WHEN todos = 0 THEN 'no grounded exercise' END AS problem FROM b""")
def section_of_orders(spark, sf_dir):
    """An order's quantities are the minutes of its parts, its flags the objectives; prices decide which budget is off by one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.col("l_quantity").cast("long")).alias("minutes"), F.collect_list("l_returnflag").alias("flags"), F.collect_list(F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string"))).alias("titles"),
        F.collect_list(F.when(F.col("l_returnflag") == "N", "x")).alias("examples"), F.collect_list(F.when(F.col("l_linestatus") == "O", "x")).alias("todos"), F.sum("l_quantity").cast("long").alias("total"),
    )
    rows = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    budget = F.col("total") + (F.round(F.col("o_totalprice") * 100).cast("long") % 10 == 0).cast("int")
    problem = contracts.section_problem(F.col("minutes"), budget, F.col("flags"), F.col("titles"), F.col("examples"), F.col("todos"))
    return rows.select(F.col("l_orderkey").alias("section_id"), problem.alias("problem"))


@query(f"""WITH q AS (SELECT doc_id, left(text, 1200) AS prompt, string_split(text, ' ') AS w FROM documents), o AS (SELECT doc_id, prompt, w[2:5] AS options, upper(left(w[2], 1)) AS correct FROM q),
c AS (SELECT *, list_transform(options, lambda o: lower({_STRIP.format("regexp_replace(o, '^[A-Da-d][).: ]+\\s*', '')")})) AS clean FROM o)
SELECT doc_id, CASE WHEN length({_STRIP.format("prompt")}) = 0 OR length(prompt) > 1000 THEN 'question 1: no prompt' WHEN len(options) <> 4 THEN 'question 1: not four options' WHEN len(list_filter(options, lambda o: length({_STRIP.format("o")}) = 0)) > 0 THEN 'question 1: an empty option'
  WHEN len(list_filter(options, lambda o: length(o) > 500)) > 0 THEN 'question 1: a long option' WHEN len(list_distinct(clean)) < 4 THEN 'question 1: options repeat' WHEN coalesce(correct, '') NOT IN ('A', 'B', 'C', 'D') THEN 'question 1: no label of an answer' END AS problem FROM c""")
def quiz_replies(spark, sf_dir):
    """A reply of one question a document, made of its words, as JSON."""
    words = F.split("text", " ")
    asked = F.struct(F.left("text", F.lit(1200)).alias("prompt"), F.slice(words, 2, 4).alias("options"), F.upper(F.left(F.get(words, F.lit(1)), F.lit(1))).alias("correct"))
    raw = F.to_json(F.struct(F.array(asked).alias("questions")))
    return table(spark, sf_dir, "documents").select("doc_id", replies.quiz_problem(raw, 1).alias("problem"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::INT AS q, l_returnflag AS f, l_partkey AS k FROM lineitem), s AS (SELECT l_orderkey, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, k, q, f) AS i,
  CASE WHEN q < 3 THEN 'no slide' WHEN f = 'R' AND k % 2 = 0 THEN 'no text' WHEN f = 'A' AND q > 45 THEN 'no citation' WHEN k % 50 < 1 THEN 'a citation without a page' END AS p FROM l)
SELECT l_orderkey AS script_id, arg_min('segment ' || i || ': ' || p, i) FILTER (p IS NOT NULL) AS problem FROM s GROUP BY l_orderkey""")
def script_files(spark, sf_dir):
    """Orders as published scripts, their lines as segments: quantities, flags and parts decide what is missing."""
    q, f, k = F.col("l_quantity").cast("int"), F.col("l_returnflag"), F.col("l_partkey")
    cited = F.when((f == "A") & (q > 45), F.array().cast("array<struct<page:bigint>>")).otherwise(F.array(F.struct(F.lit(5).cast("long").alias("page")), F.struct((k % 50).cast("long").alias("page"))))
    segment = F.struct(F.col("l_linenumber").alias("n"), "l_partkey", q.alias("q"), "l_returnflag", F.struct((q - 2).alias("slide"), F.when((f == "R") & (k % 2 == 0), " ").otherwise("said").alias("text"), cited.alias("citations")).alias("own"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(segment)), lambda x: x["own"]).alias("segments"))
    raw = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("lectureId"), F.lit("t").alias("title"), "segments"))
    return rows.select(F.col("l_orderkey").alias("script_id"), replies.script_problem(raw).alias("problem"))


# Evidence of the edges of a cycle


@query("""WITH RECURSIVE s AS (SELECT s_suppkey, s_nationkey AS grp, s_suppkey % 10 AS child, (s_suppkey * 7) % 10 AS parent FROM supplier),
e AS (SELECT DISTINCT grp, child, parent FROM s WHERE child <> parent), r AS (SELECT grp, child AS a, parent AS b FROM e UNION SELECT r.grp, r.a, e.parent FROM r JOIN e ON e.grp = r.grp AND e.child = r.b)
SELECT s_suppkey, grp, child, parent FROM s WHERE EXISTS (SELECT 1 FROM r WHERE r.grp = s.grp AND r.a = child AND r.b = parent) AND EXISTS (SELECT 1 FROM r WHERE r.grp = s.grp AND r.a = parent AND r.b = child)""")
def evidence_within_cycles(spark, sf_dir):
    k = F.col("s_suppkey")
    node = lambda x: F.struct("s_nationkey", x.alias("node"))
    evidence = table(spark, sf_dir, "supplier").select(k, node(k % 10).alias("child"), node((k * 7) % 10).alias("parent"))
    listed = graph.cycles(evidence.where("child <> parent").select("child", "parent"))
    return graph.within(evidence, listed).select("s_suppkey", F.col("child.s_nationkey").alias("grp"), F.col("child.node").alias("child"), F.col("parent.node").alias("parent"))
