"""Ingestion, path review and course rows on small tables; greedy queries against their definitions."""

import json
import os

import pytest

from gradus import catalog
from gradus.operators import hybrid, sections
from gradus.plans import approval, paths, programme
from gradus.sources import ingest


def test_attempts_of_work():
    calls = []

    def work(errors):
        calls.append(1)
        if errors:
            raise errors.pop(0)
        return "done"

    assert ingest.tried(work, []) == {"value": "done", "attempts": 1, "error": None, "retryable": False}
    assert ingest.tried(work, [TimeoutError("slow"), OSError("net")])["attempts"] == 3
    assert ingest.tried(work, [OSError("x")] * 5) == {"value": None, "attempts": 3, "error": "OSError: x", "retryable": True}
    del calls[:]
    assert ingest.tried(work, [ValueError("bad")]) == {"value": None, "attempts": 1, "error": "ValueError: bad", "retryable": False} and len(calls) == 1
    with pytest.raises(KeyboardInterrupt):
        ingest.tried(work, [KeyboardInterrupt()])
    with pytest.raises(ValueError):
        ingest.tried(work, [], most=0)


def test_names_of_permanent_errors():
    assert tuple(e.__name__ for e in ingest.PERMANENT) == ingest.PERMANENT_NAMES


def test_attempts_of_short_logs(spark):
    rows = spark.createDataFrame([(1, ["OSError"]), (2, []), (3, None), (4, ["OSError", None])], "i int, o array<string>")
    got = {r.i: r.x for r in rows.select("i", ingest.attempts(rows.o).alias("x")).collect()}
    assert got[1] is None and got[2] is None and got[3] is None
    assert tuple(got[4]) == (2, True, None, False)


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "points")
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert ingest.index_run([batch(1), batch(2)], path, "run-1") == 2

    def failing():
        yield batch(3)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ingest.index_run(failing(), path, "run-2")
    assert sorted((r.id, r.indexing_run_id) for r in spark.read.parquet(path).collect()) == [(1, "run-1"), (2, "run-1")]
    with pytest.raises(ValueError):
        ingest.index_run([batch(1)], path, "../other")


def test_json_is_replaced_and_appended(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    for ids in ((1, 2), (3,)):
        ingest.replace_json(rows(*ids), path)
        assert sorted(r.id for r in ingest.read_json(spark, path).collect()) == list(ids)
    assert sorted(os.listdir(tmp_path)) == ["state"]
    for ids in ((1,), (2,)):
        ingest.append_events(rows(*ids), str(tmp_path / "log"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "log")).collect()) == [1, 2]


@pytest.fixture(scope="module")
def cyclic(spark):
    """Collection 1 has the cycle a -> b -> c -> a and a fourth book below it; collection 2 has none."""
    books = spark.createDataFrame([(1, b, b, None, i) for i, b in enumerate("abcd")] + [(2, b, b, None, i) for i, b in enumerate("xy")], "collection_id int, book_id string, title string, edition string, upload_order int")
    edges = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "b", "c"), (1, 3, "c", "a"), (1, 4, "c", "d"), (2, 1, "y", "x")], "collection_id int, proposal_no int, prerequisite string, dependent string")
    return books, edges


def test_ways_out_of_a_cycle(cyclic):
    got = approval.cycle_alternatives(*cyclic).orderBy("alternative_no").collect()
    assert [(r.collection_id, "".join(r.book_ids)) for r in got] == [(1, "bcad"), (1, "cadb"), (1, "abcd")]


def test_approval_of_a_cycle(spark, cyclic):
    books, edges = cyclic
    ways = approval.cycle_alternatives(books, edges)
    found = spark.createDataFrame([(1, "cycle-01", "cycle"), (1, "overlap-01", "overlap")], "collection_id int, warning_id string, kind string")
    plans = books.selectExpr("collection_id", "'v1' AS schema_version", "3 AS plan_version").distinct()
    both = ["cycle-01", "overlap-01"]
    cases = [
        ("v1", 3, both, list("cadb"), None), ("v0", 3, both, list("cadb"), "schema_version"), (None, 3, both, list("cadb"), "schema_version"), ("v1", 2, both, list("cadb"), "plan_version"),
        ("v1", 3, both[:1], list("cadb"), "unresolved_warnings"), ("v1", 3, None, None, "unresolved_warnings"), ("v1", 3, both, list("dabc"), "cycle_order"), ("v1", 3, both, None, "cycle_order"),
    ]
    asked = spark.createDataFrame([(1, i, *c[:4]) for i, c in enumerate(cases)], "collection_id int, i int, schema_version string, plan_version int, overrides array<string>, chosen array<string>")
    got = approval.reviewed(asked, plans, found, ways)
    assert {r.i: (r.approved, r.reason) for r in got.collect()} == {i: (c[4] is None, c[4]) for i, c in enumerate(cases)}

    path = paths.ordered(books, edges).selectExpr("collection_id", "book_id", "position", "2L AS week_count")
    new = approval.renumbered(path, got)
    assert [(r.book_id, r.starts_at, r.ends_at) for r in new.where("collection_id = 1").orderBy("position").collect()] == [("c", 1, 2), ("a", 3, 4), ("d", 5, 6), ("b", 7, 8)]
    assert [r.book_id for r in new.where("collection_id = 2").orderBy("position").collect()] == ["y", "x"]
    kept = approval.kept_edges(edges, new)
    assert sorted((r.prerequisite, r.dependent) for r in kept.collect()) == [("a", "b"), ("c", "a"), ("c", "d"), ("y", "x")]


def test_overlap_decisions(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 0.62, "merge"), (1, "a", "c", 0.9, "merge"), (2, "x", "y", 0.3, "keep_both")], "p int, a string, b string, similarity double, decision string")
    got = programme.overlap_decisions(pairs, by="p").orderBy("p", "decision_id").collect()
    assert [(r.p, r.decision_id, r.summary) for r in got] == [
        (1, "overlap-01", "merge: a / c (90% shared terms)"), (1, "overlap-02", "merge: a / b (62% shared terms)"), (2, "overlap-01", "keep both: x / y (30% shared terms)"),
    ]


def test_adopted_quizzes(spark):
    quiz = lambda owner, book, run="g": json.dumps({"schema_version": sections.QUIZ_SCHEMA, "owner_student_id": owner, "owner_book_id": book, "generation_id": run})
    rows = [("d1", 9, "t", 1, "W1", "l1", {"lectureId": "d1", "x": "1"}, "{}", quiz("t", 9)), ("d2", 9, "t", 2, "W2", "l2", {}, "{}", None)]
    rows += [("o1", 1, "s", 1, "old", "lo", {}, "{}", quiz("s", 1)), ("o3", 1, "s", 3, "old", "lo", {}, "{}", None), ("p1", 2, "s", 1, "old", "lo", {}, "{}", quiz("s", 2, " "))]
    existing = spark.createDataFrame(rows, "artifact_id string, book_id int, student_id string, week int, title string, lecture string, script map<string,string>, slides string, quiz string")
    wanted = spark.createDataFrame([(1, "s", 9), (2, "s", 9), (3, "s", 77)], "book_id int, student_id string, donor int")
    from pyspark.sql import functions as F

    got = {(r.book_id, r.week): r for r in sections.adopted(existing, wanted, F.concat_ws(":", F.lit("n"), "book_id", "week")).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (9, 1), (9, 2)]
    assert (got[1, 1].artifact_id, got[1, 1].title, got[1, 1].script) == ("o1", "W1", {"lectureId": "o1", "x": "1"}) and got[1, 1].quiz == quiz("s", 1)
    assert got[1, 2].artifact_id == "n:1:2" and got[1, 3].title == "old" and got[2, 1].quiz is None and got[9, 1].quiz == quiz("t", 9)


def test_adoption_meets_the_rows_there_once(spark):
    from pyspark.sql import functions as F

    rows = [("d", 9, "t", 1, "W", "l", {}, "{}", None), ("n", 9, "t", None, "W", "l", {}, "{}", None), ("x", None, "t", 1, "W", "l", {}, "{}", None), ("o", 1, "s", 1, "old", "lo", {}, "{}", None), ("p", 1, "s", 1, "old", "lo", {}, "{}", None)]
    existing = spark.createDataFrame(rows, "artifact_id string, book_id int, student_id string, week int, title string, lecture string, script map<string,string>, slides string, quiz string")
    wanted = spark.createDataFrame([(1, "s", 9)], "book_id int, student_id string, donor int")
    found = sections.adopted(existing, wanted, F.concat_ws(":", F.lit("n"), "book_id", "week"))
    got = sorted(((r.artifact_id, r.book_id, r.week, r.title) for r in found.collect()), key=str)
    assert got == sorted([("d", 9, 1, "W"), ("n", 9, None, "W"), ("x", None, 1, "W"), ("o", 1, 1, "W"), ("p", 1, 1, "W"), ("n:1", 1, None, "W")], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 1 and "LeftAnti" not in plan and plan.count("Join") == 2


def test_linked_and_ordered(spark):
    lectures = spark.createDataFrame([(1, "s", 1), (1, "s", 2)], "book_id int, student_id string, week int")
    artifacts = spark.createDataFrame([("a", 1, "s", 1)], "artifact_id string, book_id int, student_id string, week int")
    assert sorted((r.week, r.lecture_artifact_id) for r in sections.linked(lectures, artifacts).collect()) == [(1, "a"), (2, None)]
    chunks = spark.createDataFrame([("d", None, "x"), ("d", 2, "y"), ("d", 0, "z")], "doc string, chunk_index int, content string")
    assert [r.content for r in hybrid.in_order(chunks, by="doc", ties=["content"]).orderBy("place").collect()] == ["z", "y", "x"]


def test_broken_cycles_by_definition(spark, sf):
    """A depth-first walk over sorted nodes, written as a recursion."""
    rows = catalog.QUERIES["dag_break_cycles"](spark, sf).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.s_nationkey, set()).add((r.child, r.parent))
    want = set()
    for group, edges in groups.items():
        done: set = set()

        def walk(node, path, group=group, edges=edges, done=done):
            for parent in sorted(p for c, p in edges if c == node):
                if parent in path:
                    want.add((group, node, parent))
                elif parent not in done:
                    walk(parent, path | {parent})
            done.add(node)

        for node in sorted({c for c, _ in edges}):
            if node not in done:
                walk(node, {node})
    assert {(r.s_nationkey, r.child, r.parent) for r in rows if r.dropped} == want


def test_keepers_by_definition(spark, sf):
    """Pairs by falling similarity; every topic of the second's group goes to the keeper of the first's."""
    language = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    pairs = [r for r in catalog.QUERIES["overlap_classify"](spark, sf).collect() if r.decision == "merge"]
    label: dict = {}
    for r in sorted(pairs, key=lambda r: (-r.similarity, r.a, r.b)):
        group = language[r.a]
        a, b = label.setdefault((group, r.a), r.a), label.setdefault((group, r.b), r.b)
        if a != b:
            label.update({k: a for k, v in label.items() if k[0] == group and v == b})
    got = {(r.lang, r.absorbed): r.keeper for r in catalog.QUERIES["overlap_merge_keepers"](spark, sf).collect()}
    assert got == {k: v for k, v in label.items() if k[1] != v}


def test_keepers_ask_for_merging_pairs_alone(spark, sf, monkeypatch):
    asked = []
    similar = catalog.overlap.similar
    monkeypatch.setattr(catalog.overlap, "similar", lambda *a, **chosen: asked.append(chosen) or similar(*a, **chosen))
    rows = catalog.QUERIES["overlap_merge_keepers"](spark, sf)
    assert asked == [{"least": catalog.overlap.MERGE, "shown": 0}] and rows.columns == ["lang", "absorbed", "keeper"]


def test_overlap_decisions_are_numbered_by_similarity(spark):
    """Ids count on over pairs of one similarity, in no window over a programme's pairs; the reason comes from the same row."""
    from pyspark.sql import functions as F

    rows = [(p, a, b, (a * b % 4) / 10 + 0.3, "sequence") for p in "pq" for a in range(12) for b in range(a + 1, 12)]
    found = programme.overlap_decisions(spark.createDataFrame(rows, "p string, a int, b int, similarity double, decision string"), by="p", rationale=F.concat_ws("-", "a", "b"))
    number = lambda r: int(r.decision_id.removeprefix("overlap-"))
    for p in "pq":
        want = [f"{a}-{b}" for _, _, a, b in sorted((-s, 0, a, b) for q, a, b, s, _ in rows if q == p)]
        assert [r.rationale for r in sorted((r for r in found.collect() if r.p == p), key=number)] == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(p#" in plan and all(", similarity#" in x[:60] for x in plan.split("row_number() windowspecdefinition(p#")[1:])
