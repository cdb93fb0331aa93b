"""Contracts of replies and published files, rule by rule."""

import json

from pyspark.sql import functions as F

from gradus.operators import replies


def said(spark, check, *values):
    rows = spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "i int, raw string")
    return [r.p for r in rows.select("i", check(F.col("raw")).alias("p")).orderBy("i").collect()]


def slide(**change):
    made = {"heading": "Sorting", "layout": "cards", "bullets": ["one", "two"], "narration": "word " * 15, "page": 3} | change
    return {k: v for k, v in made.items() if v != "gone"}


def lecture(*slides, **change):
    made = {"title": "T", "intro": "Hello", "slides": list(slides)} | change
    return {k: v for k, v in made.items() if v != "gone"}


def test_lectures(spark):
    one = slide()
    cases = [
        (lecture(one), None), ("{broken", "no object"), (None, "no object"), ([1], "no object"), (lecture(one, extra=1), "unknown fields"), (lecture(one, title=" "), "no title"), (lecture(one, title=5), "no title"), (lecture(one, title="x" * 201), "no title"),
        (lecture(one, intro=5), "no or too long introduction"), (lecture(one, intro="x" * 2001), "no or too long introduction"), (lecture(one, intro="gone"), "no introduction"), (lecture(one, intro=" "), "no introduction"),
        (lecture(), "fewer than 1 slides"), (lecture(slides="text"), "fewer than 1 slides"), (lecture(one, one, one, one), "more than 3 slides"), (lecture(one, 7), "slide 2: no object"), (lecture(one, slide(more=1)), "slide 2: unknown fields"),
        (lecture(slide(heading="")), "slide 1: no heading"), (lecture(slide(heading=4)), "slide 1: no heading"), (lecture(slide(bullets=[])), "slide 1: no bullet"), (lecture(slide(bullets=[" ", 5])), "slide 1: no bullet"), (lecture(slide(bullets="x")), "slide 1: no bullet"),
        (lecture(slide(bullets=["a"] * 9)), "slide 1: too many or too long bullets"), (lecture(slide(bullets=["a", 5])), "slide 1: too many or too long bullets"), (lecture(slide(bullets=["a" * 501])), "slide 1: too many or too long bullets"), (lecture(slide(bullets=["A ", "a"])), "slide 1: bullets repeat"),
        (lecture(slide(narration="word " * 14)), "slide 1: a short narration"), (lecture(slide(narration="gone")), "slide 1: a short narration"), (lecture(slide(narration="w " * 751)), "slide 1: a long narration"), (lecture(slide(narration="w" * 5000 + " a" * 20)), "slide 1: a long narration"),
        (lecture(slide(page="3")), "slide 1: no page"), (lecture(slide(page=True)), "slide 1: no page"), (lecture(slide(page=1.5)), "slide 1: no page"), (lecture(one, slide(page="gone"), slide(heading="")), "slide 2: no page"),
    ]
    assert said(spark, lambda c: replies.lecture_problem(c, 3), *(c for c, _ in cases)) == [p for _, p in cases]
    assert said(spark, lambda c: replies.lecture_problem(c, 3, intro=False), lecture(one, intro="gone"), lecture(one)) == [None, None]
    assert said(spark, lambda c: replies.lecture_problem(c, 6), lecture(one, one, one)) == ["fewer than 4 slides"]


def question(**change):
    made = {"prompt": "Why?", "options": ["A) x", "B) y", "z", "w"], "correct": "B"} | change
    return {k: v for k, v in made.items() if v != "gone"}


def test_quizzes(spark):
    q = question()
    cases = [
        ({"questions": [q]}, None), ({"questions": [q], "more": 1}, "unknown fields"), ({"questions": []}, "fewer than 1 questions"), ({}, "fewer than 1 questions"), ({"questions": [q] * 3}, "more than 2 questions"), ({"questions": [q, "x"]}, "question 2: no object"),
        ({"questions": [question(hint="x")]}, "question 1: unknown fields"), ({"questions": [question(prompt=" ")]}, "question 1: no prompt"), ({"questions": [question(prompt="x" * 1001)]}, "question 1: no prompt"), ({"questions": [question(options=["a", "b", "c"])]}, "question 1: not four options"),
        ({"questions": [question(options=["a", "b", "c", " "])]}, "question 1: an empty option"), ({"questions": [question(options=["a", "b", "c", 4])]}, "question 1: an empty option"), ({"questions": [question(options=["a", "b", "c", "x" * 501])]}, "question 1: a long option"),
        ({"questions": [question(options=["A) same", "B: Same", "c", "d"])]}, "question 1: options repeat"), ({"questions": [question(correct="E")]}, "question 1: no label of an answer"), ({"questions": [q, question(correct="gone")]}, "question 2: no label of an answer"), ("null", "no object"),
    ]
    assert said(spark, lambda c: replies.quiz_problem(c, 1, 2), *(c for c, _ in cases)) == [p for _, p in cases]
    assert said(spark, lambda c: replies.quiz_problem(c, 1), {"questions": [q] * 30}) == [None]


def script(**change):
    return {"lectureId": "l", "title": "t", "segments": [{"slide": 1, "text": "x", "citations": [{"page": 2}]}]} | change


def week_quiz(week, **change):
    return {"week": week, "questions": [{"type": "mcq", "options": list("abcd"), "correct_option": "A", "source": "lecture"} | change]}


def test_published_files(spark):
    segment = script()["segments"][0]
    cases = [
        (script(), None), (script(lectureId=""), "no lecture"), (script(title=3), "no title"), (script(segments=[]), "no segments"), (script(segments=[segment, segment | {"slide": 0}]), "segment 2: no slide"), (script(segments=[segment | {"slide": "1"}]), "segment 1: no slide"),
        (script(segments=[segment | {"text": " "}]), "segment 1: no text"), (script(segments=[segment | {"citations": []}]), "segment 1: no citation"), (script(segments=[segment | {"citations": [{"page": 1}, {"page": 0}]}]), "segment 1: a citation without a page"), (script(segments=[segment | {"citations": [{}]}]), "segment 1: a citation without a page"), ("[]", "no lecture"),
    ]
    assert said(spark, replies.script_problem, *(c for c, _ in cases)) == [p for _, p in cases]
    cases = [
        (week_quiz(2), None), (week_quiz(0), "no week"), (week_quiz("2"), "no week"), (week_quiz(3), "another week"), ({"week": 2, "questions": []}, "no questions"), (week_quiz(2, type="open"), "question 1: another type"), (week_quiz(2, options=["a"]), "question 1: not four options"),
        (week_quiz(2, correct_option="AB"), "question 1: no label of an answer"), (week_quiz(2, source="web"), "question 1: another source"),
    ]
    assert said(spark, lambda c: replies.week_quiz_problem(c, F.lit(2)), *(c for c, _ in cases)) == [p for _, p in cases]


def test_courses(spark):
    fine = lambda c, w, **change: (c, w, json.dumps(change.get("script", script())), json.dumps(change.get("quiz", week_quiz(w))), change.get("slides", "# x"))
    rows = [
        fine("good", 1), fine("good", 2), fine("gap", 1), fine("gap", 3), fine("late", 2), fine("twice", 1), fine("twice", 1), fine("script", 1), fine("script", 2, script=script(title="")), fine("script", 3, quiz=week_quiz(9)),
        fine("quiz", 1, quiz=week_quiz(2)), fine("slides", 1, slides=None), ("null", None, json.dumps(script()), json.dumps(week_quiz(1)), "x"),
    ]
    made = replies.course_problems(spark.createDataFrame(rows, "course_id string, week int, script string, quiz string, slides string"))
    assert {r.course_id: r.problem for r in made.collect()} == {
        "good": None, "gap": "weeks are not 1, 2, ...", "late": "weeks are not 1, 2, ...", "twice": "weeks are not 1, 2, ...", "script": "week 2: script: no title", "quiz": "week 1: quiz: another week", "slides": "week 1: no slides", "null": "weeks are not 1, 2, ...",
    }


def test_fields_of_another_kind_and_one_parse(spark):
    good = '{"slide": 1, "text": "said", "citations": [{"page": 2}]}'
    odd = {
        "[1]": "segment 1: no slide", "[null]": "segment 1: no slide", f"[{good}, []]": "segment 2: no slide", "{}": "no segments", '"x"': "no segments", "[]": "no segments",
        '[{"slide": "1", "text": "said", "citations": [{"page": 2}]}]': "segment 1: no slide", '[{"slide": 1, "text": 5, "citations": [{"page": 2}]}]': "segment 1: no text",
        '[{"slide": 1, "text": "said", "citations": {"page": 2}}]': "segment 1: no citation", '[{"slide": 1, "text": "said", "citations": [{"page": 2}, 7]}]': "segment 1: a citation without a page",
        '[{"slide": 1, "text": "said", "citations": [{"page": "2"}]}]': "segment 1: a citation without a page", f"[{good}, {good}]": None,
    }
    rows = spark.createDataFrame([(f'{{"lectureId": "a", "title": "t", "segments": {x}}}', y) for x, y in odd.items()], "raw string, want string")
    found = rows.select("want", replies.script_problem(F.col("raw")).alias("got"))
    assert all(r.got == r.want for r in found.collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
