"""Section packs and lecture rows: upserts, adoption of a finished course, lookups, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import contracts

#: Fixed value: the format of quizzes that belong to a learner.
QUIZ_SCHEMA = "learner-assessment-bank-v1"


def packs(changes: DataFrame, *, keys: list[str], order: list[str], refused: str = "refused") -> DataFrame:
    """The rows that a sequence of writes leaves: the last of each key, none where the last was a refusal."""
    others = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("last"))
    return last.where(~F.col(f"last.{refused}")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in others if c != refused))


def rekeyed(payload: Column, **fields: Column) -> Column:
    """A copied payload (a struct) that names its new owner."""
    for name, value in fields.items():
        payload = payload.withField(name, value)
    return payload


def _text(payload: Column, field: str) -> Column:
    return F.get_json_object(payload, f"$.{field}")


def _object(payload: Column) -> Column:
    return F.coalesce(F.substring(F.ltrim(payload), 1, 1) == "{", F.lit(False)) & F.json_object_keys(payload).isNotNull()


def _filled(payload: Column, field: str) -> Column:
    """Whether a field holds a list with members."""
    return _object(payload) & F.coalesce(F.json_array_length(_text(payload, field)) > 0, F.lit(False))


def quiz_owned(quiz: Column, student: Column, book: Column) -> Column:
    """Whether a quiz payload (JSON) is of the present format and belongs to the learner and the book."""
    own = (_text(quiz, "schema_version") == QUIZ_SCHEMA) & (_text(quiz, "owner_student_id") == student.cast("string")) & (_text(quiz, "owner_book_id") == book.cast("string"))
    return F.coalesce(own & (F.trim(_text(quiz, "generation_id")) != ""), F.lit(False))


def lecture_checkpoint(script: Column, lecture: Column, slides: Column) -> Column:
    """A lecture is done where its script has segments, it has a list of slides, and the deck is there (JSON texts)."""
    listed = _object(lecture) & F.json_array_length(_text(lecture, "slides")).isNotNull()
    return F.coalesce(_filled(script, "segments") & listed & _object(slides), F.lit(False))


def quiz_checkpoint(quiz: Column, student: Column, book: Column) -> Column:
    return F.coalesce(quiz_owned(quiz, student, book) & _filled(quiz, "questions"), F.lit(False))


def adopted(existing: DataFrame, wanted: DataFrame, new_id: Column) -> DataFrame:
    """The lecture rows after adoption: ``wanted`` (book_id, student_id, donor) takes over every week of its donor.

    Rows are (artifact_id, book_id, student_id, week, title, lecture, script (map), slides, quiz (JSON)). A week
    that is there keeps its artifact id, and its quiz if the adopting learner owns it; a new one gets ``new_id``, an expression
    over book_id and week, so that a repeated task makes the same id. The script names the artifact that it now belongs to.
    """
    given = existing.select(F.col("book_id").alias("donor"), "week", "title", "lecture", "script", "slides")
    rows = wanted.select("book_id", "student_id", "donor").join(given, "donor")
    # one full join instead of a lookup and an anti join: weeks that nobody adopts stay, new ones come, the others are taken over
    columns = ["student_id", "title", "lecture", "script", "slides"]
    new = rows.select("book_id", "week", F.struct(*columns).alias("__new"))
    old = existing.select("book_id", "week", F.struct("artifact_id", *columns, "quiz").alias("__old"))
    met = old.join(new, ["book_id", "week"], "full")
    taken = F.col("__new").isNotNull()
    own = F.coalesce("__old.artifact_id", new_id)
    script = F.map_concat(F.map_filter("__new.script", lambda k, _: k != "lectureId"), F.create_map(F.lit("lectureId"), own))
    quiz = F.when(quiz_owned(F.col("__old.quiz"), F.col("__new.student_id"), F.col("book_id")), F.col("__old.quiz"))
    either = lambda c, made: F.when(taken, made).otherwise(F.col(f"__old.{c}")).alias(c)
    return met.select(
        either("artifact_id", own), "book_id", either("student_id", F.col("__new.student_id")), "week", either("title", F.col("__new.title")), either("lecture", F.col("__new.lecture")),
        either("script", script), either("slides", F.col("__new.slides")), either("quiz", quiz),
    )


def approved_packs(packs: DataFrame, programmes: DataFrame, *, keys: list[str]) -> DataFrame:
    """(keys, section_pack_id): the last pack of each key that was made for the present version of an approved programme."""
    now = programmes.where("status = 'approved'").select(F.col("id").cast("string").alias("programme_id"), F.col("plan_version").alias("approved_plan_version"))
    met = packs.join(now, ["programme_id", "approved_plan_version"])
    return met.groupBy(*keys).agg(F.max_by("section_pack_id", F.struct("created_at", "section_pack_id")).alias("section_pack_id"))


def latest_updated(books: DataFrame, values: DataFrame, *, owner: str = "student_id", key: str = "id", column: str = "plan") -> DataFrame:
    """``books`` with ``column`` set from ``values`` (owner, column) at the last book of each owner; other books keep theirs."""
    last = books.groupBy(owner).agg(F.max(key).alias(key)).join(values.select(owner, F.col(column).alias("__new"), F.lit(True).alias("__set")), owner).drop(owner)
    return books.join(last, key, "left").withColumn(column, F.when(F.col("__set"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__set")


def last_artifacts(artifacts: DataFrame, books: DataFrame) -> DataFrame:
    """(student_id, week, artifact_id): for a learner who names no book, the week of the last book that has it."""
    met = artifacts.join(books.select(F.col("id").alias("book_id")), "book_id")
    return met.groupBy("student_id", "week").agg(F.max_by("artifact_id", F.struct("book_id", "artifact_id")).alias("artifact_id"))


def linked(lectures: DataFrame, artifacts: DataFrame, *, keys: tuple[str, ...] = ("book_id", "student_id", "week")) -> DataFrame:
    """Lectures with the id of their artifact, null without one; the keys identify an artifact."""
    return lectures.join(artifacts.select(*keys, F.col("artifact_id").alias("lecture_artifact_id")), list(keys), "left")


#: Why a draft has no content to publish.
NOTHING, NO_EXAMPLE, NO_TODO = "no_content", "no_worked_example", "no_actionable_todo"
BUDGET = (30, 120)


def _cited(ids: Column) -> Column:
    """Passage ids as they are compared: trimmed, in capitals, distinct."""
    return F.array_distinct(F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.upper(X.strip(x))))


def built(drafts: DataFrame, passages: DataFrame, *, key: str = "draft_id", budget: tuple[int, int] = BUDGET) -> DataFrame:
    """Section packs from drafts and the evidence that each may cite: (key, activities, examples, todos, objectives, total_minutes, passage_ids, problem, refusal).

    ``drafts`` has objectives, activities (title, description, duration_minutes, source_ids), examples (order, prompt, conclusion, source_ids,
    steps (step, explanation, source_ids)) and todos (text, time_box_minutes, source_ids); ``passages`` (key, passage_id and what a citation shows). Parts come out
    with ``citations`` in place of their ids, activities and todos numbered, examples in order. A draft with a problem or a refusal publishes nothing:
    its parts are null. The first problem counts: ids that are not among the passages, minutes outside the budget, objectives or titles that are blank or repeat.
    A draft's passages are a few, so they are met as a map and nothing is exploded.
    """
    details = [c for c in passages.columns if c not in (key, "passage_id")]
    entry = F.struct(F.upper(X.strip(F.col("passage_id"))).alias("passage_id"), F.struct("passage_id", *details).alias("citation"))
    known = passages.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("__known"))
    rows = drafts.join(known, key, "left").withColumn("__known", F.coalesce("__known", F.create_map().cast(dict(known.dtypes)["__known"])))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast(dict(drafts.dtypes)[c]))
    activities, examples, todos = listed("activities"), listed("examples"), listed("todos")

    of = lambda parts: F.flatten(F.transform(parts, lambda p: _cited(p["source_ids"])))
    steps = F.flatten(F.transform(examples, lambda e: F.concat(_cited(e["source_ids"]), of(F.coalesce(e["steps"], F.array().cast(drafts.schema["examples"].dataType.elementType["steps"].dataType))))))
    ids = F.array_distinct(F.concat(of(activities), steps, of(todos)))
    cite = lambda p: F.transform(_cited(p["source_ids"]), lambda i: F.try_element_at("__known", i)).alias("citations")
    minutes = F.aggregate(F.transform(activities, lambda a: a["duration_minutes"].cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    unique = lambda values: F.forall(values, lambda v: X.strip(v) != "") & (F.size(F.array_distinct(F.transform(values, lambda v: F.lower(X.strip(v))))) == F.size(values))
    cites = lambda parts: F.forall(parts, lambda p: F.size(_cited(p["source_ids"])) > 0)
    problem = contracts.first_problem(
        (F.forall(ids, lambda i: F.map_contains_key("__known", i)), "a cited passage is not in the evidence"), (cites(activities) & cites(examples) & cites(todos), "a part cites nothing"),
        (minutes.between(*budget), "minutes outside the budget"), (unique(listed("objectives")), "objectives repeat or are blank"), (unique(F.transform(activities, lambda a: a["title"])), "titles repeat or are blank"),
    )
    none = lambda parts: F.size(parts) == 0
    refusal = F.when(none(examples) & none(todos), NOTHING).when(none(examples), NO_EXAMPLE).when(none(todos), NO_TODO)
    made = {
        "activities": F.transform(activities, lambda a, i: F.struct((i + 1).alias("order"), a["title"].alias("title"), a["description"].alias("description"), a["duration_minutes"].alias("duration_minutes"), cite(a))),
        "examples": F.array_sort(F.transform(examples, lambda e: F.struct(
            e["order"].alias("order"), e["prompt"].alias("prompt"), F.transform(e["steps"], lambda s: F.struct(s["step"].alias("step"), s["explanation"].alias("explanation"), cite(s))).alias("steps"), e["conclusion"].alias("conclusion"), cite(e),
        ))),
        "todos": F.transform(todos, lambda t, i: F.struct((i + 1).alias("order"), t["text"].alias("text"), t["time_box_minutes"].alias("time_box_minutes"), cite(t))),
    }
    fine = rows.withColumns({"problem": problem, "refusal": F.when(problem.isNull(), refusal), "total_minutes": minutes, "passage_ids": ids})
    publish = F.col("problem").isNull() & F.col("refusal").isNull()
    return fine.select(key, *(F.when(publish, column).alias(name) for name, column in made.items()), "objectives", "total_minutes", "passage_ids", "problem", "refusal")
