"""Contracts of what models reply and of what is published: JSON texts checked inside the JVM, the first broken rule named with its place.

Every check takes a column of JSON texts and returns null, or what is wrong. Types count: a number is no text and a text no number. Fields beyond the allowed ones
are wrong, as they may carry what nobody looks at. Lengths are code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: The fields of replies.
LECTURE, SLIDE, QUIZ, QUESTION = ("title", "intro", "slides"), ("heading", "layout", "bullets", "callout", "emphasis", "visual", "narration", "page"), ("questions",), ("prompt", "options", "correct")
LABELS, SOURCES = ("A", "B", "C", "D"), ("lecture", "self_study")
#: The most characters of titles and headings, introductions, bullets, narrations, prompts and options; words of a narration; bullets of a slide.
TITLE, INTRO, BULLET, NARRATION, PROMPT, OPTION, SPOKEN, BULLETS = 200, 2_000, 500, 5_000, 1_000, 500, (15, 750), 8
_EVERY = "$"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _at(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "variant")


def _kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, ARRAY<...>, OBJECT<...>, ...; null where there is nothing."""
    return F.schema_of_variant(v)


def _string(v: Column) -> Column:
    """The text of a string, null for anything else."""
    return _let(v, lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, _EVERY, "string")))


def _whole(v: Column) -> Column:
    """The value of a whole number, null for anything else."""
    return _let(v, lambda x: F.when(_kind(x) == "BIGINT", F.try_variant_get(x, _EVERY, "bigint")))


def _list(v: Column) -> Column:
    """The members of an array, null for anything else; nothing else can be read as one, so no schema of all members is made."""
    return F.try_variant_get(v, _EVERY, "array<variant>")


def _object(v: Column) -> Column:
    return F.coalesce(F.startswith(_kind(v), F.lit("OBJECT")), F.lit(False))


def _only(v: Column, fields: tuple[str, ...]) -> Column:
    """Whether an object has no other fields."""
    return F.size(F.array_except(F.map_keys(F.try_variant_get(v, _EVERY, "map<string,variant>")), F.array(*map(F.lit, fields)))) == 0


def _said(text: Column, most: int | None = None) -> Column:
    """Whether a text is there, not blank, and short enough."""
    fine = F.length(X.strip(text)) > 0
    return F.coalesce(fine if most is None else fine & (F.length(text) <= most), F.lit(False))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(X.strip(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def _first(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(message)) for rule, message in rules))


def _each(values: Column, name: str, problem: Callable[[Column], Column]) -> Column:
    """The first problem among the members of a list, with the place of the member."""
    found = F.transform(values, lambda v, i: F.concat(F.lit(f"{name} "), (i + 1).cast("string"), F.lit(": "), problem(v)))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _unique(texts: Column) -> Column:
    low = F.transform(texts, lambda t: F.lower(X.strip(t)))
    return F.size(F.array_distinct(low)) == F.size(low)


def _slide(v: Column) -> Column:
    bullets, narration = _list(_at(v, "bullets")), _string(_at(v, "narration"))
    said = F.transform(bullets, _string)
    return F.when(~_object(v), F.lit("no object")).otherwise(F.coalesce(
        _first((_only(v, SLIDE), "unknown fields"), (_said(_string(_at(v, "heading")), TITLE), "no heading"), (F.exists(said, lambda b: _said(b)), "no bullet")),
        _first(((F.size(said) <= BULLETS) & F.forall(said, lambda b: F.length(b) <= BULLET), "too many or too long bullets"), (_unique(said), "bullets repeat")),
        _first((_words(narration) >= SPOKEN[0], "a short narration"), ((F.length(narration) <= NARRATION) & (_words(narration) <= SPOKEN[1]), "a long narration"), (_whole(_at(v, "page")).isNotNull(), "no page")),
    ))


def lecture_problem(raw: Column, slides: int, *, intro: bool = True) -> Column:
    """A lecture of ``slides`` slides, two fewer at least, with a title; an introduction where it opens the lecture."""
    v = F.try_parse_json(raw)
    listed, opening = _list(_at(v, "slides")), _at(v, "intro")
    said = _string(opening)
    fewest = max(1, slides - 2)
    return F.when(~_object(v), F.lit("no object")).otherwise(F.coalesce(
        _first((_only(v, LECTURE), "unknown fields"), (_said(_string(_at(v, "title")), TITLE), "no title"), (opening.isNull() | (F.length(said) <= INTRO), "no or too long introduction")),
        _first((F.size(listed) >= fewest, f"fewer than {fewest} slides"), (F.size(listed) <= slides, f"more than {slides} slides")),
        _each(listed, "slide", _slide), _first((_said(said), "no introduction")) if intro else F.lit(None).cast("string"),
    ))


def _question(v: Column) -> Column:
    options = _list(_at(v, "options"))
    said = F.transform(options, _string)
    clean = F.transform(said, lambda o: F.regexp_replace(o, r"^[A-Da-d][).: ]+\s*", ""))
    return F.when(~_object(v), F.lit("no object")).otherwise(F.coalesce(
        _first((_only(v, QUESTION), "unknown fields"), (_said(_string(_at(v, "prompt")), PROMPT), "no prompt"), (F.size(options) == len(LABELS), "not four options")),
        _first((F.forall(said, lambda o: _said(o)), "an empty option"), (F.forall(said, lambda o: F.length(o) <= OPTION), "a long option"), (_unique(clean), "options repeat"), (_string(_at(v, "correct")).isin(*LABELS), "no label of an answer")),
    ))


def quiz_problem(raw: Column, fewest: int, most: int | None = None) -> Column:
    v = F.try_parse_json(raw)
    listed = _list(_at(v, "questions"))
    size = _first((F.size(listed) >= fewest, f"fewer than {fewest} questions"), *([(F.size(listed) <= most, f"more than {most} questions")] if most is not None else []))
    return F.when(~_object(v), F.lit("no object")).otherwise(F.coalesce(_first((_only(v, QUIZ), "unknown fields")), size, _each(listed, "question", _question)))


#: The fields of segments that count; what is of another kind reads as null.
SEGMENTS = "array<struct<slide:variant,text:variant,citations:array<struct<page:variant>>>>"


def _segment(own: Column) -> Column:
    cited = own["citations"]
    return _first(
        (_whole(own["slide"]) >= 1, "no slide"), (_said(_string(own["text"])), "no text"), (F.size(cited) > 0, "no citation"), (F.forall(cited, lambda c: F.coalesce(_whole(c["page"]) > 0, F.lit(False))), "a citation without a page"),
    )


def script_problem(raw: Column) -> Column:
    """A published script: its lecture, a title, and segments that each name a slide, say something and cite pages."""

    def problem(v: Column) -> Column:
        named = lambda f: F.coalesce(F.length(_string(_at(v, f))) > 0, F.lit(False))
        listed = _let(F.try_variant_get(v, "$.segments", SEGMENTS), lambda x: F.coalesce(_first((F.size(x) > 0, "no segments")), _each(x, "segment", _segment)))
        return F.coalesce(_first((named("lectureId"), "no lecture"), (named("title"), "no title")), listed)

    return _let(F.try_parse_json(raw), problem)


def _published(v: Column) -> Column:
    return _first(
        (_string(_at(v, "type")) == "mcq", "another type"), (F.size(_list(_at(v, "options"))) == len(LABELS), "not four options"), (_string(_at(v, "correct_option")).isin(*LABELS), "no label of an answer"), (_string(_at(v, "source")).isin(*SOURCES), "another source"),
    )


def week_quiz_problem(raw: Column, week: Column | None = None) -> Column:
    """A published quiz of a week, of the given one where it is given."""

    def problem(v: Column) -> Column:
        own = lambda x: _first((x >= 1, "no week"), *([(x == week, "another week")] if week is not None else []))
        listed = lambda x: F.coalesce(_first((F.size(x) > 0, "no questions")), _each(x, "question", _published))
        return F.coalesce(_let(_whole(_at(v, "week")), own), _let(_list(_at(v, "questions")), listed))

    return _let(F.try_parse_json(raw), problem)


def course_problems(weeks: DataFrame, *, by: str = "course_id", week: str = "week", script: str = "script", quiz: str = "quiz", slides: str = "slides") -> DataFrame:
    """(by, problem) of every course: its weeks are 1, 2, ..., each once, and each has a valid script, a valid quiz of its own and slides; the first week's first problem."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col(week).asc_nulls_first(), script, quiz))
    own = F.coalesce(
        F.concat(F.lit("script: "), script_problem(F.col(script))), F.concat(F.lit("quiz: "), week_quiz_problem(F.col(quiz), F.col(week))), F.when(F.col(slides).isNull(), "no slides"),
    )
    rows = weeks.withColumn("__place", place).withColumn("__own", own)
    gap = F.max(F.when(~F.col(week).eqNullSafe(F.col("__place")), "weeks are not 1, 2, ..."))
    first = F.min(F.when(F.col("__own").isNotNull(), F.struct("__place", F.concat(F.lit("week "), F.col(week).cast("string"), F.lit(": "), F.col("__own")).alias("said"))))["said"]
    return rows.groupBy(by).agg(F.coalesce(gap, first).alias("problem"))
