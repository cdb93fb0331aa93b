"""Content-derived identities as column expressions."""

from __future__ import annotations

from uuid import NAMESPACE_URL

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(name: Column, namespace: bytes = NAMESPACE_URL.bytes) -> Column:
    """Name-based UUID (version 5): the SHA-1 of namespace and name, with version and variant bits set."""
    digest = F.sha1(F.concat(F.lit(namespace), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def document_id(collection: Column, name: Column, prefix: str = "gradus") -> Column:
    """Stable id of a document of a collection; blank parts are an error."""
    blank = (F.trim(collection) == "") | (F.trim(name) == "") | collection.isNull() | name.isNull()
    made = uuid5(F.concat(F.lit(f"{prefix}:collection:"), collection, F.lit(":document:"), name))
    return F.when(blank, F.raise_error(F.lit("collection and file name are needed"))).otherwise(made)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprint(**components: Column | str) -> Column:
    """SHA-256 of ``name:value`` lines in the order given."""
    lines = [F.concat(F.lit(f"{k}:"), v if isinstance(v, Column) else F.lit(str(v))) for k, v in components.items()]
    return F.sha2(F.concat_ws("\n", *lines), 256)


def artifact_key(content: Column, pipeline: Column) -> Column:
    return F.sha2(F.concat(content, F.lit(":"), pipeline), 256)


def suffix(name: Column) -> Column:
    """Lower-case extension of a file name, without the dot."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


#: What shapes a generated course, by name, in the order in which it is hashed; a number of minutes a page has four digits.
COURSE_COMPONENTS = (
    "schema planner lecture_writer target_semester_weeks max_semester_weeks normal_semester_chapters max_chapters_per_semester max_chapters_per_week lecture_minutes_min lecture_minutes_max "
    "minutes_per_page spoken_words_per_minute narration_sentences_per_slide slides_per_batch min_lecture_questions prompts generation_model"
).split()


def course_fingerprint(**components: Column | str | float) -> Column:
    """SHA-256 over every component of a course; all of COURSE_COMPONENTS are needed, in any order, and no other."""
    if set(components) != set(COURSE_COMPONENTS):
        raise ValueError(f"missing or unknown: {sorted(set(components) ^ set(COURSE_COMPONENTS))}")
    pace = components["minutes_per_page"]
    shown = F.format_string("%.4f", pace.cast("double")) if isinstance(pace, Column) else f"{pace:.4f}"
    given = components | {"minutes_per_page": shown}
    return fingerprint(**{name: given[name].cast("string") if isinstance(given[name], Column) else str(given[name]) for name in COURSE_COMPONENTS})
