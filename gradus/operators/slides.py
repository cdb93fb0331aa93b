"""Slides: bounded, escaped fields and decks as Markdown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .contracts import RICH

LAYOUTS = ("bullets", "quote", *RICH)


def plain(value: Column, most: int = 220) -> Column:
    """One line of at most ``most`` characters."""
    return F.left(X.strip(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")), F.lit(most))


def items(values: Column, count: int = 5, most: int = 120) -> Column:
    """The first ``count`` distinct lines, case aside, that are not blank."""
    clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: plain(v, most)), lambda v: v != "")
    lows = F.transform(clean, lambda v: F.lower(v))
    return F.slice(F.filter(clean, lambda v, i: F.array_position(lows, F.lower(v)) == i + 1), 1, count)


def normalised(slides: DataFrame, *, position: str = "position") -> DataFrame:
    """Slides (title, layout, bullets) with bounded fields; an unknown layout becomes bullets, or a quote where there are none."""
    bullets = items(F.col("bullets"))
    fallback = F.when(F.size(bullets) > 0, "bullets").otherwise("quote")
    layout = F.when(F.lower(F.trim("layout")).isin(*LAYOUTS), F.lower(F.trim("layout"))).otherwise(fallback)
    title = F.coalesce(F.nullif(plain(F.col("title"), 120), F.lit("")), F.concat(F.lit("Slide "), F.col(position).cast("string")))
    return slides.withColumns({"title": title, "layout": layout, "bullets": bullets})


def decks(slides: DataFrame, *, deck: str = "deck_id", position: str = "position") -> DataFrame:
    """(deck, markdown): slides in order, fields escaped, parted by rules."""
    lines = F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("- "), X.escape_markup(b))), "\n")
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), X.escape_markup(F.col("title"))), F.concat(F.lit("layout: "), F.col("layout")), F.nullif(lines, F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), body.alias("b"))))
    return slides.groupBy(deck).agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n---\n\n").alias("markdown"))
