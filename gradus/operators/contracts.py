"""Contracts of generated material as column predicates; the first broken rule names itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import spread

RICH = ("diagram", "comparison", "timeline", "equation", "code", "chart")


def option_text(option: Column) -> Column:
    """An answer option without its letter label."""
    return X.strip(F.regexp_replace(X.strip(option), r"^[A-Da-d][).:]\s*", ""))


def first_problem(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that is not true; null where all hold."""
    return F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(message)) for rule, message in rules))


def quiz_problem(question: Column, options: Column, answer: Column, labels: tuple[str, ...] = ("A", "B", "C", "D")) -> Column:
    """A question text, as many distinct non-blank options as labels, and an answer among the labels."""
    clean = F.transform(options, lambda o: F.lower(option_text(o)))
    return first_problem(
        (F.length(X.strip(question)) > 0, "question is blank"),
        (F.size(options) == len(labels), "wrong number of options"),
        (F.forall(clean, lambda o: o != ""), "an option is blank"),
        (F.size(F.array_distinct(clean)) == len(labels), "options repeat"),
        (F.upper(X.strip(answer)).isin(*labels), "answer is no label"),
    )


def lecture_problem(segments: Column, most: int = 40, words: int = 15) -> Column:
    """Segments of a title, and a narration of ``words`` words or more."""
    spoken = lambda s: F.size(F.filter(F.split(X.strip(s["narration"]), r"\s+"), lambda w: w != ""))
    return first_problem(
        (F.size(segments).between(1, most), "wrong number of segments"),
        (F.forall(segments, lambda s: X.strip(s["title"]) != ""), "a title is blank"),
        (F.forall(segments, lambda s: spoken(s) >= words), "a narration is short"),
    )


def deck_problems(slides: DataFrame, *, deck: str = "deck_id", order: str = "position", layout: str = "layout") -> DataFrame:
    """(deck, n_layouts, n_rich, longest_run_of_3, problem): variety of the layouts of each deck."""
    own = Window.partitionBy(deck).orderBy(order)
    run = (F.col(layout) == F.lag(layout, 1).over(own)) & (F.col(layout) == F.lag(layout, 2).over(own))
    seen = spread(slides, deck).withColumn("__run", F.coalesce(run, F.lit(False)))
    counted = seen.groupBy(deck).agg(F.size(F.collect_set(layout)).alias("n_layouts"), F.count_if(F.col(layout).isin(*RICH)).alias("n_rich"), F.bool_or("__run").alias("has_run"))
    return counted.withColumn("problem", first_problem((F.col("n_layouts") >= 3, "fewer than 3 layouts"), (F.col("n_rich") >= 2, "fewer than 2 rich layouts"), (~F.col("has_run"), "one layout three times in a row")))


def section_problem(minutes: Column, budget: Column, objectives: Column, titles: Column, examples: Column, todos: Column) -> Column:
    """A section keeps its budget of 30 to 120 minutes, repeats nothing and has examples and exercises."""
    unique = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: F.lower(X.strip(x))))) == F.size(a)
    filled = lambda a: F.forall(a, lambda x: X.strip(x) != "")
    total = F.aggregate(minutes, F.lit(0).cast("long"), lambda a, b: a + b)
    return first_problem(
        (budget.between(30, 120), "budget outside 30 to 120 minutes"), (total == budget, "minutes do not make up the budget"),
        (filled(objectives) & unique(objectives), "objectives repeat or are blank"), (filled(titles) & unique(titles), "titles repeat or are blank"),
        (F.size(examples) > 0, "no grounded example"), (F.size(todos) > 0, "no grounded exercise"),
    )


def weeks_contiguous(weeks: Column) -> Column:
    """Week numbers are 1..n, each once."""
    return (F.size(weeks) > 0) & (F.array_sort(weeks) == F.sequence(F.lit(1), F.size(weeks)))


def triage_problem(action: Column, question: Column) -> Column:
    """Only the action that asks may carry a question code, and it must."""
    asks = action == "ask_question"
    return first_problem((~asks | question.isNotNull(), "asks without a question code"), (asks | question.isNull(), "a question code without asking"))
