"""Injected models (scorers, embedders, judges) applied in Arrow batches: bounded attempts, and an outcome a row instead of a failed job."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ATTEMPTS = 3
WRONG_LENGTH = "WrongLength"


def _called(model: Callable, inputs: Sequence[pd.Series], attempts: int, delay: float) -> tuple[list[Any] | None, int, str | None]:
    """(values, attempts, error) of one call on rows: what raises, or returns another number of rows, is tried again."""
    error = None
    for attempt in range(1, attempts + 1):
        try:
            values = list(model(*inputs))
            if len(values) == len(inputs[0]):
                return [None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x for x in values], attempt, None
            error = WRONG_LENGTH
        except Exception as raised:  # the outcome keeps its type; its text may quote data
            error = type(raised).__name__
        if delay and attempt < attempts:
            time.sleep(delay)
    return None, attempts, error


def applied(model: Callable[..., Sequence[Any]], kind: str, *inputs: Column | str, attempts: int = ATTEMPTS, delay: float = 0.0) -> Column:
    """Struct (value, attempts, error) of ``model(*inputs)``, where the model takes pandas series and returns a value a row.

    A batch that fails in every attempt is tried row by row, so that one row that the model cannot take costs no other its
    value. A row that fails too has no value and the type of its error. Nothing is raised.
    """
    if attempts < 1:
        raise ValueError("one attempt at least is needed")

    def over(*series: pd.Series) -> pd.DataFrame:
        values, used, error = _called(model, series, attempts, delay)
        if error is None:
            rows = [(v, used, None) for v in values]
        elif len(series[0]) == 1:
            rows = [(None, used, error)]
        else:
            rows = []
            for i in range(len(series[0])):
                one, more, error = _called(model, [s.iloc[i : i + 1].reset_index(drop=True) for s in series], attempts, delay)
                rows.append((one[0] if one else None, used + more, error))
        return pd.DataFrame(rows, columns=["value", "attempts", "error"], dtype=object).astype({"attempts": int}) if rows else pd.DataFrame({"value": [], "attempts": [], "error": []})

    return F.pandas_udf(over, f"value {kind}, attempts int, error string")(*inputs)


def chosen(*outcomes: Column) -> Column:
    """The first outcome that has no error, with its number; the last one's error where all failed: a bounded fallback over models."""
    named = [F.struct(o["value"].alias("value"), o["error"].alias("error"), F.lit(i).alias("model")) for i, o in enumerate(outcomes)]
    made = F.when(outcomes[0]["error"].isNull(), named[0])
    for outcome, name in zip(outcomes[1:], named[1:], strict=True):
        made = made.when(outcome["error"].isNull(), name)
    return made.otherwise(named[-1])
