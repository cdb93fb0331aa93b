"""Prompts as text: role boundaries, templates, and JSON out of model replies."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 160_000
SYSTEM, USER = "<system_instructions>", "<user_task>"


def assembled(system: Column, task: Column, most: int = MOST) -> Column:
    """System part and task between marks; blank parts and prompts over ``most`` characters are errors."""
    whole = F.concat(F.lit(f"{SYSTEM}\n"), F.trim(system), F.lit(f"\n</{SYSTEM[1:]}\n\n{USER}\n"), F.trim(task), F.lit(f"\n</{USER[1:]}"))
    blank = (F.trim(system) == "") | (F.trim(task) == "")
    return F.when(blank, F.raise_error(F.lit("a prompt needs both parts"))).when(F.length(whole) > most, F.raise_error(F.lit("the prompt is too long"))).otherwise(whole)


def split_roles(prompt: Column) -> Column:
    """The (system, task) of an assembled prompt; null for any other text."""
    pattern = rf"(?s)^{SYSTEM}\n(.*?)\n</{SYSTEM[1:]}\n\n{USER}\n(.*)\n</{USER[1:]}$"
    return F.when(prompt.rlike(pattern), F.struct(F.regexp_extract(prompt, pattern, 1).alias("system"), F.regexp_extract(prompt, pattern, 2).alias("task")))


def rendered(template: str, values: dict[str, str]) -> str:
    """``{{name}}`` filled in one pass, so that values are never read as templates; names must match exactly."""
    wanted = set(re.findall(r"\{\{(\w+)\}\}", template))
    if wanted != set(values):
        raise ValueError(f"missing {sorted(wanted - set(values))}, unknown {sorted(set(values) - wanted)}")
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values[m[1]], template)


def first_json(reply: str | None) -> str | None:
    """The first complete JSON object or array in a reply, whatever stands around it."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", reply or ""):
        try:
            _, end = decoder.raw_decode(reply, m.start())
        except ValueError:
            continue
        return reply[m.start() : end]
    return None


@F.pandas_udf(T.StringType())
def lenient_json(replies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """first_json over a column; balanced brackets are no regular language."""
    for part in replies:
        yield part.map(first_json)
