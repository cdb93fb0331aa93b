r"""Chat formatting with a grammar that round-trips (DataFrame operations only).

Grammar of a formatted conversation, one production a turn:

    conversation := turn*
    turn         := "### " role ": " text " </turn>" newline

Roles and texts never hold an unescaped control string, so the parser is deterministic: it cuts
at the turn end, then at the first ": ", then undoes the escapes ``\0`` (backslash), ``\1``
(``###``), ``\2`` (``</turn>``) and, in roles, ``\3`` (colon). Each field is rendered as it is,
reparsed and compared; where the parse differs, or a control string shows, its escaped form is
rendered instead, and that form always reparses identically. ``formatted`` asserts that the parse
of every whole conversation equals its source.

The loss mask covers the text of each assistant turn: ``spans`` holds (start, chars) in code
points of the formatted text.

Defined results: null role or text is empty; rows without a conversation id form one conversation
of null id; turns of equal number follow by role, then text, null numbers first; repeated rows are
turns of their own; an empty table gives no conversation; a conversation without assistant turns
has an empty mask. Further columns are ignored. A conversation is one output row, which is the
only thing that a task holds whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, NAMED, END = "### ", ": ", " </turn>\n"
#: Control strings and their escapes; the backslash comes first on the way in, last on the way out.
ESCAPES = (("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"))


def escape(field: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        field = F.replace(field, F.lit(plain), F.lit(code))
    return field


def unescape(field: Column, escapes=ROLE_ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        field = F.replace(field, F.lit(code), F.lit(plain))
    return field


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(NAMED), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; a part that is no turn gives null fields."""
    parts = F.split(formatted, END)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        body = F.when(F.startswith(part, F.lit(OPEN)), F.substr(part, F.lit(len(OPEN) + 1)))
        at = F.instr(body, NAMED)
        role = F.when(at > 0, F.substr(body, F.lit(1), at - 1))
        text = F.when(at > 0, F.substr(body, at + len(NAMED)))
        return F.struct(unescape(role).alias("role"), unescape(text, ESCAPES).alias("text"))

    return F.transform(parts, turn)


def formatted(
    rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """(conv, formatted, spans, turns): the text, its loss mask and the parsed-back turns of each conversation."""
    clean = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def settled(plain: Column, rendered: Column, field: str, escapes) -> Column:
        """The field as it is if it survives the parser alone in a turn and shows no control string, else escaped."""
        parsed = parse(rendered)
        conflict = ~(F.size(parsed).eqNullSafe(F.lit(1)) & F.get(parsed, F.lit(0))[field].eqNullSafe(plain))
        for control, _ in escapes[1:]:
            conflict = conflict | F.contains(plain, F.lit(control))
        return F.when(conflict, escape(plain, escapes)).otherwise(plain)

    role_out = settled(F.col("role"), render(F.col("role"), F.lit("")), "role", ROLE_ESCAPES)
    text_out = settled(F.col("text"), render(F.lit(""), F.col("text")), "text", ESCAPES)
    shown = clean.withColumns({"role_out": role_out, "text_out": text_out}).withColumn("shown", render(F.col("role_out"), F.col("text_out")))
    before = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    # the text starts so many code points after the rendered turns before it
    start = (
        F.coalesce(F.sum(F.length("shown").cast("long")).over(before), F.lit(0)) + len(OPEN) + F.length("role_out") + len(NAMED)
    )
    turns = F.array_sort(F.collect_list(F.struct("start", "turn", "role", "text", "text_out", "shown")))
    whole = shown.withColumn("start", start).groupBy("conv").agg(turns.alias("source")).select(
        "conv",
        "source",
        F.array_join(F.transform("source", lambda t: t["shown"]), "").alias("formatted"),
        F.transform(
            F.filter("source", lambda t: t["role"] == learn),
            lambda t: F.struct(t["start"].alias("start"), F.length(t["text_out"]).alias("chars")),
        ).alias("spans"),
    )
    parsed = whole.withColumn("turns", parse(F.col("formatted")))
    same = F.col("turns") == F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(same, F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation does not parse back")))
    return parsed.select(F.col("conv").alias(conv), "formatted", "spans", checked.alias("turns"))


#: Code points of a block: a span is cut from the blocks that it meets, so that no span walks the whole text.
BLOCK = 4096


def masked(made: DataFrame, name: str = "learnt") -> DataFrame:
    """``made`` (formatted, spans) with all text under the loss mask as a column: cut by the spans, unescaped, with nothing between."""

    def said(span: Column) -> Column:
        first = F.floor(span["start"] / BLOCK).cast("int")
        last = F.floor((span["start"] + span["chars"]) / BLOCK).cast("int")
        near = F.array_join(F.slice("__blocks", first + 1, last - first + 1), "")
        return unescape(F.substr(near, (span["start"] % BLOCK + 1).cast("int"), span["chars"].cast("int")), ESCAPES)

    blocks = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return made.withColumn("__blocks", blocks).withColumn(name, F.array_join(F.transform("spans", said), "")).drop("__blocks")
