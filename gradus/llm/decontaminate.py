"""Benchmark decontamination by winnowing (DataFrame operations only).

Words are runs of ``[0-9a-z]`` and characters from U+0080 on, A-Z lower-cased. A benchmark window is
WINDOW consecutive words of an item; an item of fewer words is one window. A document word inside
any occurrence of a window is hit.

1. *Fingerprints.* All GRAM-word grams of a text are hashed, and of every WINDOW - GRAM + 1 neighbouring
   grams the smallest hash is kept. A text and an item that share WINDOW consecutive words
   share the smallest hash of those words' grams, so no shared span is missed. Items shorter than
   WINDOW are found by the hashes of all document grams of their length, made only for the lengths
   that the benchmark has.
2. *Join.* Document fingerprints meet the distinct fingerprints of the benchmark; documents that share
   one are candidates.
3. *Extension.* In candidates alone, the windows themselves are compared word by word with those of
   the benchmark, and overlapping hits are joined into spans. Hash collisions thus never count.

Fingerprints hash the very words that are compared: full lower-casing depends on a word's surroundings (Greek sigma).

Defined results: null texts and texts without words have no words and no hits; items without words
have no windows; items of equal text all count; equal rows give equal results, each its own; rows of
null id are judged like others; empty tables give no row, or no hit; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW, GRAM = 10, 5
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark fingerprints or windows that may be broadcast (some 100 bytes each at most for windows); more are joined by shuffle.
BROADCAST_ROWS = 200_000
CANDIDATE_ROWS = 500_000
#: Bytes of the windows that may be broadcast: ten words can be long.
WINDOW_BYTES = 32_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(lowered: Column) -> Column:
    return F.array_remove(F.split(lowered, GAPS), "")


def _exact(text: Column) -> Column:
    return words(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER))


def _grams(column: str, n: int) -> Column:
    """Hashes of all n-word grams of an array column."""
    at = F.col(column)
    hashes = F.transform(at, lambda w, i: F.xxhash64(w, *(F.get(at, i + j) for j in range(1, n))))
    return F.slice(hashes, 1, F.greatest(F.size(at) - (n - 1), F.lit(0)))


def _fingerprints(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (with an array column words) with an array column of fingerprints."""
    wide = WINDOW - GRAM + 1
    grams = F.col("__grams")
    least = F.transform(grams, lambda g, i: F.least(g, *(F.get(grams, i + j) for j in range(1, wide))))
    kept = F.array_distinct(F.slice(least, 1, F.greatest(F.size(grams) - (wide - 1), F.lit(0))))
    whole = F.concat(kept, *(F.array_distinct(_grams("words", n)) for n in lengths)) if lengths else kept
    return rows.withColumn("__grams", _grams("words", GRAM)).withColumn("prints", whole).drop("__grams")


def _small(rows: DataFrame, most: int) -> DataFrame:
    """A hint to broadcast where a count proves the bound."""
    return F.broadcast(rows) if rows.count() <= most else rows


#: Tasks that the occurrences of one fingerprint or window are dealt to where benchmarks are too large to broadcast.
SALTS = 16


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", "mark"), F.lit(SALTS)).cast("int"))


def _each_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _judge(source: DataFrame, benchmark: DataFrame, item: str, item_text: str, bound: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of ``source`` (id, text, mark): (id, mark, n_words) of its distinct rows, and (id, mark, spans, items) of those with hits.

    Up to ``bound`` fingerprints and windows, and WINDOW_BYTES of these, are broadcast. Beyond, both joins are by shuffle: documents without
    fingerprints stay out of them, and the occurrences of a common one are salted by document.
    """
    given = cut(
        benchmark.select(F.col(item).alias("item"), _exact(F.col(item_text)).alias("words"))
        .where(F.size("words") > 0)
    )
    short = sorted(r[0] for r in given.select(F.size("words")).where(F.size("words") < WINDOW).distinct().collect())  # lengths below WINDOW
    length = F.least(F.size("words"), F.lit(WINDOW))
    windows = given.select("item", length.alias("length"), F.explode(F.expr(
        f"transform(sequence(1, size(words) - least(size(words), {WINDOW}) + 1), i -> array_join(slice(words, i, {WINDOW}), ' '))"
    )).alias("window")).distinct()
    prints = _fingerprints(given.select("words").where(F.size("words") >= WINDOW), []).select(F.explode("prints").alias("print"))
    for n in short:
        prints = prints.unionByName(given.where(F.size("words") == n).select(F.explode(_grams("words", n)).alias("print")))
    prints = cut(prints.distinct())
    windows = cut(windows)
    size = windows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")).first()
    few = prints.count() <= bound and size["rows"] <= bound and size["bytes"] <= WINDOW_BYTES

    split = source.select("id", "mark", _exact(F.col("text")).alias("words"))
    n_words = F.size("words").cast("long").alias("n_words")
    printed = _fingerprints(split, short)
    if few:
        each = printed.select("id", "mark", n_words, F.explode_outer("prints").alias("print"))
        met = each.join(F.broadcast(prints.withColumn("met", F.lit(True))), "print", "left")
        judged = met.groupBy("id", "mark", "n_words").agg(F.coalesce(F.bool_or("met"), F.lit(False)).alias("met"))
    else:
        each = _salted(printed.select("id", "mark", F.explode("prints").alias("print")))
        met = each.join(_each_salt(prints), ["print", "salt"], "left_semi").select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct()
        counted = split.select("id", "mark", n_words).distinct()
        judged = counted.join(met, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
        judged = judged.select("id", "mark", "n_words", F.col("__mark").isNotNull().alias("met"))
    judged = cut(judged)

    suspects = _small(judged.where("met").select("id", "mark"), CANDIDATE_ROWS if few else bound)
    same = source["id"].eqNullSafe(suspects["id"]) & (source["mark"] == suspects["mark"])
    exact = source.join(suspects, same, "left_semi").select("id", "mark", _exact(F.col("text")).alias("words"))
    found = []
    for n in sorted({*short, WINDOW}):
        spots = exact.where(F.size("words") >= n).select("id", "mark", F.posexplode(F.expr(
            f"transform(sequence(1, size(words) - {n - 1}), i -> array_join(slice(words, i, {n}), ' '))"
        )).alias("at", "window"))
        of_length = windows.where(F.col("length") == n)
        spotted = spots.join(F.broadcast(of_length), "window") if few else _salted(spots).join(_each_salt(of_length), ["window", "salt"])
        found.append(spotted.select("id", "mark", "item", "at", (F.col("at") + n).alias("end")))
    spotted = found[0]
    for more in found[1:]:
        spotted = spotted.unionByName(more)
    spans = F.aggregate(
        F.array_sort(F.collect_set(F.struct("at", "end"))),
        F.array().cast("array<struct<at:int,end:int>>"),
        lambda made, x: F.when(
            (F.size(made) > 0) & (F.get(made, F.size(made) - 1)["end"] >= x["at"]),
            F.concat(
                F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0))),
                F.array(F.struct(F.get(made, F.size(made) - 1)["at"].alias("at"), F.greatest(F.get(made, F.size(made) - 1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(made, F.array(x))),
    )
    hit = spotted.groupBy("id", "mark").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    return judged.select("id", "mark", "n_words"), hit


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows are known by id and text hash, so that rows which repeat an id are judged each by its text."""
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))


def hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    """(key, n_words, spans, items) of every row: spans are [first word, end word), items the ids with occurring windows."""
    source = _marked(docs, key, text)
    judged, hit = _judge(source, benchmark, item, item_text, bound)
    if judged.count() < source.select("id").count():  # repeated rows stay rows
        copies = source.groupBy("id", "mark").agg(F.count("*").alias("copies"))
        one = (F.col("j.id").eqNullSafe(F.col("c.id"))) & (F.col("j.mark") == F.col("c.mark"))
        judged = judged.alias("j").join(copies.alias("c"), one).select("j.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    same = F.col("j.id").eqNullSafe(F.col("h.id")) & (F.col("j.mark") == F.col("h.mark"))
    result = judged.alias("j").join(hit.alias("h"), same, "left").select("j.id", "j.n_words", "h.spans", "h.items")
    return result.select(
        F.col("id").alias(key), "n_words",
        F.coalesce("spans", F.array().cast("array<struct<at:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["at"]))


def clean(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of ``docs`` without a hit word, columns unchanged."""
    _, hit = _judge(_marked(docs, key, text), benchmark, item, item_text, bound)
    dirty = _small(cut(hit.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"))), CANDIDATE_ROWS if bound else 0)
    same = docs[key].eqNullSafe(dirty["__id"]) & (F.xxhash64(docs[text]) == dirty["__mark"])
    return docs.join(dirty, same, "left_anti")
