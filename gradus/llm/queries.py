"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, automaton, bpe, chat, decontaminate, jaccard, licences, negatives, quality, rules, secretscan, tokens, toxicity
from .common import cut, table


def _held_out(parts: int, which: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts == which


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(quality.measure(table(spark, sf_dir, "documents")))
    labels = table(spark, sf_dir, "labels").where(~_held_out(4, 2))
    scored = quality.score(measured, quality.fit(measured, labels))
    return scored.select(
        "doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """The vocabulary file and the pattern of a byte-level tokenizer."""
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.round_trip(docs, *tokenizer())
    return made.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"]))), ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("licences", lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def op3_licence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices anywhere in the words of a text, those that share a line or paragraph with other text included."""
    found = licences.notices(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["licence"]))), ",").alias("licences"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
        F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["licence"], x["at"], x["end"])), ",").alias("spans"),
    )


OP3_SQL = (
    "WITH templates(licence, said) AS (VALUES "
    + ", ".join(f"('{n}', '{t}')" for n, t in licences.TEMPLATES)
    + r"""), normal AS (
  SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\n0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g') AS t FROM documents
), units AS (
  SELECT doc_id, trim(unnest(string_split(t, chr(10)))) AS said FROM normal
  UNION ALL
  SELECT doc_id, trim(regexp_replace(said, ' ?\n ?', ' ', 'g'))
  FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n ?(?:\n ?)+')) AS said FROM normal) WHERE contains(said, chr(10))
), grams AS (
  SELECT *, row_number() OVER () AS unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT doc_id, string_split(said, ' ') AS w FROM units) WHERE len(w) > 1
), marks AS (
  SELECT licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT licence, string_split(trim(regexp_replace(lower(said), '[^0-9a-z\x{80}-\x{10FFFF}]+', ' ', 'g')), ' ') AS w FROM templates)
), scored AS (
  SELECT doc_id, unit, licence, 2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS dice
  FROM grams a JOIN marks b ON len(a.g) <= 1.5 * len(b.g) AND len(b.g) <= 1.5 * len(a.g)
), best AS (
  SELECT * FROM scored WHERE dice >= 0.8 - 1e-12 QUALIFY row_number() OVER (PARTITION BY unit ORDER BY dice DESC, licence) = 1
)
SELECT d.doc_id, count(b.unit) AS n_matches, coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences,
  coalesce(max(round(dice, 6)), 0)::DOUBLE AS best_dice
FROM documents d LEFT JOIN best b USING (doc_id) GROUP BY d.doc_id
"""
)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"),
    )
    made = chat.masked(chat.formatted(rows.unionByName(extra)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), shown AS (
  SELECT *,
    CASE WHEN contains(role, '###') OR contains(role, '</turn>') OR contains(role, ':') OR regexp_matches(role, '[\\][0-3]')
      THEN replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), ':', '\3') ELSE role END AS role_out,
    CASE WHEN contains(txt, '###') OR contains(txt, '</turn>') OR regexp_matches(txt, '[\\][0-2]')
      THEN replace(replace(replace(txt, '\', '\0'), '###', '\1'), '</turn>', '\2') ELSE txt END AS text_out
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn, role, txt)) AS turns_sha256,
  coalesce(sum(length(txt)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(txt, '' ORDER BY turn, role, txt) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(role_out) + length(text_out) + 15)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
""".replace("\\\\", "\\")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = decontaminate.hit_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spots AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), met AS (
  SELECT doc_id, item_id, i, s.n FROM spots s JOIN windows v ON s.n = v.n AND s.win = v.win
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~_held_out(5, 0))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences"
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secretscan.scan(docs, secretscan.fit(docs)).drop("text")

    def count(kind: str) -> Column:
        return F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("__spans", lambda s: s["kind"] != "format")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"),
    )


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = tokens.new_folder(spark)
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        tokens.write(docs, file.read(), folder, end=2)
    return tokens.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = cut(rules.measure(docs).drop("text"))
    judged = rules.verdict(measured, rules.certify(measured, table(spark, sf_dir, "labels")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *(rules.stat(x).alias(x) for x in counts), F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH known AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM known a JOIN known b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
), negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positive p JOIN scored n ON p.r = n.r AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10
"""


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as file:
        made = automaton.round_trip(docs, file.read())
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as file:
            files.append(file.read())
    said = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return alignment.align(docs, *files).select("doc_id", *alignment.RESULTS, said.alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_licence_scans": op3_licence_scans,
    "op3_licence_windows": op3_licence_windows,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_secret_scans": op8_secret_scans,
    "op9_token_ids": op9_token_ids,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_bpe_automaton": op12_bpe_automaton,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {"op3_licence_scans": OP3_SQL, "op4_chat_formatting": OP4_SQL, "op5_decontamination": OP5_SQL, "op11_hard_negatives": OP11_SQL}
