"""A training-data pipeline: each stage is one operator of gradus.llm over all that the stage before kept.

Stages return the columns of ``documents``; the last returns token ids. ``run`` writes each stage's
rows as Parquet in the folder that all executors share and rereads them for the next.

An empty table passes through every stage, and further columns go along up to the last. Very long texts, repeated rows and ties
are as each operator states.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import bpe, decontaminate, jaccard, rules, secretscan
from gradus.llm.common import checkpoint_folder, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go, null and empty texts among them; repeated rows are judged each."""
    return rules.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts the document of smallest id stays, of a repeated id one row; rows without words or id are linked with nothing and stay."""
    return jaccard.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go; null and empty texts have no words and stay; rows of one id are judged each by its text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows; null and empty texts stay as they are."""
    return secretscan.redact(docs, secretscan.fit(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_tokens, ids): ids little-endian unsigned 32-bit, decoded and held against the text.

    Null and empty texts have no ids.
    """
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        made = bpe.round_trip(docs, file.read(), public_tokenizers.PATTERN, ids="__ids", decoded="__decoded")
    same = F.col("__decoded") == F.coalesce("text", F.lit("")).cast("binary")
    ids = F.when(same, F.col("__ids")).otherwise(F.raise_error(F.lit("the ids of a text do not decode to it")).cast("binary"))
    return made.select("doc_id", "lang", "source", "n_chars", (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]
#: The stages fit cutoffs, automata and merges that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
