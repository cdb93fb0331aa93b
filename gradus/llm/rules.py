"""Quality rules whose cutoffs carry a guarantee (risk control on labelled holdouts).

Base rules are fixed: a document fails with fewer than 50 words, or when more than half of its
words stand in 3-word windows that occur twice or more in it. Beyond these, each rule of RULES
compares one statistic with a ladder of cutoffs. A step of the ladder rejects where any rule's cutoff
of that step is exceeded, so one hypothesis a step speaks for all rules together: among good documents
of the stratum the step rejects a share of ``limit`` or more. Labelled good documents test it by the
exact one-sided binomial tail. Within a stratum steps are tested from the most lenient to the strictest
and testing stops at the first that fails (fixed-sequence testing). Over strata the level ``delta`` is
dealt evenly, and a stratum whose whole ladder is certified leaves its share to the others (Holm's
procedure). With probability ``1 - delta`` every certified step of every stratum rejects less than
``limit`` of the stratum's good documents.

Strata with too few labels to certify anything by themselves are pooled into one stratum, with all
values that have no label. The pool's guarantee holds for its good documents together, in the mixture
in which they are labelled, not for each value in it. Where the pool has too few labels as well, its
documents are judged by the base rules alone.

Defined results: null or empty text has no words, so it fails the base rules; a null stratum is a
stratum like others; equal rows get equal verdicts; an empty table gives an empty result; without
labels no step is certified; an id that is repeated counts once for each of its rows; further columns of
any name pass through untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, cut, ready
from .textstats import NAMES, stats

STATS = "__stats"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: A join key set of this many strata stays below a few MB; more are refused, never dropped.
MAX_STRATA = 10_000
#: Ids of labelled good documents that are broadcast: some 100 bytes each in a hashed row.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``top / bottom`` of its counts lies above the cutoff."""

    name: str
    top: str
    bottom: str
    cutoffs: tuple[float, ...]  # from the most lenient to the strictest


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    Rule("bars", "n_bars", "n_words", (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04)),
    Rule("bangs", "n_bangs", "n_words", (2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    Rule("capitals", "n_upper", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    Rule("twins", "n_twins", "n_words", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("word_length", "word_chars", "n_words", (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5)),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column of the counts of textstats; one narrow pass."""
    ready(docs.sparkSession)
    fields = [T.StructField(x, T.LongType()) for x in NAMES]
    at, kinds = docs.columns.index(text), [pa.field(x, pa.int64()) for x in NAMES]

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([stats(x.as_py()) for x in batch.column(at)], dtype=np.int64).T
        made = pa.StructArray.from_arrays([pa.array(x) for x in np.ascontiguousarray(found)], fields=kinds)
        return pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, STATS])

    return docs.mapInArrow(batches(count), T.StructType([*docs.schema.fields, T.StructField(STATS, T.StructType(fields))]))


def stat(name: str) -> Column:
    return F.col(f"{STATS}.{name}")


def base_failed() -> Column:
    return (stat("n_words") < MIN_WORDS) | (100 * stat("n_repeat_words") > REPEAT_PERCENT * stat("n_words"))


def _above(rule: Rule, cutoff: Column | float) -> Column:
    return stat(rule.top) > cutoff * stat(rule.bottom)


def _fires(rules: tuple[Rule, ...], step: int) -> Column:
    return reduce(or_, (_above(r, r.cutoffs[step]) for r in rules))


def binomial_tail(hits: int, trials: int, share: float) -> float:
    """P(X <= hits) for X ~ Bin(trials, share), exactly summed from its largest term down."""
    if hits >= trials:
        return 1.0
    log_odds = math.log(share) - math.log1p(-share)
    log_term = (
        math.lgamma(trials + 1) - math.lgamma(hits + 1) - math.lgamma(trials - hits + 1)
        + hits * math.log(share) + (trials - hits) * math.log1p(-share)
    )
    top, total, k = log_term, 0.0, hits
    while True:
        total += math.exp(log_term - top)
        if k == 0 or (log_term < top - 45 and k < share * trials):
            return min(1.0, math.exp(top + math.log(total)))
        log_term += math.log(k) - math.log(trials - k + 1) - log_odds
        if log_term > top:
            total, top = total * math.exp(top - log_term), log_term
        k -= 1


#: Stands for the pooled stratum among certified cutoffs.
POOLED = ...


def certify(
    measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", good: str = "quality",
    rules: tuple[Rule, ...] = RULES, limit: float = 0.03, delta: float = 0.05,
) -> list[tuple]:
    """Certified cutoffs: one tuple ``(stratum, cutoff of each rule or None)`` a stratum, that of POOLED last if it has labels enough.

    Counts run over all labelled rows, in one aggregation keyed by stratum whose partial sums are
    made before the shuffle, so a hot stratum costs no more than another.
    """
    steps = len(rules[0].cutoffs)
    if any(len(r.cutoffs) != steps for r in rules):
        raise ValueError("the rules need ladders of one length")
    marks = labels.where(F.col(good) == 1).select(F.col(key).alias("__key")).distinct()
    rows = measured.select(F.col(key).alias("__key"), F.col(stratum).alias("stratum"), STATS)
    hits = [f"hits_{j}" for j in range(steps)]
    sums = [F.count_if(_fires(rules, j)).alias(x) for j, x in enumerate(hits)]
    counted = cut(rows.where(~base_failed()).join(marks, "__key").groupBy("stratum").agg(F.count("*").alias("n"), *sums))  # a row a stratum
    least = math.log(delta) / math.log1p(-limit)  # fewer labels certify nothing at any level
    found = [(r["stratum"], r) for r in counted.where(F.col("n") >= least).limit(MAX_STRATA + 1).collect()]
    if len(found) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata hold labels enough; use a coarser column than {stratum}")
    pool = counted.where(F.col("n") < least).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", *hits))).collect()[0]
    if pool["n"] >= least:
        found.append((POOLED, pool))
    tails = [[binomial_tail(r[x], r["n"], limit) for x in hits] for _, r in found]
    passed = certified_steps(tails, delta)
    return [(name, *(rule.cutoffs[k - 1] if k else None for rule in rules)) for (name, _), k in zip(found, passed, strict=True)]


def certified_steps(tails: list[list[float]], delta: float) -> list[int]:
    """How many steps of each ladder are certified: fixed sequences inside, Holm's procedure over ladders that pass whole."""
    whole: set[int] = set()
    while True:
        level = delta / max(1, len(tails) - len(whole))
        passed = [len(t) if i in whole else next((j for j, p in enumerate(t) if p > level), len(t)) for i, t in enumerate(tails)]
        now = {i for i, t in enumerate(tails) if passed[i] == len(t)}
        if now == whole:
            return passed
        whole = now


def verdict(measured: DataFrame, cutoffs: list[tuple], *, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with boolean ``__failed`` (base rules) and ``__kept``."""
    kind = measured.schema[stratum].dataType
    shape = T.StructType([T.StructField("__stratum", kind), T.StructField("__cuts", T.ArrayType(T.DoubleType()), False)])
    pooled = next((list(x[1:]) for x in cutoffs if x[0] is POOLED), [None] * len(rules))
    known = measured.sparkSession.createDataFrame([(x[0], list(x[1:])) for x in cutoffs if x[0] is not POOLED], shape)
    joined = measured.join(F.broadcast(known), measured[stratum].eqNullSafe(known["__stratum"]), "left")  # at most MAX_STRATA rows
    cuts = F.coalesce("__cuts", F.array(*(F.lit(x).cast("double") for x in pooled)))
    fires = F.lit(False)
    for i, rule in enumerate(rules):
        fires = fires | F.coalesce(_above(rule, cuts[i]), F.lit(False))
    return joined.select(
        *(measured[c] for c in measured.columns), base_failed().alias("__failed"), (~base_failed() & ~fires).alias("__kept")
    )


def keep(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the certified rules, columns unchanged.

    Cutoffs need the labelled good documents alone: where their ids are few enough to broadcast, only those are measured for it.
    """
    marks = cut(labels.where(F.col("quality") == 1).select(F.col(key).alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    names = docs.columns
    apart = {name: f"c{i}" for i, name in enumerate(names)}  # so that no name clashes with this module's own
    docs, whole = docs.toDF(*apart.values()), apart[text]
    labelled = docs.select(F.col(apart[key]).alias("doc_id"), F.col(apart[stratum]).alias("lang"), F.col(whole).alias("text"))
    if marks.count() <= BROADCAST_IDS:
        labelled = labelled.join(F.broadcast(marks), "doc_id", "left_semi")
    cutoffs = certify(measure(labelled).drop("text"), labels.withColumnRenamed(key, "doc_id"))
    kept = verdict(measure(docs, whole), cutoffs, stratum=apart[stratum]).where("__kept")
    return kept.select(*(F.col(new).alias(old) for old, new in apart.items()))
