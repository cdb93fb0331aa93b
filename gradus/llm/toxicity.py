"""Toxicity by multiple-instance learning: documents are bags of sentences, only bags have labels.

A sentence's probability is the logistic of a bias and the weights of the features of its distinct
words: the whole word and its prefixes of 4 to 8 bytes, which catch inflected forms; words of one
prefix add up. A document's probability is
the noisy-or of its sentences, ``1 - prod(1 - p)``. The likelihood of the document labels under the
noisy-or is maximised with a ridge penalty, and the fitted sentence probabilities then locate the
offending sentences. Features enter by their counts: those much more frequent in toxic documents
(likelihood-ratio test), of each chain of prefixes the most telling.

The fit takes at most ``sample`` labelled documents of each label, those of smallest key hash, and of these as
many as have ``most_bytes`` of text together, the shorter ones first (the documented bounds), so a text that is too long for the
bound costs itself alone; only where every text of a label is longer than the bound is there nothing to learn from. An id that
is repeated counts once, by its smallest text. Scoring covers every row and every sentence of it.

Defined results: null, empty and wordless texts hold no sentence and score 0; equal texts score
equally; without toxic labels every score is 0; an empty table gives an empty result; further
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, cut, ready

SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = range(4, 9)
#: Bytes of the labelled texts of one label that come to the driver at most.
SAMPLE_BYTES = 32_000_000
SAMPLE, MAX_FEATURES, LEAST_HITS, LEAST_GAIN = 2000, 4096, 3, 20.0
#: Share of toxic labels taken as errors: a document without evidence must not bend the weights.
NOISE = 0.02
#: Share of its log odds at which the weight of a feature starts.
START, RIDGE = 0.5, 0.02
#: Weights of words kept per worker at most; the memo is emptied beyond.
MEMO = 300_000
_TO_SPACE = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_TO_SPACE).split()


def features(word: bytes) -> list[bytes]:
    return [word + b"$", *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float
    memo: dict[bytes, tuple[bytes, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "memo": {}}

    def active(self, word: bytes) -> tuple[bytes, ...]:
        """The features of a word that have a weight."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = tuple(f for f in features(word) if f in self.weights)
        return found

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence: a part between stops that is not blank."""
        found = []
        for m in SENTENCE.finditer(text):
            if not m.group().isspace():
                own = words(m.group())
                z = self.bias + sum(self.weights[f] for w in set(own) for f in self.active(w))
                found.append((m.start(), m.end(), 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))))
        return found

    def score(self, text: str | None) -> float:
        if not text or not self.weights:
            return 0.0
        kinds = set(words(text))
        if not kinds:
            return 0.0
        if not any(map(self.active, kinds)):
            return -math.expm1(-sum(not x.isspace() for x in SENTENCE.findall(text)) * math.log1p(math.exp(self.bias)))
        return -math.expm1(sum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in self.sentences(text)))


def _select(texts: list[str], toxic: list[bool]) -> tuple[list[bytes], list[float]]:
    """The features that tell documents apart, strongest first, and their log odds.

    A feature counts once for each distinct word of a document that has it, so that a stem with many
    forms in a document counts more than any one form; rates a document are compared.
    """
    n = (toxic.count(False), toxic.count(True))
    hits: Counter = Counter()
    for text, bad in zip(texts, toxic, strict=True):
        if bad:
            hits.update(f for w in set(words(text)) for f in features(w))
    hits = Counter({f: k for f, k in hits.items() if k >= LEAST_HITS})
    misses: Counter = Counter()
    for text, bad in zip(texts, toxic, strict=True):
        if not bad:
            misses.update(f for w in set(words(text)) for f in features(w) if f in hits)

    def gain(f: bytes) -> float:
        a, b = hits[f], misses[f]
        if a * n[0] <= 4 * b * n[1]:
            return 0.0
        share = (a + b) / sum(n)
        return 2 * sum(x * math.log(x / (m * share)) for x, m in ((a, n[1]), (b, n[0])) if x)

    ranked = sorted((-g, f) for f in hits if (g := gain(f)) >= LEAST_GAIN)
    # of a word's chain of prefixes only the most telling stays, so that rare forms share the weight of their stem
    taken: dict[bytes, None] = {}
    stems: set[bytes] = set()
    for _, f in ranked:
        prefixes = [f[:k] for k in range(min(PREFIXES), len(f))]
        if f not in stems and not any(x in taken for x in prefixes) and len(taken) < MAX_FEATURES:
            taken[f] = None
            stems.update(prefixes)
    chosen = list(taken)
    return chosen, [math.log((hits[f] + 0.5) / (n[1] + 1)) - math.log((misses[f] + 0.5) / (n[0] + 1)) for f in chosen]


def train(texts: list[str], toxic: list[bool], *, ridge: float = RIDGE, rounds: int = 1000) -> Model:
    """Maximise the penalised noisy-or likelihood by Adam over whole batches; deterministic."""
    chosen, odds = _select(texts, toxic) if any(toxic) else ([], [])
    if not chosen:
        return Model({}, -20.0)
    index = {f: i for i, f in enumerate(chosen)}
    look = Model(dict.fromkeys(chosen, 0.0), 0.0)
    rows, cols, bag, plain = [], [], [], np.zeros(len(texts))
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text):
            if m.group().isspace():
                continue
            own = words(m.group())
            found = [index[f] for w in set(own) for f in look.active(w)]
            if found:
                rows += [len(bag)] * len(found)
                cols += found
                bag.append(d)
            else:
                plain[d] += 1
    look.memo.clear()
    rows, cols, bag, y = np.array(rows), np.array(cols), np.array(bag), np.array(toxic, dtype=float)
    w, b = START * np.array(odds), -6.0
    m1, m2, g1, g2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(rows, w[cols], len(bag))
        soft, base = np.logaddexp(0, z), np.logaddexp(0, b)  # -log(1 - p)
        depth = np.bincount(bag, soft, len(texts)) + plain * base  # -log prod(1 - p)
        clean = np.exp(-depth)
        pull = np.where(y > 0, -(1 - NOISE) * clean / (NOISE + (1 - NOISE) * (1 - clean)), 1.0)  # d loss / d depth
        dz = pull[bag] / (1 + np.exp(-z))
        gw = np.bincount(cols, dz[rows], len(w)) / len(texts) + ridge * w / len(texts)
        gb = (dz.sum() + (pull * plain).sum() / (1 + np.exp(-b))) / len(texts)
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        g1, g2 = 0.9 * g1 + 0.1 * gb, 0.99 * g2 + 0.01 * gb * gb
        c1, c2, rate = 1 - 0.9**step, 1 - 0.99**step, 0.1 if step < rounds * 0.7 else 0.02
        w -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        b -= rate * (g1 / c1) / (math.sqrt(g2 / c2) + 1e-8)
        w = np.maximum(w, 0.0)  # features only raise suspicion
    return Model({f: float(v) for f, v in zip(chosen, w, strict=True) if v > 0.05}, float(b))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on the sampled rows of ``docs`` that ``labels`` (key, label 0/1) marks."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("label"))
    order = (F.xxhash64(key), F.col(key))
    picked = marks.where("label = 1").orderBy(*order).limit(sample).unionByName(marks.where("label = 0").orderBy(*order).limit(sample))
    met = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked.withColumnRenamed(key, "key")), "key")
    texts = cut(met.groupBy("key", "label").agg(F.min("text").alias("text")))
    # 2 * sample rows of a key and a number each
    running = F.sum("size").over(Window.partitionBy("label").orderBy("size", F.xxhash64("key"), "key").rowsBetween(Window.unboundedPreceding, 0))
    within = texts.select("key", "label", F.octet_length("text").alias("size")).withColumn("total", running).where(F.col("total") <= most_bytes)
    rows = texts.join(F.broadcast(within.select("key")), "key").collect()
    rows.sort(key=lambda r: r["key"])
    return train([r["text"] for r in rows], [bool(r["label"]) for r in rows])


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", located: float = 0.5) -> DataFrame:
    """(key, score, sentences): the sentences are the (start, end, score) of those at or above ``located``."""
    ready(docs.sparkSession)
    part = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, places = [], []
        for x in batch.column(1):
            whole = x.as_py()
            p = model.score(whole)
            scores.append(p)
            places.append([{"start": s, "end": e, "score": q} for s, e, q in model.sentences(whole) if q >= located] if p >= located else [])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(places, part)], names=[key, "score", "sentences"])

    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    shape = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType()), T.StructField("sentences", T.ArrayType(place))])
    return docs.select(key, text).mapInArrow(batches(apply), shape)
