"""Hard negatives against brute force, with odd rows of every kind."""

import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from gradus.llm import negatives, queries  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, most=10, low=30, high=90):
    known = []
    for ident, v, label in rows:
        if ident is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held = [min(max(float(np.float32(x)) * 256, -negatives.LARGEST), negatives.LARGEST) for x in v]
            known.append((ident, [int(np.floor(x)) for x in held], (label + 1) % 10 if ident % 7 == 0 else label))
    out = []
    for ident, v, label in known:
        if ident % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, w, other in known if i != ident]
        for s, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            inside = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(ident, positive, k, n, -s, -t) for k, (t, n, _) in enumerate(inside[:most], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    given = spark.createDataFrame(rows, SCHEMA).withColumns({x: F.lit("extra") for x in ("row", "rank", "id", "group", "anchor")})
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, negatives.mine(given.repartition(5), F.col("vec_id") % 100 == 0, label=label, **options).collect()))


def chance(seed, n, dims, labels=3, first=0, coarse=False):
    rng = random.Random(seed)
    one = (lambda: rng.choice([0.0, 0.25, -0.25, 0.5])) if coarse else (lambda: rng.gauss(0.1, 0.3))
    return [(first + i, [one() for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("rows", [
    chance(1, 450, 8), chance(2, 420, 7, labels=2), chance(3, 300, 3, coarse=True), chance(4, 250, 1), chance(5, 330, 6, first=-160),
], ids=["even", "odd", "ties", "one", "negative ids"])
def test_against_brute_force(spark, rows):
    made = mined(spark, rows)
    assert made == brute(rows) and made


def test_odd_rows(spark):
    rng = random.Random(6)
    rows = chance(7, 220, 5)
    rows += [(300, None, 1), (301, [0.1] * 5, None), (400, [0.1, None, 0.2, 0.3, 0.4], 1), (302, [float("nan")] * 5, 2), (500, [float("inf")] + [0.1] * 4, 2), (None, [0.5] * 5, 1)]
    rows += [(303, [], 1), (304, [0.3, 0.4], 1), (600, [0.2] * 9, 2), (700, [], 0)]  # shorter and longer vectors
    rows += [(305, [1e30, -1e30, 0.0, 0.0, 0.0], 1), (306, [-0.0] * 5, 2)]
    rows += [rows[100], rows[100], rows[5], rows[5], (100, [0.3] * 5, 2)]  # repeated rows, and an id of two vectors
    rng.shuffle(rows)
    assert mined(spark, rows) == brute(rows)


def test_hot_label_vector_and_id(spark):
    rows = chance(8, 200, 4) + [(i, [0.2, 0.1, 0.4, -0.1], 1) for i in range(1000, 1300)] + [(77, [0.3, 0.3, 0.1, 0.2], 2)] * 150
    assert mined(spark, rows) == brute(rows)


def test_small_groups_and_other_counts(spark):
    rows = chance(9, 260, 6)
    assert mined(spark, rows, group=20, positives=2, negatives=3, low=10, high=50) == brute(rows, 2, 3, 10, 50)


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, chance(10, 80, 4, first=1)) == []  # no anchor
    assert mined(spark, [(100, [1.0, 2.0], 3)]) == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(3000, 9)) * 100).astype(np.int64)
    file = negatives.Approximation(np.arange(3000), np.zeros(3000, dtype=np.int64), vectors)
    anchor = (rng.normal(size=9) * 100).astype(np.int64)
    low, high = file.bounds(anchor, slice(None))
    exact = file.vectors @ anchor
    assert (low <= exact).all() and (exact <= high).all()
    assert (high >= np.partition(low, -5)[-5]).sum() < 300  # few are left for exact scores
    assert len(np.unique(file.codes[0])) > 200


def test_query_is_its_sql(spark, sf):
    made = sorted(map(tuple, queries.op11_hard_negatives(spark, sf).collect()))
    known = duckdb.sql(queries.OP11_SQL.replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'")).fetchall()
    assert made == sorted(known) and made
