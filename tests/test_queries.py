"""Every query against its SQL on the smallest tables, values compared whatever their order."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

from gradus import catalog, catalog_courses, catalog_records, catalog_retrieval  # noqa: F401  (their queries join those of catalog)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> Counter:
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return None
        if isinstance(v, str):
            return v
        return round(float(v), 6) if hasattr(v, "__float__") else str(v)

    return Counter(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, sf, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_rewrites_of_long_conversations(spark, tmp_path):
    texts = ["first question", *["other words"] * 150, "a late question"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    mine = catalog.QUERIES["query_rewrites"](spark, str(tmp_path)).toPandas()
    assert rows(mine) == rows(con.execute(catalog.ORACLE_SQL["query_rewrites"]).df())
    assert list(mine.sort_values("position")["query"]) == ["first question", "a late question"]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_others_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
