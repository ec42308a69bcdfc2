"""Every query of the engine against its DuckDB oracle over the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (list, np.ndarray)):
        return [plain(v) for v in value]
    if value is None or pd.isna(value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.number)):
        return repr(round(float(value), 6))
    return str(value)[:10] if hasattr(value, "year") else str(value)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(str([plain(v) for v in row]) for row in df[names].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())


#: Queries without SQL, and what has as many rows: a query or a table. test_operators.py holds them against brute force.
AS_MANY = {"link_anchors": "link_top4", "content_clean": "pages", "content_review": "pages"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_sql(spark, sf_dir, name):
    other = AS_MANY[name]
    as_many = registry.QUERIES[other](spark, sf_dir) if other in registry.QUERIES else spark.read.parquet(f"{sf_dir}/{other}.parquet")
    assert registry.QUERIES[name](spark, sf_dir).count() == as_many.count() > 0
