"""Every registered query with SQL beside it, against DuckDB on the same files."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from assaya.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5) + 0.0
    return str(v) if isinstance(v, (str, bool, np.bool_)) else float(v) if isinstance(v, (int, np.integer)) else str(v)


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    assert table(registry.QUERIES[name](spark, SF).toPandas()) == table(duck.execute(registry.ORACLES[name]).df())


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
