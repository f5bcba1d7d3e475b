"""Queries against their SQL on the smallest tables, by DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """One spelling for what both engines may return differently: nulls, numbers, moments, lists."""
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    if isinstance(value, (int, float)) or hasattr(value, "dtype") and value.shape == ():
        number = float(value)
        return None if math.isnan(number) else float(f"{number:.10g}")
    return value if isinstance(value, str) else repr(value)


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.sql(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
