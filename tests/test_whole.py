"""Queries against their SQL without any cut in it: all users, all candidates."""

from __future__ import annotations

import pytest
from test_queries import SF, duck, rows  # noqa: F401

from millrace.plans import registry

CUTS = {"S11_export": " where c_custkey % 50 = 3", "F16_candidates": " limit 500", "J16_nearest": " where q.vec_id < 10"}


@pytest.mark.parametrize("name", CUTS)
def test_query_is_whole(spark, duck, name):  # noqa: F811
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name].replace(CUTS[name], "")).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_nearest_over_several_blocks(spark):
    from millrace.operators.selection import nearest

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id", "embedding as v")
    queries = rows.selectExpr("vec_id as query_id", "v as q")
    one, many = ({tuple(r) for r in nearest(rows, queries, block=b).collect()} for b in (1024, 90))
    assert one == many and len(one) == 5 * rows.count()
