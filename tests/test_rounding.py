"""C20: halves of scores rounded as their SQL rounds them."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from millrace.plans.projections import rounded


def test_halves_round_by_scaling(spark):
    """Sums that lie just beside a half in binary: the engine of the SQL scales first."""
    values = [0.4 * (75.0 * k / 600) + 0.3 * r + 0.2 * (2.0 * q) + 0.1 * s for k in range(0, 600, 7) for r in (100.0, 70.0, 40.0, 10.0) for q in (1, 17, 50) for s in (20.0, 100.0)] + [-60.45, -0.25, 1e300, 0.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in frame.select(rounded(F.col("v"), 1)).collect()]
    want = [duckdb.execute("select round(?::double, 1)", [v]).fetchone()[0] for v in values]
    assert got == want
    assert [r[0] for r in frame.select(F.round("v", 1)).collect()] != want
