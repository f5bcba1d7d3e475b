import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def filled(sizes, weights):
    """Targets by sharing again and again, as the rule is told."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, fixed, budget = set(names), {}, 1.5 * sum(sizes.values())
    while left:
        rest = budget - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return fixed


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 3000, "c": 50, None: 7}, {"x": 10, "y": 10}, {"a": 0, "b": 5}, {"a": 1, "b": 1, "c": 1, "d": 1000, "e": 1}])
def test_targets_match_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = filled(sizes, mixing.WEIGHTS)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s])


def test_rows_and_edge_cases(spark):
    rows = [(1, "a b c", "s", 1), (2, None, "s", 2), (3, "", None, 3), (3, "x y", None, 3), (4, "w " * 500, "t", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix_rates(docs).collect()
    assert len(out) == 5
    assert all(r.copies <= 2 and (r.size or not r.source_size or r.copies >= 0) for r in out)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_rates(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_taken_comes_near_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    out = mixing.mix_rates(docs).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    for r in out:
        assert abs(r.taken - r.target) < 0.1 * r.target
