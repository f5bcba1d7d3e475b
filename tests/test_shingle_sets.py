"""Sets of five words, as hashes, and how often a plan makes them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.functions.names import shingle_hashes
from millrace.operators.postings import q_m05, with_quality


def test_sets_are_those_of_word_runs(spark):
    draw = random.Random(2)
    texts = [[draw.choice("abc") for _ in range(draw.randrange(0, 40))] for _ in range(300)] + [[], ["a"], ["a"] * 4, ["a"] * 5, ["a"] * 9, ["a", "b"], ["b", "a"]]
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "i long, w array<string>").orderBy("i").select(shingle_hashes(F.col("w"))).collect()]
    assert [len(g) for g in got] == [len(runs(w)) for w in texts]
    for a, b in ((draw.randrange(len(texts)), draw.randrange(len(texts))) for _ in range(500)):
        assert len(set(got[a]) & set(got[b])) == len(runs(texts[a]) & runs(texts[b]))


def test_siblings_are_the_latest_others(spark):
    """The sixth latest counts where a row is one of the five; rows without a company or moment come back."""
    five = lambda c: " ".join(c * 6)
    rows = [(i, "x", i if i else None, five(c)) for i, c in enumerate("azbcdefa")] + [(20, None, 1, five("a")), (21, "y", None, None), (22, "y", None, five("q")), (23, "y", None, five("q"))]
    got = {r.id: r.quality for r in with_quality(spark.createDataFrame(rows, "id long, company string, seen long, text string")).collect()}
    assert len(got) == len(rows) and got[21] == 0.0
    assert got[0] == 0.2 and got[7] == 0.4 and got[20] == 0.4 and got[22] == got[23] == 0.2  # 7 is among the latest of 0, 0 isn't among those of 7


def test_sets_are_not_made_of_all_texts_twice(spark):
    plan = q_m05(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.count("array_intersect(") == 1
