"""Jobs resolved over token sets, against every pair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from millrace.operators.selection import resolution


def test_resolution_of_hot_titles(spark):
    """Each job against each posting; then 400 million pairs of one title, of six token sets."""
    draw = random.Random(5)
    sets = [["a", "b"], ["b", "c"], ["c"], ["d"], [], ["a", "d"]]
    jobs = [(i, draw.choice("xyz"), draw.choice(sets)) for i in range(60)] + [(7, "x", ["c"]), (200, None, ["a"]), (201, "none", ["a"])]
    postings = [(i, draw.choice("xxy"), draw.choice(sets[:4])) for i in range(100, 112)] + [(300, "z", ["d"]), (301, None, ["a"])]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, title string, tokens array<string>")
    want = {}
    for job, title, tokens in jobs:
        met = [(p, bool(set(tokens) & set(o))) for p, t, o in postings if t == title and title is not None]
        if met:
            want.setdefault(job, []).extend(met)
    got = {r.job: r for r in resolution(frame(jobs, "job"), frame(postings, "posting")).collect()}
    assert set(got) == set(want)
    for job, met in want.items():
        near = [p for p, n in met if n]
        verdict = ("strict", met[0][0]) if len(met) == 1 else ("loose", near[0]) if len(near) == 1 else ("ambiguous", None)
        assert (got[job].n, got[job].n_near, got[job].verdict, got[job].posting) == (len(met), len(near), *verdict)
    hot = spark.range(40_000).select("id", F.lit("t").alias("title"), F.element_at(F.array(*[F.array(*[F.lit(x) for x in s]).cast("array<string>") for s in sets]), (F.col("id") % 6 + 1).cast("int")).alias("tokens"))
    rows = resolution(hot.filter("id % 2 = 0").withColumnRenamed("id", "job"), hot.filter("id % 2 = 1").withColumnRenamed("id", "posting"))
    assert rows.agg(F.count("*"), F.min("n"), F.max("n")).first()[:] == (20_000, 20_000, 20_000)
