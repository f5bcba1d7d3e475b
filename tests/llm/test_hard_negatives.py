"""Hard negatives against plain brute force: tables, small tiles, ties and copies, awkward vectors."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as hn

KIND = "vec_id long, label int, embedding array<double>, id long, score string, slab int"


def by_force(rows, asks, positives=5, negatives=5, low=80, high=100, of=100):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for at, (i, label, v) in enumerate(good):
        if i is None or not asks(i):
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, m) for k, (j, m, w) in enumerate(good) if k != at]
        for p, pid, _ in sorted([s for s in scores if s[2] == label], key=order)[:positives]:
            fits = [s for s in scores if s[2] != label and low * p <= of * s[0] <= high * p]
            out += [(i, pid, r, n[1], p, n[0]) for r, n in enumerate(sorted(fits, key=order)[:negatives], 1)]
    return Counter(out)


def found(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def framed(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], KIND)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_as_its_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = Counter(con.sql(hn.SQL["op12_hard_negatives"]).select("anchor_id, positive_id, rank, negative_id, positive_score, negative_score").fetchall())
    got = found(hn.op12_hard_negatives(spark, folder))
    assert got == want and len(got) > 20


@pytest.mark.parametrize("seed", range(4))
def test_small_tiles_and_like_vectors(spark, seed):
    """Clusters of near copies, lengths that differ much and several slabs, blocks, buckets and chunks: ranges do prune here."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * rng.uniform(0.05, 2, size=(6, 1))
    rows = []
    for i in range(260):
        v = centres[rng.integers(6)] * rng.choice([0.2, 1, 1, 3]) + rng.normal(size=8) * rng.choice([0, 0.01, 0.3])
        rows.append((i, int(rng.integers(3)) if seed else 0 if i < 200 else 1, [float(x) for x in v]))
    got = hn.hard_negatives(framed(spark, rows), F.col("vec_id") % 10 == 0, slab_rows=40, most_anchors=7, bucket=16, chunk=5, least_slabs=2)
    assert found(got) == by_force(rows, lambda i: i % 10 == 0)


def test_ranges_hold_every_match():
    """Slices of the sorted lists never lose a row that reaches the score, and do leave rows out."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) + 4 * np.eye(16)[rng.integers(16, size=3000)]
    x = np.round(x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(1000, 1020, size=(3000, 1)))  # a bucket holds like lengths
    size = np.sqrt((x**2).sum(1))
    bucket = hn.Bucket(np.arange(3000), x, size)
    seen = whole = 0
    for i in range(0, 3000, 30):
        for cosine in (0.5, 0.9, 0.99, 1.0):
            need = np.array([np.floor(cosine * size[i] ** 2)])
            unit = (x[i] / size[i])[None]
            focus = np.argsort(-np.abs(unit), axis=1)[:, :3]
            first, last = bucket.slices(unit, focus, bucket.cosines(size[i : i + 1], need))
            for f, a, b in zip(focus[0], first[0], last[0]):
                assert set(np.flatnonzero(x @ x[i] >= need[0])) <= set(bucket.order[f, a:b].tolist())
                seen, whole = seen + b - a, whole + 3000
    assert seen < whole / 2


def test_hot_vector_ties_and_awkward_rows(spark):
    rng = random.Random(2)
    unit = lambda: [rng.gauss(0, 0.3) for _ in range(5)]
    hot = unit()
    rows = [(i, i % 3, hot) for i in range(120)] + [(i, rng.randint(-1, 2), unit()) for i in range(120, 300)]
    rows += [(40, 1, hot), (40, 1, hot), (None, 0, hot), (None, 2, hot), (400, None, hot), (410, 1, None), (420, 1, [0.1, None, 0.2, 0.0, 0.0]), (430, 1, [0.1, float("nan"), 0.2, 0.0, 0.0]), (440, 1, [float("inf")] + [0.0] * 4)]
    rows += [(450, 1, [0.0] * 5), (460, 2, []), (470, 0, [0.5]), (480, 7, unit()), (490, 2, [200.0, -3.0, 1.0, 0.0, 0.0]), (500, 1, [190.0, 4.0, 1.0, 0.0, 0.0]), (510, 2, [-0.001] * 5), (-20, 1, hot)]
    want = by_force(rows, lambda i: i % 10 == 0)
    for tiles in ({}, {"slab_rows": 50, "most_anchors": 9, "bucket": 20, "chunk": 4}):
        assert found(hn.hard_negatives(framed(spark, rows), F.col("vec_id") % 10 == 0, **tiles)) == want
    assert len(want) > 100


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    rows = [(i, i % 2, [rng.uniform(-900_000, 900_000) for _ in range(6)]) for i in range(80)] + [(100, 0, [1e30] * 6)]
    got = found(hn.hard_negatives(framed(spark, rows), F.col("vec_id") % 10 == 0))
    assert got == by_force(rows[:-1], lambda i: i % 10 == 0)


def test_empty(spark):
    rows = framed(spark, [(1, 0, [1.0])])
    assert hn.hard_negatives(rows.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(rows, F.col("vec_id") % 10 == 0).count() == 0
