"""J16's index: recall against brute force, exactness with all lists probed, hot lists, blocks and rows without a direction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from millrace.operators.vectors import search, vector_index

KIND = "vec_id long, v array<double>"


def truth(ids, x, asks, k=5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in asks:
        score = np.round(unit @ unit[list(ids).index(q)], 6)
        out[q] = [int(i) for _, i in sorted(zip(-score, ids)) if i != q][:k]
    return out


def found(rows):
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def share(got, want):
    return np.mean([len(set(got.get(q, [])) & set(n)) / len(n) for q, n in want.items()])


def asked(rows, test="vec_id % 100 = 0"):
    return rows.filter(test).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    local = rows.orderBy("vec_id").toPandas()
    want = truth(local["vec_id"].tolist(), np.stack(local["v"].to_numpy()), [i for i in local["vec_id"] if i % 100 == 0])
    index = vector_index(rows)
    assert share(found(search(index, asked(rows))), want) >= 0.9
    assert index.rows.count() == len(local)


def test_recall_and_work_on_clusters(spark):
    """On clustered vectors few lists are probed, also where centroids saw a tenth of the rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 24))[rng.integers(40, size=6000)] + 0.35 * rng.normal(size=(6000, 24))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], KIND)
    index = vector_index(rows, most_learnt=600, lists=40, part_rows=100)
    assert index.probes <= 20 and index.sampled_recall[index.probes] >= 0.97 and index.parts.max() > 1
    assert share(found(search(index, asked(rows), block=20)), truth(range(6000), x, range(0, 6000, 100))) >= 0.9


def test_all_lists_are_exact_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6))
    x[:300] = x[0]
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(5000, [0.0] * 6), (5100, None)], KIND)
    index = vector_index(rows, lists=12, part_rows=50)
    got = found(search(index, asked(rows, "vec_id % 50 = 0"), probes=12, block=7))
    assert got == truth(range(900), x, range(0, 900, 50))
    assert vector_index(rows.limit(0)).rows.count() == 0
    assert search(vector_index(rows.limit(0)), asked(rows)).count() == 0
    assert search(index, asked(rows.limit(0))).count() == 0


def test_vectors_are_read_as_one_array():
    """Their numbers never stand as Python objects, five times their size; slices, chunks and nulls inside are read as they are."""
    import tracemalloc

    import pyarrow as pa

    from millrace.operators.vectors import units

    x = np.random.default_rng(1).normal(size=(20_000, 64))
    column = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float64()))
    tracemalloc.start()
    got = units(pa.chunked_array([column.slice(0, 7000), column.slice(7000)]))
    assert tracemalloc.get_traced_memory()[1] < 3.5 * x.nbytes
    tracemalloc.stop()
    assert np.array_equal(got, x / np.linalg.norm(x, axis=1, keepdims=True))
    odd = units(pa.array([[0.0, 0.0], [1.0, None], [3.0, 4.0]]))
    assert odd[0].tolist() == [0, 0] and np.isnan(odd[1, 1]) and odd[2].tolist() == [0.6, 0.8]
