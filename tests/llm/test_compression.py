"""Quality by compression: block sums against plain compression, steps against pooled neighbours, held-out accuracy, edge rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
import zstandard
from helpers import awkward, words
from pyspark.sql import functions as F

from millrace.llm import compression

SF = "/root/testdata/sf0.1"


def area(score, label) -> float:
    order = np.argsort(score, kind="stable")
    score, label = np.asarray(score)[order], np.asarray(label)[order]
    _, where, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[where]
    good = int(label.sum())
    return (rank[label == 1].sum() - good * (good + 1) / 2) / (good * (len(label) - good))


def test_held_out_texts_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = compression.compression_quality(docs, labels).join(labels.dropna(subset=["quality"]), "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert area([r.score for r in out], [r.quality for r in out]) > 0.99
    assert np.mean([r.predicted == r.quality for r in out]) > 0.97
    assert abs(np.mean([r.score for r in out]) - np.mean([r.quality for r in out])) < 0.03  # calibrated in the large


def test_held_out_labels_and_other_columns_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(compression.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda d, l: {r.doc_id: r.score for r in compression.compression_quality(d, l).collect()}
    assert score(docs, labels) == score(docs.withColumn("lang", F.lit("xx")).drop("source", "n_chars"), turned)


def test_difference_by_hand():
    rng = random.Random(1)
    good, bad = [words(rng, 80).encode() for _ in range(300)], [words(rng, 80).upper().encode() for _ in range(300)]
    pair = []
    for samples in (bad, good):
        content, trained = compression.dictionary(samples, 4096)
        assert trained
        pair.append((content, compression.compressor(content, True, 3)))
    text = words(rng, 900).encode()
    by_hand = 0
    for start in range(0, len(text), 700):
        sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_dict_id=False).compress(text[start : start + 700])) for content, _ in pair]
        by_hand += sizes[0] - sizes[1]
    assert compression.difference(text, pair[0][1], pair[1][1], 700) == by_hand / (len(text) + compression.DAMP)
    assert by_hand > 0
    assert compression.difference(b"", pair[0][1], pair[1][1], 700) == 0
    assert compression.dictionary([b"a few", b"bytes"], 4096) == (b"a fewbytes", False)


def test_scores_rise_with_the_pooled_shares(spark):
    """The same texts scored by hand: differences, pooled neighbours, straight lines between them."""
    rng = random.Random(3)
    rows = [(i, (lambda t: t if i % 3 else t.upper())(words(rng, rng.randint(5, 300))) + (" !!" * (i % 7 == 0)), int(i % 3 > 0) if i % 11 else i % 2) for i in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in compression.compression_quality(docs, labels, size=2048).collect()}
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    fold = [r for r in learnt if zlib.crc32(f"fold:{r[0]}".encode()) % 4 == 0]
    sample = spark.createDataFrame([r for r in learnt if r not in fold], "doc_id long, text string, label int")
    kinds = compression.learnt_dictionaries(sample, 2048, 8_000_000, 1000)
    pair = [compression.compressor(*kind, 3) for kind in kinds]
    diff = {r[0]: compression.difference(r[1].encode(), *pair, 1000) for r in rows}
    pools: list[list[float]] = []
    for x, y in sorted((diff[r[0]], r[2]) for r in fold):
        pools.append([y, 1, x, x])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    at = [x for p in pools for x in ([p[2], p[3]] if p[2] != p[3] else [p[2]])]
    rate = [p[0] / p[1] for p in pools for _ in ([0, 0] if p[2] != p[3] else [0])]
    for key, x in diff.items():
        assert got[key] == pytest.approx(0.98 * np.interp(x, at, rate) + 0.02 / (1 + np.exp(-40 * x)), abs=1e-6)


def test_edges(spark):
    docs = awkward(spark, [(None, "no id", "en", "a"), (20, "x" * 300_000, "en", "a")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (5, 0), (12, 1), (14, 0), (7, 1), (13, 0)], "doc_id long, quality int")
    got = compression.compression_quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    empty = {r.score for r in got if r.doc_id in (2, 3)}
    assert len(empty) == 1
    assert {r.score for r in compression.compression_quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.predicted for r in compression.compression_quality(docs, labels.limit(0)).collect()} == {0}
    assert compression.compression_quality(docs.limit(0), labels).count() == 0
