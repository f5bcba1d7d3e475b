"""Rows at the edge for every operator: null and repeated ids, very long texts and lines, clashing columns, many sources."""

from __future__ import annotations

import random
from functools import partial

import corpus_pipeline
import pytest
from helpers import words
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, licences, line_dedup, mixing, ngram_join, pieces, quality, suffix_dedup, surrogates, toxicity

KIND = "doc_id long, text string, lang string, source string, toxic int, size long, row long, k int, mean double, found string, digest string, copies long, group_size long, _split long"
OPERATORS = {
    "units": line_dedup.repeated_units, "mixing": mixing.mix_rates, "pieces": pieces.encoded_digests, "exact": exact_dedup.exact_groups, "ngram": ngram_join.similarity_classes,
    "suffix": suffix_dedup.removed_bytes, "surrogates": partial(surrogates.with_surrogates, secret="k"), "licences": licences.licence_scan, "quality": quality.judged,
}

def edge_rows():
    rng = random.Random(9)
    long = words(rng, 21_000)
    giant = words(rng, 9_000).replace(" ", "-")
    base = words(rng, 150)
    return [
        (None, base, "en", "a"), (None, base, "en", "a"), (None, None, None, None), (1, base, "en", "a"), (1, base, "en", "a"), (1, long, None, "a"), (2, long + " end", "en", None),
        (3, giant, "en", "b"), (4, "", "en", "b"), (-(2**63), base + " ", "en", "a"), (2**63 - 1, base, "en", "c"), (7, None, "en", "c"),
    ]


def edges(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 0.5, "x", "y", 5, 6, 7) for r in edge_rows()], KIND)


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    rows = OPERATORS[name](edges(spark)).collect()
    if name == "units":
        assert {r.doc_id for r in rows} >= {1, 2**63 - 1}
    else:
        assert len(rows) == len(edge_rows())
    if name == "ngram":
        assert sorted(r.n_shingles for r in rows if r.doc_id is None) == [0, 148, 148] and all((r.component_id is None) == (r.doc_id is None) for r in rows)
    if name == "suffix":
        assert all(r.n_removed == 0 for r in rows if r.doc_id is None)


def test_toxicity_with_clashing_columns_and_null_ids(spark):
    docs = edges(spark)
    labels = docs.filter("doc_id in (1, 2, 3)").select("doc_id", F.when(F.col("doc_id") == 1, 1).otherwise(0).alias("toxic"), F.lit("a").alias("text"), F.lit(0.5).alias("score")).distinct()
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_exact_groups_where_the_longest_has_no_id(spark):
    docs = spark.createDataFrame([(None, "a b  c d"), (1, "a b c d"), (2, "abcd"), (None, "alone"), (None, ""), (5, None)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()), key=lambda g: g[:2])
    assert [g for g in got if g[3] == 3] == [(False, 1, None, 3, False), (False, 2, None, 3, False), (True, 0, None, 3, True)]
    assert [g for g in got if g[3] == 2] == [(False, 5, 5, 2, True), (True, 0, 5, 2, False)]
    assert [g for g in got if g[3] == 1] == [(True, 0, None, 1, True)]
    assert len(got) == 6


def test_keep_first_by_join_as_by_broadcast(spark):
    docs = edges(spark)
    key = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    assert key(exact_dedup.keep_first(docs, most=0)) == key(exact_dedup.keep_first(docs))


def test_mixed_by_join_as_by_broadcast(spark):
    docs = edges(spark)
    key = lambda df: sorted((r.doc_id or 0, r.text or "", r.source or "") for r in df.collect())
    assert key(mixing.mixed(docs, most=0)) == key(mixing.mixed(docs))


def test_many_sources(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 100_000).cast("string").alias("source"))
    got = mixing.mix_rates(docs).agg(F.sum(F.col("target") / 2).alias("all"), F.max(F.col("target") / F.col("source_size")).alias("most")).first()
    assert abs(got["all"] - 1.5 * 600_000) < 1
    assert got["most"] <= 2.0


def test_stages_on_edge_rows(spark):
    docs = edges(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == columns, name
    assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
