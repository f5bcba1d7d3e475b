"""Null and repeated ids through op8 and each stage of the pipeline: rows are judged, not ids."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from helpers import words
from pyspark.sql import functions as F

from millrace.llm import common, surrogates
from millrace.llm.mixing import mixed

KIND = "doc_id long, text string, lang string, source string"


def test_surrogates_of_rows_without_an_id(spark):
    rows = [(None, "write ann.7@x.example", "en", "a"), (None, "write bob.8@x.example today", "en", "a"), (3, "call +1 (988) 555-2485", "en", "a"), (3, "write ann.7@x.example", "en", "a")]
    rows += [rows[0], (None, None, "en", "a")]
    out = surrogates.with_surrogates(spark.createDataFrame(rows, KIND), "k").collect()
    assert len(out) == len(rows)
    texts = sorted((r.doc_id or 0, r.n_entities, r.kinds) for r in out)
    assert texts == [(0, 0, ""), (0, 1, "email"), (0, 1, "email"), (0, 1, "email"), (3, 1, "email"), (3, 1, "phone")]
    assert not any("@x.example" in r.text and r.text in {t for _, t, _, _ in rows} for r in out if r.text)
    assert len({r.text for r in out if r.text and r.text.endswith("today")}) == 1


@pytest.mark.parametrize("stage", [corpus_pipeline.exact_duplicates, corpus_pipeline.near_duplicates])
def test_one_row_of_equal_ones(spark, stage):
    rng = random.Random(3)
    a, b, c, d = (words(rng, 120) for _ in range(4))
    rows = [(1, a, "en", "a"), (1, a, "en", "a"), (1, b, "en", "a"), (2, b, "en", "a"), (2, c, "en", "a"), (None, c, "en", "a"), (None, d, "en", "a"), (None, d, "en", "a")]
    out = sorted(((r.doc_id or 0, r.text) for r in stage(spark, spark.createDataFrame(rows, KIND), "").collect()))
    assert out == sorted([(1, a), (1, b), (2, c), (0, d)])


def test_quality_judges_rows(spark):
    rng = random.Random(4)
    good, other = words(rng, 200), words(rng, 200)
    rows = [(1, good, "en", "a"), (1, "too short", "en", "a"), (None, "short too", "en", "a"), (None, other, "en", "a")]
    out = {(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, KIND), "").collect()}
    assert not {t for _, t in out} & {"too short", "short too"}
    assert {(1, good), (None, other)} <= out


def test_mixing_keeps_rows_without_an_id(spark):
    rows = [(None, "a b c", "en", None), (None, "d e f", "en", "s"), (None, "g h i", "en", "s"), (4, "j k l", "en", "t")]
    docs = spark.createDataFrame(rows, KIND)
    by = {(r.doc_id, r.source): r.n for r in mixed(docs).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n for (i, _), n in by.items() if i is None) > 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_different_rows_of_one_key_all_stay(spark, monkeypatch, most):
    """Keys forced onto three values: nothing is lost but what is equal in all columns; a key that names one row still removes it."""
    rows = [(i, f"text {i}", "en", None) for i in range(40)] + [(3, "text 3", "en", None), (None, None, None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, KIND)
    plain = common.row_key
    gone = docs.filter("doc_id in (5, 6)").select(plain(docs).alias("x"))
    kept = lambda: sorted(map(str, common.without(docs, gone, most).collect()))
    want = {r for r in rows if r[0] not in (5, 6)}
    assert len(kept()) == len(want)
    monkeypatch.setattr(common, "row_key", lambda d, seed=None: F.pmod(plain(d), F.lit(3)) if seed is None else plain(d, seed))
    gone = spark.createDataFrame([(0,), (1,), (2,)], "x long")
    assert kept() == sorted(str(r) for r in spark.createDataFrame(sorted(set(rows), key=str), KIND).collect())
