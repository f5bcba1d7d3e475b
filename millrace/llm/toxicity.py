"""Toxicity: gradient-boosted trees over a few dense features of the whole text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, table, texts

FEATURES = ("hits", "hit_rate", "stem_hits", "stem_rate", "disguised", "near_you", "capitals", "shouts", "odd_words", "log_words", "strongest")
YOU = frozenset("you your yours yourself u du dich dir dein ihr euch vous tu te toi votre ton usted tú ti su vuestro".split())
WORDS = re.compile(r"[^\W_]+(?:[@$!*0-9'’-][^\W_]+)*[!*]*", re.UNICODE)
LEET = str.maketrans("013457@$!", "oieastasi")
STEM = 5


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


class Words(dict):
    """word -> bits and weight: 1 lexicon, 2 stem, 4 disguised lexicon word, 8 second person, 16 odd spelling."""

    def __init__(self, lexicon: dict[str, float], stems: frozenset[str]):
        self.lexicon, self.stems = lexicon, stems

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        low = word.lower().rstrip("!*")
        plain, odd = low, False
        if not low.isalpha():
            plain = re.sub(r"[^a-zà-ÿ]", "", low.translate(LEET))
            odd = any(c in low for c in "@$!*") or bool(re.search(r"[^\W\d_]\d+[^\W\d_]", low))
        listed = low in self.lexicon
        disguised = odd and plain in self.lexicon
        weight = self.lexicon[low] if listed else self.lexicon[plain] if disguised else 0.0
        self[word] = bits = listed + 2 * (low[:STEM] in self.stems) + 4 * disguised + 8 * (low in YOU) + 16 * odd + (min(255, int(weight * 16)) << 8)
        return bits


def features(text: str, known: Words) -> tuple[float, ...]:
    words = WORDS.findall(text)
    n = len(words)
    bits = np.fromiter(map(known.__getitem__, words), np.int64, n)
    hit, stem, disguised, you, odd = ((bits >> k & 1).astype(bool) for k in range(5))
    hits, stems = int((hit | disguised).sum()), int(stem.sum())
    near = 0
    if hits and you.any():
        at = np.flatnonzero(hit | disguised)
        places = np.flatnonzero(you)
        after = np.searchsorted(places, at)
        gap = np.minimum(np.abs(places[np.minimum(after, len(places) - 1)] - at), np.abs(places[np.maximum(after - 1, 0)] - at))
        near = int((gap <= 3).sum())
    raw = np.frombuffer(text.encode(), np.uint8)
    size = len(raw) + 100.0
    capitals, shouts = int(((raw >= 65) & (raw <= 90)).sum()), int(((raw == 33) | (raw == 63)).sum())
    strongest = float((bits >> 8).max()) / 16 if n else 0.0
    return (float(np.log1p(hits)), hits / (n + 20.0), float(np.log1p(stems)), stems / (n + 20.0), float(disguised.sum()), float(near), capitals / size, shouts / size, float(odd.sum()) / (n + 20.0), float(np.log1p(n)), strongest)


def with_features(rows: DataFrame, lexicons: list[tuple[dict[str, float], frozenset[str]]]) -> DataFrame:
    """The rows' other columns and FEATURES of their text by the lexicon that column `by` numbers; one narrow pass."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Words(*lexicon) for lexicon in lexicons]
        for batch in batches:
            found = list(zip(*[features(t.as_py(), known[k]) for t, k in zip(batch.column("text"), batch.column("by").to_pylist(), strict=True)], strict=True)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(x, pa.float64()) for x in found]], [*others, *FEATURES])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in others] + [f"{f} double" for f in FEATURES]))


def learnt_lexicons(sample: DataFrame, folds: int, sure: float) -> list[tuple[dict[str, float], frozenset[str]]]:
    """Lexicons of words, and of stems of STEM letters: one without each fold's texts, then one of all.

    A word's weight is the least that its log odds of standing in a toxic text are sure to be: the smoothed odds less `sure` standard
    errors. Words with a weight above 0 are the lexicon, all of them; rarer words have larger errors. Texts are counted per word and fold
    with grouped sums; what is collected is bounded by the words of the sample, which is bounded itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic, fold in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), batch.column("by").to_pylist(), strict=True):
                low = {w.lower().rstrip("!*") for w in WORDS.findall(text)}
                for key in low | {"stem:" + w[:STEM] for w in low if len(w) > STEM}:
                    counts.setdefault(key, [0] * 2 * folds)[2 * fold + (1 if toxic else 0)] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([counts[k][j] for k in keys], pa.int64()) for j in range(2 * folds)]], ["word", *cells])

    cells = [f"{kind}{k}" for k in range(folds) for kind in ("good", "bad")]
    totals = sample.groupBy("by").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all")).collect()
    bads, goods = {r.by: r.bad for r in totals}, {r.by: r["all"] - r.bad for r in totals}
    counts = sample.select("text", "toxic", "by").mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in cells)).groupBy("word").agg(*[F.sum(c).alias(c) for c in cells])

    def weight(left: range | list[int]) -> Column:
        bad, good = sum((F.col(f"bad{k}") for k in left), F.lit(0)), sum((F.col(f"good{k}") for k in left), F.lit(0))
        all_bad, all_good = sum(bads.get(k, 0) for k in left) + 1.0, sum(goods.get(k, 0) for k in left) + 1.0
        odds = F.log((bad + 0.5) / (all_bad - bad + 0.5)) - F.log((good + 0.5) / (all_good - good + 0.5))
        error = F.sqrt(1.0 / (bad + 0.5) + 1.0 / (good + 0.5))
        return F.greatest((odds - sure * error) / math.log(2), F.lit(0.0))

    names = [f"w{k}" for k in range(folds + 1)]
    weights = counts.select("word", *[weight([j for j in range(folds) if j != k]).alias(names[k]) for k in range(folds)], weight(list(range(folds))).alias(names[folds]))
    strong = weights.filter(F.greatest(*names) > 0).collect()
    return [({r.word: r[w] for r in strong if r[w] > 0 and not r.word.startswith("stem:")}, frozenset(r.word[5:] for r in strong if r[w] > 0 and r.word.startswith("stem:"))) for w in names]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_learnt: int = 20_000, folds: int = 4, sure: float = 2.0) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from at most most_learnt labelled rows that aren't held out, those with the smallest hash of their id;
    the bound is what makes the sample's ids safe to broadcast. Three quarters of the sample give the lexicon and
    the trees, the rest calibrates them. The trees learn from features by the lexicon of the other folds' texts, so that no text's own label is in
    its features; all other texts go by the lexicon of all folds. Scores use the text alone. Null texts count as empty and are
    scored; null labels aren't learnt from; of a document's several labels the largest counts; with one class or no labels every score is the share of toxic rows seen; an
    empty table gives an empty result; repeated rows are scored each, rows without an id too; very long texts are read whole; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_learnt)
    part = lambda salt, n: F.crc32(F.concat(F.lit(salt), F.col("doc_id").cast("string")).cast("binary")) % n
    sample = rows.join(F.broadcast(chosen), "doc_id").withColumn("calibrates", part("fold:", 4) == 0)
    sample = cut(sample.withColumn("by", F.when(F.col("calibrates"), F.lit(folds)).otherwise(part("lexicon:", folds)).cast("int")))
    seen = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = rows.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    if not seen.get(0) or not seen.get(1):
        share = seen.get(1, 0) / max(1, sum(seen.values()))
        return out.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    lexicons = learnt_lexicons(sample.filter(~F.col("calibrates")), folds, sure)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    # Few small rows are gathered for the trees only after their features were taken in as many tasks as hold the sample.
    learnt = with_features(sample.select("doc_id", "toxic", "calibrates", "by", "text"), lexicons).repartition(8)
    learnt = cut(vector.transform(learnt).select("features", "calibrates", F.col("toxic").cast("double").alias("label")))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=7).fit(learnt.filter(~F.col("calibrates")))
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    rising = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="rising")
    fold = raw(learnt.filter("calibrates")).select("raw", "label")
    steps = rising.fit(fold if not fold.isEmpty() else raw(learnt).select("raw", "label"))
    scored = steps.transform(raw(vector.transform(with_features(out.withColumn("by", F.lit(0)), lexicons[folds:]))))
    # Within a calibrated step the trees' own order is kept by a small share of it.
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rising") * 0.98 + F.col("raw") * 0.02))
    return scored.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
