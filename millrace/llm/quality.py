"""Quality rules: a base rule, then robust multivariate outliers per language and source.

Minimum covariance determinant: from several starts, concentration steps each keep the share of a group's rows with the
smallest Mahalanobis distance and estimate mean and covariance from them again, until the determinant falls no more;
of the starts the least determinant stays. As many statistics are zero in nearly all rows, the determinant is
the regularised one (Boudt, Rousseeuw, Vanduffel, Verdonck 2020): a fixed diagonal target is added to the
scaled covariance, for which concentration steps lower the determinant just the same. The rows stay in a DataFrame; a
step is two grouped sums, and groups that have settled drop out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, cut, split_join, table
from millrace.session import ship

SYMBOLS = "#*$%&|<>"
#: The statistics of a row, already transformed, and the spread that the target adds to each: a deviation of that size
#: is nothing to go by, also where a group's rows all agree.
FEATURES = {"log_words": 0.5, "word_length": 0.25, "symbols": 0.01, "capitals": 0.01, "marks": 0.01, "repeats": 0.06, "same_lines": 0.05}
#: Rows of a group on which starts are screened, on average; the estimates themselves are over all rows.
DRAWN = 600
#: Bins per unit of the logarithm of a distance: the trimmed set ends with the bin that holds its last row.
FINE = 4096


def statistics(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the transformed statistics of one text."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    same = len(lines) - len(set(lines))
    repeated = 0
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
        pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        _, at, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        often = times[at] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= often
        repeated = int(cover.sum())
    raw = np.frombuffer(text.encode(), np.uint8)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    letters = sum(map(text.count, ".,;:!?"))
    row = (np.log(n + 1.0), chars / (n + 2.0), symbols / (chars + 100.0), capitals / (chars + 100.0), letters / (chars + 100.0), repeated / (n + 20.0), same / (len(lines) + 5.0))
    return (n, chars, symbols, same, repeated, *row)


def chi_square_cdf(x: float, p: int) -> float:
    """The distribution of the chi-square law with p degrees of freedom, by the series of the incomplete gamma function."""
    a, y = p / 2, x / 2
    term = total = 1.0 / a
    k = 0
    while abs(term) > 1e-17 * abs(total):
        k += 1
        term *= y / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, p) < q else (low, mid)
    return low


def consistency(share: float, p: int) -> float:
    """What makes the covariance of a normal sample's inner share an estimate of the whole's."""
    return share / chi_square_cdf(chi_square_quantile(share, p), p + 2)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, the five base counts, base_failed and the transformed statistics."""
    ship(docs.sparkSession)
    lacking = [F.lit(None).cast("string").alias(c) for c in ("lang", "source") if c not in docs.columns]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string") for c in ("lang", "source") if c in docs.columns], *lacking, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*[statistics(t.as_py()) for t in batch.column("text")], strict=True)) or [()] * (5 + len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(x, pa.int64()) for x in found[:5]] + [pa.array(x, pa.float64()) for x in found[5:]],
                ["doc_id", "lang", "source", *counts, *FEATURES],
            )

    kind = "doc_id long, lang string, source string, " + ", ".join([f"{c} long" for c in counts] + [f"{c} double" for c in FEATURES])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.mapInArrow(run, kind).withColumn("base_failed", failed)


KEYS = ("g", "start")
FITTED = "g long, start int, mean array<double>, inverse array<double>, spread double"


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """(g, start, mean, inverse, spread) from grouped sums; spread is the determinant's logarithm. Estimated in tasks."""
    names = list(FEATURES)
    p, target = len(names), np.diag(np.array(list(FEATURES.values())) ** 2)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in names], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                mean = np.array([row[a] for a in names]) / row["n"]
                second = np.empty((p, p))
                for i, j in pairs:
                    second[i, j] = second[j, i] = row[f"p{i}_{j}"] / row["n"]
                covariance = factor * (second - np.outer(mean, mean)) + target
                out.append((row["g"], row["start"], mean.tolist(), np.linalg.inv(covariance).ravel().tolist(), float(np.linalg.slogdet(covariance)[1])))
            yield pd.DataFrame(out, columns=["g", "start", "mean", "inverse", "spread"])

    return sums.mapInPandas(run, FITTED)


def _distance() -> Column:
    names = list(FEATURES)
    p = len(names)
    off = [F.col(a) - F.col("mean")[i] for i, a in enumerate(names)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + (1.0 if i == j else 2.0) * off[i] * off[j] * F.col("inverse")[i * p + j]
    return F.greatest(total, F.lit(0.0))


def _measured(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """rows with d2, for each of their group's estimates; these are few and broadcast by Spark if small, else hot groups are split."""
    return split_join(rows, estimates, ["g"], how).withColumn("d2", _distance()).drop("mean", "inverse", "spread")


def _concentrated(rows: DataFrame, estimates: DataFrame, share: float, factor: float) -> DataFrame:
    """One concentration step for every (group, start) of estimates.

    Distances are counted by fine bins of their logarithm, every row in one; sums over a group's bins, of which
    there are at most some ten thousand, tell the bin that completes the share.
    """
    binned = _measured(rows, estimates).withColumn("bin", F.floor(F.log(F.col("d2") + F.lit(1e-9)) * FINE))
    counts = binned.groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("c"))
    per = Window.partitionBy(*KEYS)
    counts = counts.withColumn("below", F.sum("c").over(per.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).withColumn("all", F.sum("c").over(per))
    last = counts.filter(F.col("below") < F.ceil(F.lit(share) * F.col("all"))).groupBy(*KEYS).agg(F.max("bin").alias("last"))
    return _moments(split_join(binned, last, KEYS).filter("bin <= last"), factor)


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, g): a language's and source's own group if it has `least` rows that pass the base rule, else one with
    the language's other small ones, and if these have too few as well, one of all such. A row per source, never per document."""
    n = rows.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    small = n.withColumn("few", F.col("n") < least)
    small = small.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang", "few")))
    level = F.when(~F.col("few"), 0).when(F.col("of_lang") >= least, 1).otherwise(2)
    name = lambda c, most: F.when(level <= most, F.coalesce(F.concat(F.lit("="), c), F.lit("null"))).otherwise(F.lit("any"))
    return small.select("lang", "source", F.xxhash64(name(F.col("lang"), 1), name(F.col("source"), 0)).alias("g"))


def _step(x: np.ndarray, at: np.ndarray, factor: float, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and determinant's logarithm of the rows at."""
    some = x[at]
    off = some - some.mean(0)
    covariance = factor * (off.T @ off / len(some)) + target
    return some.mean(0), np.linalg.inv(covariance), float(np.linalg.slogdet(covariance)[1])


def screened(x: np.ndarray, share: float, factor: float, tries: int, best: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The best of many starts of one row more than statistics, each after three concentration steps over the rows of x."""
    n, p = x.shape
    target, h, rng = np.diag(np.array(list(FEATURES.values())) ** 2), math.ceil(share * n), np.random.default_rng(seed)
    found = []
    for _ in range(tries if n > p + 1 else 1):
        at = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(4):
            mean, inverse, spread = _step(x, at, factor, target)
            off = x - mean
            at = np.argpartition(((off @ inverse) * off).sum(1), h - 1)[:h]
        found.append((spread, mean, inverse))
    found.sort(key=lambda f: f[0])
    return [(mean, inverse, spread) for spread, mean, inverse in found[:best]]


def fitted(rows: DataFrame, share: float = 0.75, tries: int = 200, best: int = 3, tolerance: float = 1e-4, seed: int = 1) -> DataFrame:
    """(g, start, mean, inverse, spread): each group's minimum-covariance-determinant estimates from rows (doc_id, g, FEATURES).

    As in FAST-MCD, `tries` starts are screened on rows drawn from each group (about DRAWN, by hash; all of a smaller one), as one
    start in some tens is free of outliers. The `best` of them, of least determinant, then take steps over all
    rows, and after two a group goes on from the least until its determinant falls by less than tolerance, which must come
    as the target bounds it from below. Reruns agree.
    """
    factor, names = consistency(share, len(FEATURES)), list(FEATURES)
    counts = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    key = F.xxhash64(F.lit(seed), "doc_id", *FEATURES)
    drawn = F.pmod(key, F.lit(1 << 40)) < F.lit(float(1 << 40)) * DRAWN / F.col("n")
    sample = split_join(rows, counts, ["g"], "inner").filter(drawn).select("g", key.alias("key"), *names)

    def screen(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(["key", *names])[names].to_numpy()
        found = screened(x, share, factor, tries, best, seed)
        return pd.DataFrame({"g": part["g"].iloc[0], "start": range(len(found)), "mean": [f[0].tolist() for f in found], "inverse": [f[1].ravel().tolist() for f in found], "spread": [f[2] for f in found]})

    now = cut(sample.groupBy("g").applyInPandas(screen, FITTED))
    for _ in range(2):
        now = cut(_concentrated(rows, now, share, factor))
    least = now.groupBy("g").agg(F.min_by("start", F.struct("spread", "start")).alias("start"))
    active = cut(split_join(now, least, KEYS, "left_semi"))
    settled = []
    while not active.isEmpty():
        after = _concentrated(rows, active, share, factor)
        both = cut(split_join(active, after.select("g", "start", F.struct("mean", "inverse", "spread").alias("new")), KEYS))
        falls = F.col("new.spread") < F.col("spread") - tolerance
        settled.append(both.filter(~F.coalesce(falls, F.lit(False))).drop("new"))
        active = both.filter(falls).select("g", "start", "new.mean", "new.inverse", "new.spread")
    out = settled[0] if settled else active
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: float = 1e-5, share: float = 0.75, least: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A row that fails the base rule (fewer than 50 words, or over half of them in repeated 3-word windows) goes;
    so does one whose squared distance from its group's estimates is above the quantile that the chi-square law passes with
    probability `tail`. That is far out, as rates of whole texts have heavier tails than the normal law. The estimates
    are the minimum-determinant ones, reweighted once by the 0.975 quantile as usual. Rows that failed the base rule don't
    enter them. A group is a language and source, null being one of each; those with fewer than `least` passing rows are put
    together, by language, then all. A null or empty text has no words and fails; repeated rows are judged alike; very long texts are
    counted whole; a group whose rows all failed has no estimates and keeps nothing else to judge; an empty table gives an empty result.
    """
    p = len(FEATURES)
    rows = cut(with_statistics(docs, id_col, text_col))
    named = split_join(rows, cut(_groups(rows, least)), ["lang", "source"])
    good = cut(named.filter(~F.col("base_failed")).select("doc_id", "g", *FEATURES))
    inner = _measured(good, cut(fitted(good, share))).filter(F.col("d2") <= chi_square_quantile(0.975, p))
    estimates = cut(_moments(inner, consistency(0.975, p)))
    out = _measured(named, estimates, "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi_square_quantile(1 - tail, p), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
