import random

from pyspark.sql import functions as F

from millrace.operators import cohorts, merges, survival


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_similar_titles_by_force(spark):
    rng = random.Random(3)
    words = "senior junior data engineer analyst remote east west team one two three".split()
    rows = sorted({(f"c{k % 2}", " ".join(rng.choices(words, k=rng.randint(1, 7)))) for k in range(120)})
    want = set()
    for c, a in rows:
        for d, b in rows:
            if c == d and a < b:
                x, y = a.split(), b.split()
                if lcs(x, y) >= 0.7 * max(len(x), len(y)):
                    want.add((c, a, b))
    got = cohorts.similar_titles(spark.createDataFrame(rows, "cohort string, title string")).collect()
    assert {(r.cohort, r.title_a, r.title_b) for r in got} == want


def test_packing(spark):
    sizes = [100, 350, 60, 10, 10, 10, 900, 5]
    out = spark.createDataFrame([(sizes,)], "s array<int>").select(cohorts.packed(F.col("s"), 3, 400).alias("b")).first().b
    assert out == [0, 1, 2, 2, 2, 3, 4, 5]


def test_places(spark):
    rows = spark.createDataFrame([("New  York; boston / BOSTON",), ("N/A",), (None,)], "t string")
    assert [r.p for r in rows.select(F.coalesce(cohorts.places(F.col("t")), F.array().cast("array<string>")).alias("p")).collect()] == [["New York", "boston"], [], []]


def test_survival_by_hand(spark):
    rows = spark.createDataFrame([("x", 10.0, True)] * 250 + [("small", 5.0, True)] * 50, "stratum string, days double, observed boolean")
    out = {r.stratum: r for r in survival.product_limit(rows).collect()}
    assert set(out) == {"x", "ALL"}
    assert (out["x"].median_days, out["x"].s7, out["x"].s14) == (10.0, 1.0, 0.0)
    assert out["ALL"].n == 300 and out["ALL"].s7 == round(250 / 300, 6)


def test_fold_equals_one_by_one(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        rank = rng.choice([None, 1, 2, 3])
        rows.append((rng.randint(0, 9), rng.choice("abc"), k, k, rng.choice([None, "x" * rng.randint(1, 9)]), rng.choice([None, float(k)]), None if rank is None else float(k), rank))
    df = spark.createDataFrame(rows, "key int, source string, s long, tie long, text string, pay double, posted double, rank int").withColumn("seen", F.timestamp_seconds("s"))
    want = {}
    for key, source, _, _, text, pay, posted, rank in rows:
        w = want.setdefault(key, {"sources": [], "text": None, "pay": None, "posted": None, "rank": 0})
        if source not in w["sources"]:
            w["sources"].append(source)
        if text and len(text) > len(w["text"] or ""):
            w["text"] = text
        if w["pay"] is None:
            w["pay"] = pay
        if (rank or 0) > w["rank"]:
            w["posted"], w["rank"] = posted, rank
    for r in merges.folded(df).collect():
        w = want[r.key]
        assert (r.sources, r.text, r.pay, r.posted, r["rank"] or 0) == (w["sources"], w["text"], w["pay"], w["posted"], w["rank"])
