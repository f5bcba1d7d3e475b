import pytest
from pyspark.sql import functions as F

from millrace.functions import names, pay


def column(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_company_keys(spark):
    pairs = [("Klaviyo Inc.", "Klaviyo"), ("Intuit, Inc.", "Intuit"), ("Google LLC", "Google"), ("Acme Holdings, Inc.", "acme"), ("A &amp; B <b>Corp</b>", "a & b")]
    flat = column(spark, [x for p in pairs for x in p], names.company_key)
    assert flat[::2] == flat[1::2]


def test_title_keys(spark):
    pairs = [("Sr. Software Engineer", "Senior Software Engineer"), ("Staff Engineer (IC5)", "Staff Engineer"), ("Engineer Level 3", "Engineer"), ("Eng. Mgr.", "Engineering Manager"), ("84Data Scientist Jobs", "84 Data Scientist Jobs")]
    flat = column(spark, [x for p in pairs for x in p], names.title_key)
    assert flat[::2] == flat[1::2]


@pytest.mark.parametrize(
    "text, low, high, period, resolution, annual",
    [
        ("$120K - $150K", 120000, 150000, "unknown", "ok", (120000, 150000)),
        ("$120 - $150", 120000, 150000, "unknown", "ok", (120000, 150000)),
        ("$42 - $51 an hour", 42, 51, "hourly", "salvaged_hourly", (87360, 106080)),
        ("$1.5M - $2M", 1.5e6, 2e6, "unknown", "ok", (1500000, 2000000)),
        ("8000 - 10000 per month", 8000, 10000, "monthly", "salvaged_monthly", (96000, 120000)),
        ("2000 - 3000 weekly", 2000, 3000, "weekly", "salvaged_weekly", (104000, 156000)),
    ],
)
def test_pay_ladder(spark, text, low, high, period, resolution, annual):
    o = column(spark, [text], lambda c: pay.observed(c, "feed_string"))[0]
    assert (o.min_value, o.max_value, o.period) == (low, high, period)
    df = spark.createDataFrame([(o.min_value, o.max_value, o.period, o.provenance)], "a double, b double, p string, v string")
    r = df.select(pay.resolved(F.col("a"), F.col("b"), F.col("p"), F.col("v")).alias("r")).first().r
    assert (r.salary_min, r.salary_max, r.resolution) == (*annual, resolution)


def test_pay_without_a_range(spark):
    assert column(spark, ["starting at $120K", None], lambda c: pay.observed(c, "x")) == [None, None]


def test_vendor_words(spark):
    cases = {"per-year-salary": "annual", "1 YEAR": "annual", "Semiannual": "annual", "Hourly": "hourly", "month": "monthly", "WEEK": "weekly", "per day": "daily", "shift": "unknown", "": "unknown", None: "unknown"}
    assert column(spark, list(cases), pay.interval_period) == list(cases.values())
    cases = {"usd": "USD", " gbp ": "GBP", "CHF": "USD", "unknown": "UNKNOWN", "": "USD", None: "USD"}
    assert column(spark, list(cases), pay.column_currency) == list(cases.values())


@pytest.mark.parametrize("low, high, interval, want", [
    (120000.0, 150000.0, "1 YEAR", (120000, 150000, "annual", "ok")), (42.0, 51.0, "hour", (87360, 106080, "hourly", "salvaged_hourly")), (2000.0, 3000.0, "week", (104000, 156000, "unknown", "salvaged_weekly")),
    (3.0, 4.0, "year", (None, None, None, "implausible")), (12000000.0, 15000000.0, None, (120000, 150000, "unknown", "salvaged_cents")), (None, 90000.0, "", (None, 90000, "unknown", "ok")), (None, None, "year", None),
])
def test_captured_columns(spark, low, high, interval, want):
    df = spark.createDataFrame([(low, high, interval)], "low double, high double, i string")
    df = df.withColumn("o", pay.vendor_observation(F.col("low"), F.col("high"), F.col("i"), F.lit("eur")))
    r = pay.with_captured(df, "o", F.lit("raw")).first()
    if want is None:
        assert [r[k] for k in r.asDict() if k.startswith("salary_")] == [None] * 6
        return
    seen = r.salary_observations[0]
    assert (r.salary_min, r.salary_max, r.salary_period, seen.resolution) == want
    assert (r.salary_currency, r.salary_provenance, seen.raw_text, seen.min_value, seen.max_value) == ("EUR", "ats_structured", "raw", low, high)
