"""Place policy by pinned places, counters' words and forced verdicts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators.policy import Policy, bare_city, coded, country_of, fetched, fold, forced, movement, place_policy, region_of, sure, workplace_of

PLACES = "array<struct<city:string,region_code:string,country_code:string,kind:string,unresolved:boolean>>"
BAY = Policy(home="US", region="CA", primary="san francisco", metro=("oakland",))


def place(city=None, region=None, country=None, kind=None, unresolved=False):
    return (city, region, country, kind, unresolved)


@pytest.mark.parametrize("places, kind, country, policy, want", [
    ([place("San Francisco, CA", "CA", "US", "HYBRID")], None, None, BAY, ("eligible", "primary", 4, 2, 4)),
    ([place("San Francisco", "CA", "US", "onsite")], None, None, BAY, ("eligible", "primary", 2, 2, 2)),
    ([place("Oakland CA 94607", "CA", "US", "hybrid")], None, None, BAY, ("eligible", "metro", 3, 2, 3)),
    ([place("Oakland", "ca", "us", "onsite")], None, None, BAY, ("eligible", "metro", 1, 2, 2)),
    ([place("Austin", "TX", "US", "onsite")], None, None, BAY, ("ineligible", "outside_target", 0, 0, 1)),
    ([place("Austin", None, "US", "onsite")], None, None, BAY, ("unknown", "unknown", 0, 1, None)),
    ([place("Austin", "TX", "US", "onsite"), place(country="US", kind="remote")], None, None, BAY, ("eligible", "remote", 5, 2, 5)),
    ([place(country="CA", kind="remote")], None, None, BAY, ("ineligible", "outside_target", 0, 0, 1)),
    ([place(country="CA", kind="remote")], None, None, Policy(), ("unknown", "unknown", 0, 1, None)),
    ([place(country="CA")], "remote", None, BAY, ("ineligible", "outside_target", 0, 0, 1)),
    ([place("Oakland", "CA", "US", "hybrid", True)], "REMOTE", "us", BAY, ("eligible", "remote", 5, 2, 5)),
    (None, "remote", None, BAY, ("unknown", "unknown", 0, 1, None)),
    ([], None, None, BAY, None),
])
def test_place_policy(spark, places, kind, country, policy, want):
    df = spark.createDataFrame([(places, kind, country)], f"p {PLACES}, kind string, country string")
    v = df.select(place_policy(F.col("p"), F.col("kind"), F.col("country"), policy).alias("v")).first()["v"]
    assert (None if v is None else (v["eligibility"], v["tier"], v["rank"], v["sort_order"], v["fit"])) == want


def test_bare_city(spark):
    cities = {"San Jose, CA 95112": "san jose", "Hoboken New Jersey": "hoboken", "Reno NV": "reno", "Charleston West Virginia": "charleston", "": "", "New York": "new york", None: None}
    df = spark.createDataFrame([(c,) for c in cities], "c string")
    assert {r.c: r.b for r in df.select("c", bare_city(F.col("c")).alias("b")).collect()} == cities


@pytest.mark.parametrize("name, delta, fresh, alone, want", [
    ("total_jobs", 4, 4, True, "improved_by_4"), ("total_jobs", -4, 0, True, "worsened_by_4"), ("scoring_backlog", -2, 0, True, "improved_by_2"), ("scoring_backlog", 2, 5, True, "worsened_by_2"),
    ("missing_jd_full", 3, 5, True, "pending_from_new_rows_3"), ("missing_jd_full", 7, 5, True, "worsened_by_2"), ("missing_jd_full", 7, 0, True, "worsened_by_7"),
    ("missing_jd_full", None, 5, True, "unchanged"), ("missing_jd_full", 0, 5, False, "not_attributable"),
])
def test_movement(spark, name, delta, fresh, alone, want):
    df = spark.createDataFrame([(delta, fresh, alone)], "d bigint, f bigint, a boolean")
    assert df.select(movement(name, F.col("d"), F.col("f"), F.col("a")).alias("m")).first().m == want


def test_forced(spark):
    cases = {("failed", None): "FAIL", ("orphaned", None): "ANOMALY", ("degraded", "x"): "ANOMALY", ("degraded", ""): None, ("degraded", None): None, ("ok", "x"): None}
    df = spark.createDataFrame(list(cases), "d string, e string")
    assert {(r.d, r.e): r.v for r in df.select("d", "e", forced(F.col("d"), F.col("e")).alias("v")).collect()} == cases


def test_fetched(spark):
    assert [r.id for r in fetched(spark.range(100), "id", 41, 3).collect()] == [42, 43, 44]


def mapped(spark, make, cases):
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.m for r in df.select("c", make(F.col("c")).alias("m")).collect()} == cases


def test_names_to_codes(spark):
    mapped(spark, country_of, {
        "United States": "US", "u.s.a.": "US", "U.K": "GB", "ca": "CA", "Remote (US)": "US", "New York, NY/Remote (us)": "US", "Remote (NY)": None, "Engineer (AI)": None, "XX": "XX", " Korea ": "KR", "U.A.E.": "AE", "Atlantis": None, "": None, None: None,
    })
    mapped(spark, region_of, {"California": "CA", "ca": "CA", "N.Y.": "NY", "District of Columbia": "DC", "d.c.": "DC", "Wyoming": "WY", "British Columbia": "BC", "ON": "ON", "ZZ": None, "Bavaria": None, "": None, None: None})
    mapped(spark, workplace_of, {"Remote": "remote", " On-site": "onsite", "on_site": "onsite", "HYBRID": "hybrid", "unspecified": None, "": None, None: None})


@pytest.mark.parametrize("place_, kind, country, want", [
    (("San Francisco", "California", "USA", None, None, "Hybrid", False), None, None, "hybrid in San Francisco, CA, US (primary target)"),
    (("Oakland", None, "United States", "ca", "", "unspecified", False), "on-site", None, "onsite in Oakland, CA, US (metro)"),
    (("Austin", "Texas", None, None, None, "onsite", False), None, None, "onsite in TX (outside target)"),
    (("Paris", None, "France", None, None, "onsite", False), None, None, "onsite in FR (outside target)"),
    (("Paris", None, "France", None, None, "remote", False), None, None, "remote in FR (not eligible)"),
    ((None, None, "Remote (US)", None, None, "remote", False), None, None, "remote in US (eligible)"),
    ((None, None, None, None, None, "remote", False), None, None, "remote with no country information"),
    ((None, "California", "US", None, None, "onsite", False), None, None, "onsite with missing city"),
    (("Oakland", None, "US", None, None, "onsite", False), None, None, "onsite with insufficient location data"),
    (("Oakland", "California", "US", None, None, None, False), None, None, "unspecified workplace type for Oakland"),
    (("Oakland", "California", "US", None, None, None, True), "", "", "no location data available"),
])
def test_reasons(spark, place_, kind, country, want):
    kinds = "p array<struct<city:string,region:string,country:string,region_code:string,country_code:string,kind:string,unresolved:boolean>>, kind string, country string"
    df = spark.createDataFrame([([place_], kind, country)], kinds)
    assert df.select(sure(place_policy(coded(F.col("p")), F.col("kind"), F.col("country"), BAY)).alias("v")).first()["v"]["reason"] == want


def test_fold_takes_the_best_posting_and_the_first_of_equals(spark):
    rows = [(1, 9, [place("Oakland", "CA", "US", "onsite")]), (1, 4, [place("Austin", "TX", "US", "onsite")]), (1, 7, [place("Oakland", "CA", "US", "onsite")]), (2, 3, []), (2, 1, [place("Austin", "TX", "US", "onsite")])]
    df = spark.createDataFrame(rows, f"job int, at int, p {PLACES}")
    none = F.lit(None).cast("string")
    v = df.select("job", "at", sure(place_policy(F.col("p"), none, none, BAY)).alias("v")).groupBy("job").agg(fold(F.col("v"), F.col("at")).alias("b"))
    assert {r.job: (-r.b.back, r.b.verdict.reason) for r in v.collect()} == {1: (7, "onsite in Oakland, CA, US (metro)"), 2: (3, "no location data available")}
