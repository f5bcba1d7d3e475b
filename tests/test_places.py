"""C07 on texts of every shape, over a small gazetteer."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import places

COUNTRIES = [("US", "USA", "United States", "United States of America"), ("GB", "GBR", "United Kingdom", None), ("FR", "FRA", "France", None), ("DE", "DEU", "Germany", None), ("CA", "CAN", "Canada", None), ("IN", "IND", "India", "Republic of India"), ("BR", "BRA", "Brazil", None), ("AU", "AUS", "Australia", None), ("RU", "RUS", "Russia", None)]
REGIONS = [("US", c, n) for c, n in (("CA", "California"), ("NY", "New York"), ("TX", "Texas"), ("IL", "Illinois"), ("MO", "Missouri"), ("WA", "Washington"), ("DE", "Delaware"), ("MA", "Massachusetts"))] + [("CA", "ON", "Ontario"), ("IN", "KA", "Karnataka"), ("GB", "MAN", "Manchester")]
CITIES = [
    (1, "San Francisco", [], "US", "CA", 870_000), (2, "New York City", ["New York", "NYC"], "US", "NY", 8_000_000), (3, "Springfield", [], "US", "MO", 167_000), (4, "Springfield", [], "US", "IL", 115_000), (5, "Springfield", [], "US", "MA", 155_000),
    (6, "Paris", [], "FR", "11", 2_100_000), (7, "Paris", [], "US", "TX", 25_000), (8, "London", [], "GB", "ENG", 9_000_000), (9, "London", [], "CA", "08", 380_000), (10, "Toronto", [], "CA", "08", 2_600_000), (11, "Bengaluru", ["Bangalore"], "IN", "19", 8_400_000),
    (12, "Manchester", [], "GB", "ENG", 500_000), (13, "Seattle", [], "US", "WA", 730_000), (14, "São Paulo", [], "BR", "27", 12_000_000), (15, "Sydney", [], "AU", "02", 5_000_000), (16, "Seattle", [], "GB", "ENG", 10),
]
CASES = {
    "San Francisco, CA": [("San Francisco", "CA", "US", "UNSPECIFIED", False)], "San Francisco, CA / Remote": [("San Francisco", "CA", "US", "REMOTE", False)], "San Francisco, CA / On site": [("San Francisco", "CA", "US", "ONSITE", False)],
    "Remote - US": [(None, None, "US", "REMOTE", False)], "Remote - DE": [(None, None, "DE", "REMOTE", False)], "Remote, EMEA": [(None, None, None, "REMOTE", True)], "Multiple Locations": [], "": [], "  ,  ,  ,  ": [], "-": [], "tbd": [],
    "New York, NY; San Francisco, CA": [("New York City", "NY", "US", "UNSPECIFIED", False), ("San Francisco", "CA", "US", "UNSPECIFIED", False)], "Bengaluru, KA, India": [("Bengaluru", "KA", "IN", "UNSPECIFIED", False)], "bangalore, ka, republic of india": [("Bengaluru", "KA", "IN", "UNSPECIFIED", False)],
    "London, UK or Remote": [("London", None, "GB", "UNSPECIFIED", False), (None, None, None, "REMOTE", True)], "Hybrid - Toronto, ON, Canada": [("Toronto", "ON", "CA", "HYBRID", False)], "Manchester, UK": [("Manchester", None, "GB", "UNSPECIFIED", False)],
    "Seattle, WA, USA": [("Seattle", "WA", "US", "UNSPECIFIED", False)], "Springfield, USA": [("Springfield", "MO", "US", "UNSPECIFIED", False)], "Springfield, IL": [("Springfield", "IL", "US", "UNSPECIFIED", False)], "Springfield": [("Springfield", "MO", "US", "UNSPECIFIED", False)],
    "Paris": [("Paris", "TX", "US", "UNSPECIFIED", False)], "Paris, France": [("Paris", None, "FR", "UNSPECIFIED", False)], "London": [("London", None, "GB", "UNSPECIFIED", False)], "Toronto, Canada": [("Toronto", None, "CA", "UNSPECIFIED", False)], "Springfield, TX": [("Springfield", "TX", "US", "UNSPECIFIED", False)],
    "San Francisco, CA; San Francisco, CA": [("San Francisco", "CA", "US", "UNSPECIFIED", False)], "zzqqzz, foobarbaz": [(None, None, None, "UNSPECIFIED", True)], "São Paulo, Brazil": [("São Paulo", None, "BR", "UNSPECIFIED", False)], "Москва, RU": [(None, None, "RU", "UNSPECIFIED", False)],
    "?!@#$%^&*()": [(None, None, None, "UNSPECIFIED", True)], "Remote / Remote / Remote": [(None, None, None, "REMOTE", True)], "Fully Remote": [(None, None, None, "REMOTE", True)], " / Remote": [(None, None, None, "REMOTE", True)], "CA": [(None, None, "CA", "UNSPECIFIED", False)],
    "Remote — Sydney, Australia": [("Sydney", None, "AU", "REMOTE", False)], "Toronto on-site or remote-only": [("Toronto", None, "CA", "ONSITE", False), (None, None, None, "REMOTE", True)],
}


@pytest.fixture(scope="module")
def known(spark):
    tables = spark.createDataFrame(COUNTRIES, "code string, code3 string, name string, official string"), spark.createDataFrame(REGIONS, "country_code string, code string, name string"), spark.createDataFrame(CITIES, "id int, name string, others array<string>, country_code string, region_code string, people long")
    return places.gazetteer(*tables), places.gazetteer(*tables, most_bytes=0)


def told(rows):
    return {r.k: [(p.city, p.region_code, p.country_code, p.workplace, p.unresolved) for p in r.places] for r in rows.collect()}


def test_texts(spark, known):
    rows = spark.createDataFrame(list(enumerate(CASES)), "k int, place string")
    for by in known:  # broadcast, and joined by key
        got = told(places.parsed_places(rows, by))
        assert {text: got[k] for k, text in enumerate(CASES)} == CASES


def test_names_and_raw(spark, known):
    rows = spark.createDataFrame([(1, "San Francisco, CA / Remote")], "k int, place string")
    p = places.parsed_places(rows, known[0]).first().places[0]
    assert (p.region, p.country, p.raw) == ("California", "United States", "San Francisco, CA")


def test_lists_bodies_and_nulls(spark, known):
    rows = spark.createDataFrame(
        [(1, ["San Francisco, CA", "TBD", None, "Toronto, ON, Canada"], None), (2, None, "#LI-Remote"), (3, [], "#LI-Remote"), (4, ["Sydney, Australia"], "#LI-Hybrid earlier, #LI-Remote later"), (5, ["Paris, France", "Remote"], "#li remote variation"), (6, ["Paris, France"], "#LI-Remoteness"), (7, ["New York, NY", "Springfield, IL / Hybrid"], "#LI-Onsite")],
        "k int, place array<string>, body string",
    )
    got = told(places.parsed_places(rows, known[0], body="body"))
    sf, toronto = CASES["San Francisco, CA"][0], ("Toronto", "ON", "CA", "UNSPECIFIED", False)
    assert got[1] == [sf, toronto] and got[2] == got[3] == []
    assert got[4][0][3] == "REMOTE" and [p[3] for p in got[5]] == ["REMOTE", "REMOTE"] and got[6][0][3] == "UNSPECIFIED" and [p[3] for p in got[7]] == ["HYBRID", "HYBRID"]


@pytest.mark.parametrize(("text", "want"), [("Remote — Austin, TX", "Austin, TX"), ("HYBRID, San Francisco, CA", "San Francisco, CA"), ("Hybrid/Chicago, IL", "Chicago, IL"), ("Fully Remote - Austin, TX", "Austin, TX"), ("New York, NY", "New York, NY"), ("remote-only", ""), ("in-office", ""), ("Remote/Hybrid — Austin, TX", "Hybrid — Austin, TX")])
def test_without_workplace(spark, text, want):
    assert spark.range(1).select(places.without_workplace(F.lit(text)).alias("x")).first().x == want
