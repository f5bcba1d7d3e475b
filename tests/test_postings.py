"""Rules on single postings, on the cases that pin them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from millrace.operators import postings


def told(spark, expression, texts):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(expression(F.col("t")).alias("x")).collect()]


TILES = {
    "84 Data Scientist Jobs": True, "1,200+ openings": True, "12 results": True, "  3 open  roles ": True, "See all jobs": False, "100 Women in Finance — Analyst": False, "3D Artist": False, "5G Network Engineer": False, "Jobs Data Analyst": False, "84Data Jobs": False, "Openings": False, "7": False, "": False, None: False,
}
BLOBS = {
    "SQL2354308|Chennai, Tamil Nadu": True, "$120,000": True, "x" * 141: True, "x" * 140: False, "Job TitleTech Lead AnalystPost levelNPSA-9Apply byApr-29-26AgencyUNDP": True, "Data Scientist Posted 10 days ago": True, "Remote Full-time Hybrid Engineer": False, "Senior Data Scientist": False, "R123|chennai": False,
    "Key Responsibilities": True, "Description of works": True, "": False, None: False,
}


def test_tiles_and_blobs(spark):
    assert told(spark, postings.is_listing_tile, TILES) == list(TILES.values())
    assert told(spark, postings.is_metadata_blob, BLOBS) == list(BLOBS.values())


MATCHES = [
    ("Lead, Advanced Analytics", "Analytics Lead", True), ("Staff Product Analyst", "Lead Product Analyst", False), ("Analyst Senior, TPO Operations", "Senior Analyst", True), ("Senior Data Platform", "Data Scientist", False), ("Especialista em Data Analytics", "Analytics Manager", False),
    ("Senior Engineer - Da Nang", "Senior Data Analyst", False), ("Doradca ds. Produktów", "Data Scientist", False), ("EM, Platform Team", "Engineering Manager", True), ("DA, Marketing", "Data Analyst", True), ("DS, Growth", "Data Scientist", True), ("Em Data Analytics We Trust", "Analytics Manager", False),
    ("Sr. DS (Remote)", "Senior Data Scientist", True), ("Senior Data Scientist", "sr DS", True), ("Database Lead", "Data", False), ("VP/Dir. of Ops", "Vice President Operations", True), ("Anything", "!!", False),
]


def test_title_matches(spark):
    titles = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MATCHES)] + [(99, None)], "id int, title string")
    targets = spark.createDataFrame([(m[1],) for m in MATCHES], "target string")
    found = {(r.id, r.target) for r in postings.matched_titles(titles, targets).collect()}
    assert [(i, m[1]) in found for i, m in enumerate(MATCHES)] == [m[2] for m in MATCHES]
    again = told(spark, lambda t: postings.match_title(t), ["Sr. DS – Ops", "senior data scientist operations"])
    assert again[0] == again[1] == "senior data scientist operations"


def test_quality(spark):
    shape = " What you'll do: things."
    body = lambda n, salt="": " ".join(f"{salt}word{i}" for i in range(n))
    rows = [
        (1, "a", 9, body(196, "p") + shape), (2, "b", 9, body(1200, "q")), (3, "c", 9, body(1201, "r")), (4, "d", 9, body(199, "s")), (5, "e", 9, None), (6, "f", 9, "one two"), (7, "f", 8, "one two"), (8, "g", 5, body(200, "t")), (9, "g", 5, body(200, "t")), (10, None, 1, body(200, "t")), (11, "h", 1, "   "),
        *[(20 + i, "k", 10 + i, body(10, f"k{i}")) for i in range(6)], (30, "k", 1, body(10, "k0")), (31, "k", 50, body(10, "k5")),
    ]
    got = {r.id: r.quality for r in postings.with_quality(spark.createDataFrame(rows, "id int, company string, seen int, text string")).collect()}
    assert {k: got[k] for k in range(1, 12)} == {1: 1.0, 2: 0.6, 3: 0.4, 4: 0.4, 5: 0.0, 6: 0.2, 7: 0.2, 8: 0.4, 9: 0.4, 10: 0.6, 11: 0.4}
    assert got[30] == 0.4 and got[31] == got[25] == 0.2  # only the five latest others count: k0's twin is too old, k5's isn't


LEVELS = {"Senior Cook": True, "Cook Sr.": True, "Team Leader": False, "Lead Cook": True, "Lead Generation Clerk": False, "lead gen and lead cook": True, "Entry-Level Cook": True, "Level 3": True, "Level 0": False, "International": False, "Head of Cooks": True, "": False, None: False}


def test_seniority(spark):
    assert told(spark, postings.states_seniority, LEVELS) == list(LEVELS.values())


PAYLOADS = [
    ("posting_impression", {"surface": "feed"}, None), ("posting_impression", None, None), ("posting_impression", {"surface": None}, None), ("posting_saved", {"x": 1}, "key"), ("crash", {}, "unknown_kind"), (None, {}, "unknown_kind"), ("user_exit_surveyed", {"exit_reason": "hired"}, None),
    ("user_exit_surveyed", {"exit_reason": "bored"}, "not_in_list"), ("user_exit_surveyed", {"exit_reason": None}, "not_in_list"), ("user_exit_surveyed", {}, None), ("posting_impression", {"surface": "x" * 201}, "too_long"), ("posting_impression", {"surface": "x" * 200}, None),
    ("posting_impression", {"surface": {"a": 1}}, "no_scalar"), ("posting_impression", {"surface": "{not nested}"}, None), ("consent_recorded", {"granted": True, "consent_version": 2}, None), ("user_signed_up", {"referrer_url": "x.example"}, "key"),
]


def test_payloads(spark):
    rows = spark.createDataFrame([(i, k, None if p is None else json.dumps(p)) for i, (k, p, _) in enumerate(PAYLOADS)], "i int, k string, p string")
    assert [r.x for r in rows.orderBy("i").select(postings.payload_fault(F.col("k"), F.col("p")).alias("x")).collect()] == [w for *_, w in PAYLOADS]
    turned = spark.createDataFrame([("user_signed_up", '{"referrer_url":"x.example","wave":"2"}'), ("posting_saved", '{"referrer_url":"x"}'), ("user_signed_up", '{"wave":"2"}'), ("user_signed_up", None)], "k string, p string")
    got = [r.x for r in turned.select(postings.renamed_payload(F.col("k"), F.col("p")).alias("x")).collect()]
    assert json.loads(got[0]) == {"referrer_host": "x.example", "wave": "2"} and got[1:] == ['{"referrer_url":"x"}', '{"wave":"2"}', None]


def test_apply_address(spark):
    rows = [(1, ["", None, "https://A.example/x"], [("https://b.example",)]), (2, [], [("",), ("http://B.example:80/y",)]), (3, None, None), (4, ["nonsense"], [("https://b.example",)]), (5, ["https://" + "h" * 300 + ".example/"], None)]
    df = spark.createDataFrame(rows, "i int, own array<string>, seen array<struct<source_url:string>>").orderBy("i")
    url = postings.apply_url(F.col("own"), F.col("seen"))
    got = df.select(url.alias("u"), postings.apply_destination(url).alias("d")).collect()
    assert [r.u for r in got[:4]] == ["https://A.example/x", "http://B.example:80/y", None, "nonsense"]
    assert [r.d for r in got[:4]] == ["a.example", "b.example", None, None] and len(got[4].d) == 200


def test_due_for_pages(spark):
    rows = [("a", "miss", None, "h", True), ("b", "error", None, "h", True), ("c", "hit", "jobvite", "h", True), ("d", "hit", "lever", "h", True), ("e", "miss", None, None, True), ("f", "miss", None, "h", False), ("g", None, "taleo", "h", True), ("h", "hit", None, "h", True)]
    df = spark.createDataFrame(rows, "name string, probe string, platform string, homepage string, enabled boolean")
    assert {r.name for r in postings.due_for_pages(df).collect()} == {"a", "b", "c"}
    assert {r.name for r in postings.due_for_pages(df, ["b", "d"]).collect()} == {"b"}


def test_direct_platforms(spark):
    assert told(spark, postings.is_direct_platform, ["ashby", "amazon", "jobvite", "taleo", "tesla", "", None]) == [True, False, False, False, True, False, False]


def test_primary_records(spark):
    rows = spark.createDataFrame([("k1", "T", "C", 1, "Oslo", None, None), ("k2", "T", "C", 1, None, "p9", ["r"]), ("k3", "T", "C", None, "", "", None), ("k4", "T", "C", 2, "Oslo", "p7", None), ("k5", "T", "C", 2, "x", "", None), ("k6", "T", "C", 2, "x", None, None)], "key string, title string, company string, company_id long, location string, source_id string, reasons array<string>")
    kind = "key string, location string, source_id string, platform string, label string, tag string, url string, salary_min double, salary_max double, period string, currency string, raw string, description string, posted date"
    found = [("k1", "", "p9", "lever", "Lever", None, "u", 1.0, None, None, "", None, "", None), ("k2", "Bonn", "p9", "lever", "", "tag", "", None, None, None, None, None, "d", None), ("k3", None, "p1", "lever", None, None, None, None, 2.0, "annual", "EUR", "raw", None, None), ("k4", "", "p8", "lever", None, None, None, None, None, None, None, None, None, None), ("k5", "", "p8", "lever", None, None, None, None, None, None, None, None, None, None), ("k6", "", "p7", "", None, None, None, None, None, None, None, None, None, None)]
    got = {r.key: r for r in postings.primary_records(rows, spark.createDataFrame(found, kind)).collect()}
    assert {k: (r.source_id, r.platform, r.location) for k, r in got.items()} == {"k1": (None, None, "Oslo"), "k2": ("p9", "lever", "Bonn"), "k3": (None, None, ""), "k4": (None, None, "Oslo"), "k5": ("p8", "lever", "x"), "k6": (None, None, "x")}
    assert got["k1"].observations[0].asDict() == {"min_value": 1.0, "max_value": None, "period": "unknown", "currency": "USD", "provenance": "ats_structured", "raw_text": None} and got["k2"].observations == [] and got["k3"].currency == "EUR"
    assert got["k2"].sources == ["tag"] and got["k2"].source_urls == [] and got["k2"].reasons == ["r"] and got["k1"].description is None


def test_enrichment(spark):
    kind = "i int, tier string, reasons string, observations array<struct<min_value:double,max_value:double,period:string,currency:string,provenance:string>>, text string, outcome string, new_tier string, new_text string, low double, high double, provenance string, reason string, adds boolean"
    seen = [(1.0, 2.0, "unknown", "USD", "p")]
    rows = [(1, None, '["a"]', seen, "old", "ok", "free", "new", 1.0, 2.0, "p", "b", True), (2, "x", '["a","b"]', None, "old", "ok", "free", None, 3.0, None, "p", "a", False), (3, "x", "bad", seen, "old", "locked", "free", "new", 9.0, 9.0, "p", "b", True), (4, "x", '["a"]', seen, "old", "refused", "free", "new", 9.0, 9.0, "p", "a", False), (5, "x", '["a"]', seen, "old", "ok", "free", "new", None, None, "p", "a", True)]
    got = {r.i: (r.tier, r.text, r.reasons, len(r.observations)) for r in postings.enriched(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ("free", "new", ["a", "b"], 1), 2: ("free", "old", ["b"], 1), 3: ("x", "old", [], 1), 4: ("free", "old", ["a"], 1), 5: ("free", "new", ["a"], 1)}
