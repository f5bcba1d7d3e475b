"""Pages that are no posting, and company keys, on single cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import names
from millrace.operators import content, parts

LONG = " We build machines that sort fruit, and look for people who like to travel, to test and to write down what they saw in the field." * 3


@pytest.mark.parametrize(
    "text, reason",
    [
        ("Page cannot be found." + LONG, "not_found"), ("Sorry, that page can't  be found" + LONG, "not_found"), ("HTTP 404" + LONG, "not_found"), ("404 people work here." + LONG, None), ("410 Gone" + LONG, "not_found"),
        (LONG + " The job you are trying to apply for has been filled", "expired"), (LONG + " This vacancy has been\nclosed.", "expired"), (LONG + " this role is no longer active", "expired"), (LONG + " This job has closed", "expired"),
        ("1,200 engineering jobs in Oslo" + LONG, "listing"), (LONG, None), ("short", "truncated"),
    ],
)
def test_rejections(spark, text, reason):
    row = spark.createDataFrame([("", text)], "title string, text string").select(content.rejection(F.col("title"), F.col("text")).alias("r")).first()
    assert row.r == reason


@pytest.mark.parametrize(
    "company, key",
    [
        ("HC1316 GE Precision Healthcare LLC", "ge precision healthcare"), ("USA016 Refinitiv US LLC", "refinitiv us"), ("1144 IHS GLOBAL INC", "ihs global"), ("A10 Networks, Inc", "a10 networks"), ("21 Tech", "tech"),
        ("Acme Group Services Solutions Tech Holdings Co. Ltd", "acme"), ("&#34;Caf&eacute;&#x22; &amp; Sons", '"café" & sons'), ("&nope; x", "&nope; x"), ("100", "100"),
    ],
)
def test_company_keys(spark, company, key):
    assert spark.createDataFrame([(company,)], "c string").select(names.company_key(F.col("c")).alias("k")).first().k == key


def test_acronyms(spark):
    rows = spark.createDataFrame([("AT&T", "we at A.T.T attend"), ("AT&T", "we attend"), ("C3 IoT", "by c3-iot"), ("The Corporate Group", "x"), (None, "x")], "c string, body string")
    got = rows.select(parts.acronym(F.col("c")).alias("a"), parts.acronym_in(parts.acronym(F.col("c")), F.col("body")).alias("in")).collect()
    assert [(r.a, r["in"]) for r in got] == [("att", True), ("att", False), ("c3iot", True), (None, False), (None, False)]
