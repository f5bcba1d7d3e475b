import pytest
from pyspark.sql import functions as F

from millrace.operators import content

LONG = "We build useful things for people who ship software every day. " * 6


@pytest.mark.parametrize(
    "text, want",
    [
        ("short", "truncated"), ("Just a moment... Page not found. " + LONG, "head_block"), ("1,200 engineering jobs in Oslo. " + LONG, "listing"), ("Page not found. " + LONG, "not_found"),
        ("Lorem ipsum is simply dummy text. " + LONG, "placeholder"), ("No results for your search. " + LONG, "no_results"), (LONG + " This job has closed", "expired"), (LONG * 2 + "Just a moment", "off_title"),
        ('{"theme": "' + "x" * 300 + '"}', "config_blob"), ("Wanted: a glassblower, furnace side. " + LONG, None),
    ],
)
def test_rejections_in_order(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(content.rejection(F.lit("Glassblower Furnace"), F.col("t")).alias("r")).first()
    assert row.r == want


@pytest.mark.parametrize(
    "places, arrangement, want",
    [
        ([("", None, "remote")], "on-site", 5), ([("", "US", "remote")], "on-site", 5), ([("", "DE", "remote")], "on-site", 1), ([("Boston", "US", "hybrid")], "remote", 4), ([("Bonn", "DE", "onsite")], "remote", 1),
        ([("Bonn", "DE", "onsite")], "on-site", 1), ([("Boston", "US", "onsite")], "on-site", 5), ([("Reno", "US", "onsite")], "on-site", None), ([], "on-site", None),
    ],
)
def test_place_fit(spark, places, arrangement, want):
    df = spark.createDataFrame([(places,)], "p array<struct<city: string, country: string, kind: string>>")
    assert df.select(content.place_fit(F.col("p"), ["Remote", "Boston"], "US", arrangement).alias("f")).first().f == want
