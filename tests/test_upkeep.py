from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.operators import upkeep


def column(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_slugs(spark):
    assert column(spark, ["Acme Widget Works, Inc.", "Acme"], upkeep.slugs) == [["acmewidgetworks", "acme-widget-works", "acme"], ["acme"]]


def test_clean_titles(spark):
    rows = ["Data Engineer (Req #12345)", "Analyst - Remote", "Cook Full-time", "R Data Scientist", "Plain Title"]
    assert column(spark, rows, upkeep.clean_title) == ["Data Engineer", "Analyst", "Cook", "Data Scientist", "Plain Title"]


def test_canonical_addresses(spark):
    pairs = [
        ("https://example.com/job?utm_source=foo&id=42", "https://example.com/job?id=42"), ("https://e.com/x?gh_jid=1&fbclid=2&refId=3&trk=4&lipi=5&ref=6&_hsenc=7&_hsmi=8&keep=ok", "https://e.com/x?gh_jid=1&keep=ok"),
        ("https://e.com/job?b=2&a=1", "https://e.com/job?a=1&b=2"), ("HTTPS://Example.COM/Jobs/View/42?utm_term=x", "https://example.com/Jobs/View/42"), ("not an address", "not an address"), ("", ""),
    ]
    assert column(spark, [p[0] for p in pairs], urls.canonical) == [p[1] for p in pairs]


def test_first_platform_wins(spark):
    got = column(spark, ["https://api.lever.co/v0/postings/Acme", "https://boards.greenhouse.io/Acme/jobs/1", "https://x.org"], urls.platform)
    assert [tuple(g) if g else None for g in got] == [("lever", "acme", 10), ("greenhouse", "acme", 5), None]
