"""The given tables read as listings, companies, users, event logs and score rows.

Each projection exists as a DataFrame and as a SQL common table expression of the same columns, which the oracles use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression used in several places is else computed in each."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rounded(value: Column, places: int) -> Column:
    """A double rounded by scaling, halves away from zero. F.round rounds its shortest decimals instead, so the two part where a double lies just beside a half."""
    return F.round(value * F.lit(10.0**places), 0) / F.lit(10.0**places)


def days_between(start: Column, end: Column) -> Column:
    """Fractional days; both are zoneless timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing is an order line: first seen when ordered, last seen when shipped, gone when its status is F."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"),
        F.col("l_suppkey").alias("company_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("first_seen"),
        F.col("l_shipdate").alias("last_seen"),
        (F.col("l_linestatus") == "F").alias("gone"),
        F.col("o_orderstatus").alias("stratum"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("total"),
    )


LISTINGS = """listings as (
  select l_orderkey * 10 + l_linenumber as listing_id, l_suppkey as company_id, l_partkey as part_id, o_custkey as user_id,
    o_orderdate as first_seen, l_shipdate as last_seen, l_linestatus = 'F' as gone, o_orderstatus as stratum,
    l_returnflag as flag, l_extendedprice as price, l_quantity as quantity, l_discount as discount, l_tax as tax,
    o_orderpriority as priority, o_totalprice as total
  from lineitem join orders on l_orderkey = o_orderkey)"""

#: Axes of a score row, in the order that text snapshots keep.
AXES = ("title_fit", "location_fit", "comp_fit", "domain_match", "seniority_match", "skills_match")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows from order lines: six whole axes from 1 to 5 out of the line's numbers."""
    line = table(spark, sf_dir, "lineitem")
    n = lambda c, k: (F.pmod(F.floor(F.col(c) * k).cast("long"), F.lit(5)) + 1).cast("int")
    return line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"),
        F.col("l_suppkey").alias("company_id"),
        n("l_quantity", 1).alias("title_fit"),
        n("l_partkey", 1).alias("location_fit"),
        n("l_suppkey", 1).alias("comp_fit"),
        (F.pmod(F.col("l_orderkey"), F.lit(4)) + 2).cast("int").alias("domain_match"),
        (F.pmod(F.col("l_linenumber"), F.lit(3)) + 3).cast("int").alias("seniority_match"),
        (F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(5)) + 1).cast("int").alias("skills_match"),
        F.when(F.col("l_returnflag") == "R", F.lit("exhausted")).when(F.col("l_returnflag") == "A", F.lit("free")).alias("tier"),
        (F.col("l_quantity") * 60).cast("int").alias("text_length"),
        (F.pmod(F.col("l_orderkey"), F.lit(97)) == 0).alias("flagged"),
        F.col("l_shipdate").alias("scored_at"),
    )


SCORES = """scores as (
  select l_orderkey * 10 + l_linenumber as listing_id, l_suppkey as company_id,
    (floor(l_quantity)::bigint % 5 + 1)::int as title_fit, (l_partkey % 5 + 1)::int as location_fit,
    (l_suppkey % 5 + 1)::int as comp_fit, (l_orderkey % 4 + 2)::int as domain_match,
    (l_linenumber % 3 + 3)::int as seniority_match, ((l_orderkey + l_linenumber) % 5 + 1)::int as skills_match,
    case l_returnflag when 'R' then 'exhausted' when 'A' then 'free' end as tier,
    (l_quantity * 60)::int as text_length, l_orderkey % 97 = 0 as flagged, l_shipdate as scored_at
  from lineitem)"""

#: Labels that each document source stands for: the provenance vocabularies of the classifier.
SOURCE_LABELS = {
    "src0": "Greenhouse", "src1": "Workday", "src2": "careers_crawl", "src3": "portal_jooble", "src4": "dataforseo",
    "src5": "linkedin", "src6": "glassdoor", "src7": "Lever", "src8": "careers_page", "src9": "portal_adzuna",
    "src10": "indeed", "src11": "monster", "src12": "some_future_source", "src13": "manual", "src14": "serpapi",
    "src15": "Ashby", "src16": "trueup", "src17": "greenhouse", "src18": "thordata", "src19": "ziprecruiter",
}


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings with an array of source tags, a staleness flag and an expiry status."""
    docs = table(spark, sf_dir, "documents")
    label = F.element_at(F.create_map(*[F.lit(x) for pair in SOURCE_LABELS.items() for x in pair]), F.col("source"))
    more = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("primary_source_llm"))).when(F.col("doc_id") % 7 == 1, F.array(F.lit("portal_jooble"))).otherwise(F.array().cast("array<string>"))
    return docs.select(
        "doc_id",
        "source",
        F.concat(F.array(label), more).alias("sources"),
        (F.col("n_chars") % 4 == 0).alias("is_stale"),
        F.when(F.col("doc_id") % 5 == 0, "expired").when(F.col("doc_id") % 5 == 1, "live").when(F.col("doc_id") % 5 == 2, "inconclusive").alias("expiry_status"),
        (F.col("n_chars") >= 200).alias("has_text"),
        (F.col("doc_id") % 2 == 0).alias("is_scored"),
    )


POSTINGS = (
    "postings as (\n  select doc_id, source, [map {"
    + ", ".join(f"'{k}': '{v}'" for k, v in SOURCE_LABELS.items())
    + """}[source]] || case when doc_id % 3 = 0 then ['primary_source_llm'] when doc_id % 7 = 1 then ['portal_jooble'] else []::varchar[] end as sources,
    n_chars % 4 = 0 as is_stale,
    case doc_id % 5 when 0 then 'expired' when 1 then 'live' when 2 then 'inconclusive' end as expiry_status,
    n_chars >= 200 as has_text, doc_id % 2 = 0 as is_scored
  from documents)"""
)
