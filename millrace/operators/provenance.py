"""Provenance classes of postings and what is published of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.projections import LISTINGS, POSTINGS, listings, postings

# The label vocabularies.
CONFIRMED = ("Greenhouse", "Workday", "Lever", "Ashby", "SmartRecruiters", "Workable", "iCIMS", "Rippling", "Amazon", "Google", "Microsoft")
EMAIL = ("glassdoor", "greenhouse", "indeed", "indeed_match", "jobright", "linkedin", "monster", "trueup", "ziprecruiter")
CRAWL = ("careers_crawl", "careers_page")
AGGREGATORS = ("dataforseo", "serpapi", "thordata")
AGGREGATOR_PREFIX = "portal_"
META = ("manual", "off_platform_email", "primary_source_llm")
STATUSES = ("live", "expired", "inconclusive", "null")
LARGEST_AGGREGATOR = "portal_jooble"


def provenance(sources: Column, exclude: str | None = None) -> Column:
    """The class of an array of tags; meta tags and the excluded one don't count."""
    real = F.filter(sources, lambda s: ~s.isin(*META) & (F.lit(exclude is None) | (s != F.lit(exclude or ""))))
    return (
        F.when(F.coalesce(F.size(real), F.lit(0)) <= 0, "unattributed")
        .when(F.exists(real, lambda s: s.isin(*CONFIRMED)), "ats_confirmed")
        .when(F.exists(real, lambda s: s.isin(*CRAWL)), "direct_crawl")
        .when(F.exists(real, lambda s: s.startswith(AGGREGATOR_PREFIX) | s.isin(*AGGREGATORS)), "aggregator_only")
        .when(F.exists(real, lambda s: s.isin(*EMAIL)), "email_alert_only")
        .otherwise("unrecognized")
    )


def attributed(rows: DataFrame, exclude: str | None = None) -> DataFrame:
    return rows.withColumn("bucket", provenance(F.col("sources"), exclude)).filter(~F.col("bucket").isin("unattributed", "unrecognized"))


def class_rollup(rows: DataFrame, stale: Column | None = None) -> DataFrame:
    """Counts and rates per class and over all, in one pass by rollup; every status has its columns."""
    stale = F.col("is_stale") if stale is None else stale
    status = F.coalesce("expiry_status", F.lit("null"))
    n = F.count(F.lit(1))
    per_status = [e for s in STATUSES for e in (F.count_if(status == s).alias(f"{s}_n"), F.round(F.count_if(status == s) / n, 6).alias(f"{s}_rate"))]
    return (
        rows.withColumn("_stale", stale)
        .rollup("bucket")
        .agg(F.grouping("bucket").alias("_all"), n.alias("n"), F.count_if("_stale").alias("stale_n"), F.round(F.count_if("_stale") / n, 6).alias("stale_rate"), F.round(F.count_if("has_text") / n, 6).alias("has_text_rate"), F.round(F.count_if("is_scored") / n, 6).alias("scored_rate"), *per_status)
        .withColumn("bucket", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("bucket")))
        .drop("_all")
    )


def headline_ratio(rows: DataFrame, over: str = "aggregator_only", under: str = "ats_confirmed") -> DataFrame:
    """One class's stale rate over another's; null where either is undefined or the lower is 0."""
    rate = lambda b: F.avg(F.when(F.col("bucket") == b, F.col("is_stale").cast("int")))
    return rows.agg(rate(over).alias("over_rate"), rate(under).alias("under_rate")).select(F.round("over_rate", 6).alias("over_rate"), F.round("under_rate", 6).alias("under_rate"), F.round(F.try_divide("over_rate", F.nullif("under_rate", F.lit(0.0))), 6).alias("ratio"))


def q_c01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).select("doc_id", provenance(F.col("sources")).alias("bucket"), provenance(F.col("sources"), LARGEST_AGGREGATOR).alias("without_largest"))


def q_a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_rollup(attributed(postings(spark, sf_dir)))


def q_a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headline_ratio(attributed(postings(spark, sf_dir)))


def q_a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary result and two variants: the largest aggregator's tag dropped before classifying; stale or expired."""
    rows = postings(spark, sf_dir)
    variants = {"primary": class_rollup(attributed(rows)), "no_largest": class_rollup(attributed(rows, LARGEST_AGGREGATOR)), "effective": class_rollup(attributed(rows), F.col("is_stale") | F.coalesce(F.col("expiry_status") == "expired", F.lit(False)))}
    out = None
    for name, df in variants.items():
        df = df.withColumn("variant", F.lit(name)).select("variant", "bucket", "n", "stale_n", "stale_rate")
        out = df if out is None else out.unionByName(df)
    return out


def q_a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions in one pass: disjoint ones for classes, overlapping ones for lifespans, and what is left."""
    bucket = provenance(F.col("sources"))
    a = postings(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(bucket == "unattributed").alias("unattributed"), F.count_if(bucket == "unrecognized").alias("unrecognized"))
    b = listings(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if(F.col("last_seen") < F.col("first_seen")).alias("negative_window"),
        F.count_if(F.col("first_seen") < F.lit("1995-01-01").cast("timestamp_ntz")).alias("too_early"),
        F.count_if((F.col("last_seen") < F.col("first_seen")) & (F.col("first_seen") < F.lit("1995-01-01").cast("timestamp_ntz"))).alias("both"),
    )
    return a.crossJoin(b).withColumn("usable", F.col("total") - F.col("unattributed") - F.col("unrecognized")).withColumn("usable_listings", F.col("listings") - F.col("negative_window") - F.col("too_early") + F.col("both"))


def _class(exclude: str = "") -> str:
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    real = f"list_filter(sources, lambda s: s not in ({listed(META)}) and s <> '{exclude}')"
    anyof = lambda test: f"len(list_filter({real}, lambda s: {test})) > 0"
    return f"""case when len({real}) = 0 then 'unattributed'
      when {anyof(f"s in ({listed(CONFIRMED)})")} then 'ats_confirmed'
      when {anyof(f"s in ({listed(CRAWL)})")} then 'direct_crawl'
      when {anyof(f"starts_with(s, '{AGGREGATOR_PREFIX}') or s in ({listed(AGGREGATORS)})")} then 'aggregator_only'
      when {anyof(f"s in ({listed(EMAIL)})")} then 'email_alert_only' else 'unrecognized' end"""


def _rollup(stale: str = "is_stale", exclude: str = "") -> str:
    per = ", ".join(f"count(*) filter (coalesce(expiry_status, 'null') = '{s}') as {s}_n, round(count(*) filter (coalesce(expiry_status, 'null') = '{s}') / count(*), 6) as {s}_rate" for s in STATUSES)
    return f"""select case when grouping(bucket) = 1 then 'ALL' else bucket end as bucket, count(*) as n,
    count(*) filter ({stale}) as stale_n, round(count(*) filter ({stale}) / count(*), 6) as stale_rate,
    round(count(*) filter (has_text) / count(*), 6) as has_text_rate, round(count(*) filter (is_scored) / count(*), 6) as scored_rate, {per}
  from (select *, {_class(exclude)} as bucket from postings) where bucket not in ('unattributed', 'unrecognized') group by rollup (bucket)"""


_EFFECTIVE = "(is_stale or coalesce(expiry_status = 'expired', false))"
QUERIES = {"C01_provenance": q_c01, "A01_class_rollup": q_a01, "A02_headline_ratio": q_a02, "A03_variants": q_a03, "A04_exclusions": q_a04}
ORACLES = {
    "C01_provenance": f"with {POSTINGS} select doc_id, {_class()} as bucket, {_class(LARGEST_AGGREGATOR)} as without_largest from postings",
    "A01_class_rollup": f"with {POSTINGS} {_rollup()}",
    "A02_headline_ratio": f"""with {POSTINGS}, c as (select *, {_class()} as bucket from postings),
r as (select avg(is_stale::int) filter (bucket = 'aggregator_only') as o, avg(is_stale::int) filter (bucket = 'ats_confirmed') as u from c)
select round(o, 6) as over_rate, round(u, 6) as under_rate, round(o / nullif(u, 0.0), 6) as ratio from r""",
    "A03_variants": f"with {POSTINGS} "
    + " union all ".join(f"select '{v}' as variant, bucket, n, stale_n, stale_rate from ({q})" for v, q in (("primary", _rollup()), ("no_largest", _rollup(exclude=LARGEST_AGGREGATOR)), ("effective", _rollup(_EFFECTIVE)))),
    "A04_exclusions": f"""with {POSTINGS}, {LISTINGS},
a as (select count(*) as total, count(*) filter ({_class()} = 'unattributed') as unattributed, count(*) filter ({_class()} = 'unrecognized') as unrecognized from postings),
b as (select count(*) as listings, count(*) filter (last_seen < first_seen) as negative_window, count(*) filter (first_seen < timestamp '1995-01-01') as too_early,
  count(*) filter (last_seen < first_seen and first_seen < timestamp '1995-01-01') as both from listings)
select *, total - unattributed - unrecognized as usable, listings - negative_window - too_early + "both" as usable_listings from a, b""",
}
