"""Right-censored survival of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.projections import LISTINGS, days_between, listings

GRID = (7, 14, 30, 60)
LEAST = 200


def product_limit(rows: DataFrame, grid: tuple[int, ...] = GRID, least: int = LEAST) -> DataFrame:
    """Product-limit estimates from (stratum, days, observed): one row per stratum of at least `least` rows, and ALL.

    Rows are first counted per stratum and time, so the windows run over distinct times only. Survival is the
    exponent of a running sum of logarithms; where all at risk go, it is 0 from there on. The median is infinite if never reached.
    """
    both = rows.withColumn("stratum", F.explode(F.array(F.col("stratum"), F.lit("ALL"))))
    times = both.groupBy("stratum", "days").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("observed").cast("int")).alias("d"))
    later = Window.partitionBy("stratum").orderBy(F.desc("days")).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("stratum").orderBy("days").rowsBetween(Window.unboundedPreceding, 0)
    times = times.withColumn("at_risk", F.sum("c").over(later))
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(F.lit(float("-inf")))
    times = times.withColumn("s", F.exp(F.sum(step).over(upto)))
    at = [F.round(F.coalesce(F.max_by("s", F.when(F.col("days") <= g, F.col("days"))), F.lit(1.0)), 6).alias(f"s{g}") for g in grid]
    out = times.groupBy("stratum").agg(F.sum("c").alias("n"), F.sum("d").alias("events"), F.coalesce(F.min(F.when(F.col("s") <= 0.5, F.col("days"))), F.lit(float("inf"))).alias("median_days"), *at)
    return out.filter((F.col("stratum") == "ALL") | (F.col("n") >= least))


def q_a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).filter("last_seen >= first_seen")
    return product_limit(rows.select("stratum", days_between(F.col("first_seen"), F.col("last_seen")).alias("days"), F.col("gone").alias("observed")))


QUERIES = {"A05_survival": q_a05}
ORACLES = {
    "A05_survival": f"""with {LISTINGS},
r as (select unnest([stratum, 'ALL']) as stratum, (epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000.0::double as days, gone::int as observed
  from listings where last_seen >= first_seen),
t as (select stratum, days, count(*) as c, sum(observed)::bigint as d from r group by all),
k as (select *, sum(c) over (partition by stratum order by days desc) as at_risk from t),
s as (select *, exp(sum(case when d < at_risk then ln(1 - d / at_risk) else '-inf'::double end) over (partition by stratum order by days)) as s from k)
select stratum, sum(c)::bigint as n, sum(d)::bigint as events, coalesce(min(days) filter (s <= 0.5), 'inf'::double) as median_days,
  {", ".join(f"round(coalesce(arg_max(s, days) filter (days <= {g}), 1.0), 6) as s{g}" for g in GRID)}
from s group by stratum having stratum = 'ALL' or sum(c) >= {LEAST}""",
}
