"""Exact aggregates over listings, scores and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.projections import AXES, LISTINGS, POSTINGS, SCORES, days_between, listings, postings, scores, table

BANDS = ("apply", "consider", "low_signal", "reject", "skip")
COLD_START_DAYS = 30


def rate(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, null where the whole is 0."""
    return F.round(F.try_divide(part, whole), digits)


def seeded(spark: SparkSession, names: tuple[str, ...], column: str, counts: DataFrame) -> DataFrame:
    """counts with a row for every name of a vocabulary, zeros where nothing was counted."""
    vocabulary = spark.createDataFrame([(n,) for n in names], f"{column} string")
    return vocabulary.join(counts, column, "left").fillna(0)


def band(rows: DataFrame) -> Column:
    mean = sum((F.col(a) for a in AXES[1:]), F.col(AXES[0])) / len(AXES)
    return F.when(mean >= 4, "apply").when(mean >= 3, "consider").when(mean >= 2, "low_signal").otherwise("reject")


def q_a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored and applied per band, every band present."""
    rows = scores(spark, sf_dir)
    counts = rows.groupBy(band(rows).alias("band")).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("tier") == "free").alias("applied"))
    return seeded(spark, BANDS, "band", counts).withColumn("application_rate", rate(F.col("applied"), F.col("scored")))


def latency(rows: DataFrame, most: int = COLD_START_DAYS) -> DataFrame:
    """Nearest-rank percentiles of days from posting to first sight, over exact dates, and their coverage.

    Rows of (posted, seen, precision): same-day, negative and cold-start latencies don't qualify.
    """
    days = days_between(F.col("posted"), F.col("seen"))
    good = (F.col("precision") == "exact") & (F.to_date("posted") != F.to_date("seen")) & (days >= 0) & (days <= most)
    rows = rows.withColumn("days", F.when(good, days))
    p = lambda q: F.round(F.expr(f"percentile_disc({q}) within group (order by days)"), 6)
    return rows.agg(F.count("days").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.try_divide(F.count("days") * 100.0, F.count("posted")), 6).alias("coverage_pct"))


def q_a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return latency(rows.select(F.col("first_seen").alias("posted"), F.col("last_seen").alias("seen"), F.when(F.col("flag") == "N", "exact").otherwise("approximate").alias("precision")))


def concentrations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Normalised Herfindahl index and entropy of the shares of each key; one group has index 1 and no entropy, none has neither.

    All keys are counted in one pass with grouping sets. With counts c of total t the index is sum(c^2) / t^2 and the entropy log2(t) - sum(c log2 c) / t,
    so plain sums over the counts do and no group waits for the total.
    """
    counts = rows.groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).cast("double").alias("c"), F.grouping_id().alias("gid"))
    ones = (1 << len(keys)) - 1
    by = F.element_at(F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(ones - (1 << (len(keys) - 1 - i))), F.lit(k))]), F.col("gid").cast("int"))
    sums = counts.groupBy(by.alias("by")).agg(F.count(F.lit(1)).alias("groups"), F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("s"), F.sum(F.col("c") * F.log2("c")).alias("l"))
    n, h, e = F.col("groups"), F.col("s") / (F.col("t") * F.col("t")), F.log2("t") - F.col("l") / F.col("t")
    return sums.select(n, F.round(F.when(n == 1, 1.0).when(n > 1, (h - 1 / n) / (1 - 1 / n)), 6).alias("hhi"), F.round(F.when(n > 1, e), 6).alias("entropy_bits"), F.round(F.when(n > 1, e / F.log2(n)), 6).alias("evenness"), "by")


def q_a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concentrations(listings(spark, sf_dir), ["company_id", "stratum", "priority"])


def q_a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by reachability of their company, and again above a fit floor."""
    supplier = table(spark, sf_dir, "supplier")
    rows = scores(spark, sf_dir).join(supplier, F.col("company_id") == F.col("s_suppkey"), "left")
    mean = sum((F.col(a) for a in AXES[1:]), F.col(AXES[0])) / len(AXES)
    reach = F.when(F.col("s_suppkey").isNull(), "unknown").when(F.col("s_acctbal") < 0, "blocked").when(F.col("s_nationkey") < 10, "reachable").otherwise("unprobed")
    return rows.groupBy(reach.alias("reach")).agg(F.count(F.lit(1)).alias("n"), F.count_if(mean >= 3).alias("n_fit"))


def q_a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: sizes of three tables in one row."""
    n = lambda t: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(f"n_{t}"))
    return n("lineitem").crossJoin(n("supplier")).crossJoin(table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("newest")))


def q_a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per status of a fixed vocabulary, zeros included."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return seeded(spark, ("click", "error", "offer", "purchase", "signup", "view", "withdrawn"), "status", counts)


def error_budget(events: DataFrame, days: int = 1) -> DataFrame:
    """Per half-open window, errors and their share, kinds seen, and how many kinds the window before didn't have."""
    kind = F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string"))
    rows = events.select(F.window("ts", f"{days} days").start.alias("start"), kind.alias("kind"), (F.col("event_type") == "error").alias("bad"))
    kinds = rows.filter("bad").select("start", "kind").distinct()
    before = kinds.select((F.col("start") + F.expr(f"interval {days} days")).alias("start"), "kind")
    new = kinds.join(before, ["start", "kind"], "left_anti").groupBy("start").agg(F.count(F.lit(1)).alias("new_kinds"))
    per = rows.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("errors"))
    return per.join(new, "start", "left").select("start", "n", "errors", rate(F.col("errors"), F.col("n")).alias("error_rate"), F.coalesce("new_kinds", F.lit(0)).alias("new_kinds"))


def q_a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_budget(table(spark, sf_dir, "events"))


def duration_bands(runs: DataFrame, last: int = 10, least: int = 5) -> DataFrame:
    """For each run (job, at, id, seconds, good) the p10-p90 band of the good ones among the job's latest others.

    The history is the latest last + 1 runs of the job as of now, less the judged run, then the good ones, then the last of those; too few give no band.
    Those runs are one short array a job, kept by each task before anything moves; a run meets its job's array and takes its order statistics from it.
    """
    newest = Window.partitionBy("job").orderBy(F.desc("at"), F.desc("id"))
    recent = runs.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= last + 1).groupBy("job").agg(F.array_sort(F.collect_list(F.struct("r", "id", "seconds", "good"))).alias("recent"))
    out = runs.select("job", "id", "seconds").join(recent, "job", "left")
    past = F.array_sort(F.transform(F.slice(F.filter("recent", lambda x: (x["id"] != F.col("id")) & x["good"]), 1, last), lambda x: x["seconds"]))
    out = out.select("job", "id", "seconds", F.coalesce(past, F.array().cast("array<double>")).alias("past")).withColumn("history", F.size("past").cast("long"))

    def at(q: float) -> Column:
        place = (F.size("past") - 1) * F.lit(q)
        low, high = F.get("past", F.floor(place).cast("int")), F.get("past", F.ceil(place).cast("int"))
        return F.round(F.when(F.col("history") >= least, low + (high - low) * (place - F.floor(place))), 6)

    return out.select("job", "id", "seconds", "history", at(0.1).alias("low"), at(0.9).alias("high"))


def out_of_band(bands: DataFrame, tolerance: float = 0.25, floor: float = 5.0) -> DataFrame:
    """A run's verdict against its band widened by the larger of a share and a floor."""
    slack = lambda c: F.greatest(F.col(c) * tolerance, F.lit(floor))
    verdict = F.when(F.col("low").isNull(), "insufficient_history").when(F.col("seconds") > F.col("high") + slack("high"), "slow").when(F.col("seconds") < F.col("low") - slack("low"), "fast").otherwise("in_band")
    return bands.withColumn("verdict", verdict)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of jobs: the customer's nation is the job, the price its seconds, status P a failure."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("job"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), (F.col("o_totalprice") / 1000).alias("seconds"), (F.col("o_orderstatus") != "P").alias("good"))


_RUNS = "runs as (select o_custkey % 25 as job, o_orderkey as id, o_orderdate as began, o_totalprice / 1000 as seconds, o_orderstatus <> 'P' as good from orders)"


def q_a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duration_bands(runs(spark, sf_dir))


def q_a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out_of_band(duration_bands(runs(spark, sf_dir))).groupBy("job", "verdict").agg(F.count(F.lit(1)).alias("n"))


def q_a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily disagreement rates with enough rows, each against the 90th percentile of the days before it."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").isin("error", "click")).alias("bad"))
    daily = daily.filter("n >= 20").withColumn("rate", F.col("bad") / F.col("n"))
    past = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(-200, -1)
    p90 = F.expr("percentile(rate, 0.9)").over(past)
    return daily.select("day", "n", F.round("rate", 6).alias("rate"), F.round(p90, 6).alias("p90"), F.coalesce((F.count("rate").over(past) >= 5) & (F.col("rate") > p90), F.lit(False)).alias("anomaly"))


def q_a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's longest gap between ticks, its edges included, and the share of minutes with a tick."""
    ticks = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    day_us = F.unix_micros(F.col("day").cast("timestamp"))
    edges = ticks.select("day").distinct().select("day", F.explode(F.array(day_us, day_us + 86_400_000_000)).alias("us"))
    both = ticks.withColumn("tick", F.lit(1)).unionByName(edges.withColumn("tick", F.lit(0)))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("day").orderBy("us"))
    return both.withColumn("gap", gap).groupBy("day").agg(F.round(F.max("gap") / 1e6, 3).alias("longest_gap_s"), F.sum("tick").alias("ticks"), F.round(F.countDistinct(F.when(F.col("tick") == 1, F.floor(F.col("us") / 60_000_000))) / 1440, 6).alias("coverage"))


def q_a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that ended: first and last moment and duration, by filtered minimum and maximum."""
    rows = listings(spark, sf_dir)
    first, last = F.min("first_seen"), F.max(F.when(F.col("gone"), F.col("last_seen")))
    return rows.groupBy("company_id").agg(first.alias("began"), last.alias("ended"), F.count_if("gone").alias("n_gone")).filter("n_gone > 0").withColumn("days", F.round(days_between(F.col("began"), F.col("ended")), 6))


def q_a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median days to a fix, share within 30 days, mean of a flag and the busiest day, per stratum."""
    rows = listings(spark, sf_dir).withColumn("days", days_between(F.col("first_seen"), F.col("last_seen")))
    daily = rows.groupBy("stratum", F.to_date("last_seen").alias("day")).agg(F.count(F.lit(1)).alias("c")).groupBy("stratum").agg(F.max("c").alias("busiest_day"))
    per = rows.groupBy("stratum").agg(F.round(F.median("days"), 6).alias("median_days"), F.round(100 * F.avg((F.abs("days") <= 30).cast("int")), 6).alias("within_30d_pct"), F.round(F.avg(F.col("gone").cast("int")), 6).alias("gone_rate"))
    return per.join(daily, "stratum")


def votes(rows: DataFrame) -> DataFrame:
    """The candidate of each subject: most distinct jobs, then specificity, then newest; an exact tie abstains.

    Rows of (subject, candidate, job, specificity, seen). A job votes once for a candidate, with its best specificity.
    """
    best = rows.groupBy("subject", "candidate", "job").agg(F.max("specificity").alias("spec"), F.max("seen").alias("seen"))
    tally = best.groupBy("subject", "candidate").agg(F.count(F.lit(1)).alias("jobs"), F.sum("spec").alias("spec"), F.max("seen").alias("seen"))
    w = Window.partitionBy("subject").orderBy(F.desc("jobs"), F.desc("spec"), F.desc("seen"))
    top = tally.withColumn("r", F.rank().over(w)).filter("r = 1")
    return top.groupBy("subject").agg(F.when(F.count(F.lit(1)) == 1, F.min("candidate")).alias("winner"), F.max("jobs").alias("jobs"), F.count(F.lit(1)).alias("tied"))


def q_a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return votes(rows.select(F.col("part_id").alias("subject"), F.col("company_id").alias("candidate"), F.col("user_id").alias("job"), (F.col("quantity") % 5).cast("long").alias("specificity"), F.to_date("last_seen").alias("seen")))


def q_a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and blocks per host; a host is flagged at enough attempts and a high block ratio."""
    host = F.lower(F.parse_url("url", F.lit("HOST")))
    rows = table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("url").contains("utm_")).alias("blocked"))
    return rows.withColumn("ratio", rate(F.col("blocked"), F.col("attempts"))).withColumn("flagged", (F.col("attempts") >= 20) & (F.col("blocked") / F.col("attempts") >= 0.3))


def q_a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sender parse tallies, seeded with the known senders."""
    rows = table(spark, sf_dir, "conversations")
    counts = rows.groupBy(F.col("role").alias("sender")).agg(F.countDistinct("conv_id").alias("messages"), F.count(F.lit(1)).alias("jobs"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))
    return seeded(spark, ("assistant", "system", "tool", "user"), "sender", counts)


def q_a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names without regard to case; the first casing by (id, place) wins."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")))
    low = F.lower("col")
    return rows.filter(F.col("col") != "").groupBy(low.alias("key")).agg(F.min_by("col", F.struct("p_partkey", "pos")).alias("name"), F.count(F.lit(1)).alias("n"))


def q_a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct titles holding a search word without regard to case, those that start with it first."""
    names = table(spark, sf_dir, "part").select(F.col("p_type").alias("title")).distinct().filter(F.lower("title").contains("st"))
    return names.withColumn("starts", F.lower("title").startswith("st")).orderBy(F.desc("starts"), "title")


def q_a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per platform, distinct companies, attempts and errors."""
    return listings(spark, sf_dir).groupBy(F.col("priority").alias("platform")).agg(F.countDistinct("company_id").alias("companies"), F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("flag") == "R").alias("errors"))


def q_a28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of probe statuses and the cohort to probe again."""
    status = F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 5000, "miss").otherwise("hit")
    return table(spark, sf_dir, "supplier").groupBy(status.alias("probe_status")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("s_acctbal") < 5000) & (F.col("s_nationkey") % 2 == 0)).alias("again"))


def q_a29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in each local day of a zone, from UTC instants."""
    local = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), "ts"))
    return table(spark, sf_dir, "events").groupBy(local.alias("local_day")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("user_id").alias("users"))


_MEAN = "(" + " + ".join(AXES) + ") / 6.0"
QUERIES = {
    "A06_conversion": q_a06, "A07_latency": q_a07, "A08_concentration": q_a08, "A09_miss_log": q_a09, "A10_corpus_stats": q_a10, "A11_status_counts": q_a11,
    "A13_error_budget": q_a13, "A14_duration_bands": q_a14, "A15_out_of_band": q_a15, "A16_disagreement": q_a16, "A17_coverage": q_a17, "A18_terminal_runs": q_a18, "A19_rectification": q_a19,
    "A20_votes": q_a20, "A21_blocked_hosts": q_a21, "A22_parse_log": q_a22, "A23_distinct_names": q_a23, "A24_title_search": q_a24, "A26_block_report": q_a26, "A28_probe_status": q_a28, "A29_local_day": q_a29,
}
ORACLES = {
    "A06_conversion": f"""with {SCORES}, c as (
  select case when {_MEAN} >= 4 then 'apply' when {_MEAN} >= 3 then 'consider' when {_MEAN} >= 2 then 'low_signal' else 'reject' end as band,
    count(*) as scored, count(*) filter (tier = 'free') as applied from scores group by 1)
select v.band, coalesce(scored, 0) as scored, coalesce(applied, 0) as applied, round(applied / nullif(scored, 0), 6) as application_rate
from (values ('apply'), ('consider'), ('low_signal'), ('reject'), ('skip')) v(band) left join c using (band)""",
    "A07_latency": f"""with {LISTINGS}, d as (
  select first_seen as posted, case when flag = 'N' and first_seen::date <> last_seen::date and last_seen >= first_seen
    and epoch_us(last_seen) - epoch_us(first_seen) <= 30 * 86400000000 then (epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000.0::double end as days from listings)
select count(days) as n, round(quantile_disc(days, 0.5), 6) as p50, round(quantile_disc(days, 0.95), 6) as p95, round(quantile_disc(days, 0.99), 6) as p99,
  round(count(days) * 100.0 / nullif(count(posted), 0), 6) as coverage_pct from d""",
    "A08_concentration": f"with {LISTINGS} "
    + " union all ".join(
        f"""select count(*) as groups, round(case when count(*) = 1 then 1.0 when count(*) > 1 then (sum(p * p) - 1 / count(*)) / (1 - 1 / count(*)) end, 6) as hhi,
  round(case when count(*) > 1 then sum(-p * log2(p)) end, 6) as entropy_bits, round(case when count(*) > 1 then sum(-p * log2(p)) / log2(count(*)) end, 6) as evenness, '{k}' as "by"
  from (select count(*) / sum(count(*)) over () as p from listings group by {k})"""
        for k in ("company_id", "stratum", "priority")
    ),
    "A09_miss_log": f"""with {SCORES} select case when s_suppkey is null then 'unknown' when s_acctbal < 0 then 'blocked' when s_nationkey < 10 then 'reachable' else 'unprobed' end as reach,
  count(*) as n, count(*) filter ({_MEAN} >= 3) as n_fit from scores left join supplier on company_id = s_suppkey group by 1""",
    "A10_corpus_stats": "select (select count(*) from lineitem) as n_lineitem, (select count(*) from supplier) as n_supplier, (select max(o_orderdate) from orders) as newest",
    "A11_status_counts": """select v.status, coalesce(n, 0) as n from (values ('click'), ('error'), ('offer'), ('purchase'), ('signup'), ('view'), ('withdrawn')) v(status)
left join (select event_type as status, count(*) as n from events group by 1) using (status)""",
    "A13_error_budget": """with r as (select date_trunc('day', ts)::timestamp as start, event_type || ':' || (user_id % 10)::varchar as kind, event_type = 'error' as bad from events),
k as (select distinct start, kind from r where bad),
w as (select k.start, count(*) as new_kinds from k anti join (select start + interval 1 day as start, kind from k) b on k.start = b.start and k.kind = b.kind group by 1)
select r.start, count(*) as n, count(*) filter (bad) as errors, round(count(*) filter (bad) / count(*), 6) as error_rate, coalesce(any_value(new_kinds), 0) as new_kinds
from r left join w on r.start = w.start group by 1""",
    "A14_duration_bands": f"""with {_RUNS}, n as (select *, row_number() over (partition by job order by began desc, id desc) as r from runs),
p as (select a.job, a.id, b.seconds as past, row_number() over (partition by a.job, a.id order by b.r) as k
  from runs a join n b on a.job = b.job and a.id <> b.id where b.r <= 11 and b.good),
b as (select job, id, count(*) as history, quantile_cont(past, 0.1) as low, quantile_cont(past, 0.9) as high from p where k <= 10 group by all)
select job, id, seconds, coalesce(history, 0) as history, round(case when history >= 5 then low end, 6) as low, round(case when history >= 5 then high end, 6) as high
from runs left join b using (job, id)""",
    "A15_out_of_band": f"""with {_RUNS}, n as (select *, row_number() over (partition by job order by began desc, id desc) as r from runs),
p as (select a.job, a.id, b.seconds as past, row_number() over (partition by a.job, a.id order by b.r) as k
  from runs a join n b on a.job = b.job and a.id <> b.id where b.r <= 11 and b.good),
b as (select job, id, count(*) as history, round(quantile_cont(past, 0.1), 6) as low, round(quantile_cont(past, 0.9), 6) as high from p where k <= 10 group by all)
select job, case when history is null or history < 5 then 'insufficient_history' when seconds > high + greatest(high * 0.25, 5.0) then 'slow'
  when seconds < low - greatest(low * 0.25, 5.0) then 'fast' else 'in_band' end as verdict, count(*) as n from runs left join b using (job, id) group by all""",
    "A16_disagreement": """with d as (select ts::date as day, count(*) as n, count(*) filter (event_type in ('error', 'click')) / count(*) as rate from events group by 1 having count(*) >= 20),
w as (select *, quantile_cont(rate, 0.9) over o as p90, count(*) over o as seen from d window o as (order by day rows between 200 preceding and 1 preceding))
select day, n, round(rate, 6) as rate, round(p90, 6) as p90, coalesce(seen >= 5 and rate > p90, false) as anomaly from w""",
    "A17_coverage": """with t as (select date_trunc('day', ts)::timestamp as day, epoch_us(ts) as us, 1 as tick from events),
e as (select * from t union all select distinct day, epoch_us(day), 0 from t union all select distinct day, epoch_us(day) + 86400000000, 0 from t),
g as (select *, us - lag(us) over (partition by day order by us) as gap from e)
select day, round(max(gap) / 1e6, 3) as longest_gap_s, sum(tick)::bigint as ticks, round(count(distinct case when tick = 1 then us // 60000000 end) / 1440, 6) as coverage from g group by day""",
    "A18_terminal_runs": f"""with {LISTINGS} select company_id, min(first_seen) as began, max(last_seen) filter (gone) as ended, count(*) filter (gone) as n_gone,
  round((epoch_us(max(last_seen) filter (gone)) - epoch_us(min(first_seen))) / 86400000000.0::double, 6) as days from listings group by 1 having count(*) filter (gone) > 0""",
    "A19_rectification": f"""with {LISTINGS}, d as (select *, (epoch_us(last_seen) - epoch_us(first_seen)) / 86400000000.0::double as days from listings),
b as (select stratum, max(c) as busiest_day from (select stratum, last_seen::date, count(*) as c from d group by all) group by 1)
select stratum, round(median(days), 6) as median_days, round(100 * avg((abs(days) <= 30)::int), 6) as within_30d_pct, round(avg(gone::int), 6) as gone_rate, any_value(busiest_day) as busiest_day
from d join b using (stratum) group by stratum""",
    "A20_votes": f"""with {LISTINGS}, b as (select part_id as subject, company_id as candidate, user_id as job, max((quantity % 5)::bigint) as spec, max(last_seen::date) as seen from listings group by all),
t as (select subject, candidate, count(*) as jobs, sum(spec) as spec, max(seen) as seen from b group by all),
r as (select *, rank() over (partition by subject order by jobs desc, spec desc, seen desc) as r from t)
select subject, case when count(*) = 1 then min(candidate) end as winner, max(jobs) as jobs, count(*) as tied from r where r = 1 group by subject""",
    "A21_blocked_hosts": """with p as (select lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host, contains(url, 'utm_') as hit from pages)
select host, count(*) as attempts, count(*) filter (hit) as blocked, round(count(*) filter (hit) / count(*), 6) as ratio, count(*) >= 20 and count(*) filter (hit) / count(*) >= 0.3 as flagged from p group by host""",
    "A22_parse_log": """select v.sender, coalesce(messages, 0) as messages, coalesce(jobs, 0) as jobs, coalesce("empty", 0) as "empty" from (values ('assistant'), ('system'), ('tool'), ('user')) v(sender)
left join (select role as sender, count(distinct conv_id) as messages, count(*) as jobs, count(*) filter (trim(coalesce(text, '')) = '') as "empty" from conversations group by 1) using (sender)""",
    "A23_distinct_names": """with w as (select p_partkey, unnest(string_split(p_name, ' ')) as name, generate_subscripts(string_split(p_name, ' '), 1) as pos from part)
select lower(name) as key, arg_min(name, (p_partkey, pos)) as name, count(*) as n from w where name <> '' group by 1""",
    "A24_title_search": "select distinct p_type as title, starts_with(lower(p_type), 'st') as starts from part where contains(lower(p_type), 'st')",
    "A26_block_report": f"with {LISTINGS} select priority as platform, count(distinct company_id) as companies, count(*) as attempts, count(*) filter (flag = 'R') as errors from listings group by 1",
    "A28_probe_status": """select case when s_acctbal < 0 then 'error' when s_acctbal < 5000 then 'miss' else 'hit' end as probe_status, count(*) as n,
  count(*) filter (s_acctbal < 5000 and s_nationkey % 2 = 0) as again from supplier group by 1""",
    "A29_local_day": """select (ts - case when true then interval 5 hours end)::date as local_day, count(*) as calls, count(distinct user_id) as users from events group by 1""",
}
