"""Windows, order statistics and bounded tops for keys that may hold a third of all rows.

A window by key alone is one task a key. Here rows lie by key and slice of time; what a slice needs from before it is copied into it (look-backs of
bounded length) or carried over from one summary row a slice (running values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.bounds import cut, sent_whole
from millrace.plans.projections import table

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: The slice of rows without a moment.
NO_SLICE = -(1 << 62)


def micros(name: str) -> Column:
    """Microseconds of a zoneless moment since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))


def slice_of(at: Column, width: int) -> Column:
    """The number of the slice of `width` that holds `at`, in whole numbers; rows without a moment have a slice of their own."""
    return F.coalesce(((at - F.pmod(at, F.lit(width))) / width).cast("long"), F.lit(NO_SLICE))


def with_look_back(rows: DataFrame, at: str, look_back: int, width: int | None = None) -> DataFrame:
    """Each row in its `_slice`, and copies (`_own` is false) in every later slice from which `look_back` reaches it: one, unless `width` is less."""
    width = width or look_back
    own, last = slice_of(F.col(at), width), slice_of(F.col(at) + look_back, width)
    return rows.withColumn("_first", own).withColumn("_slice", F.explode(F.sequence("_first", last))).withColumn("_own", F.col("_slice") == F.col("_first")).drop("_first")


def usage(events: DataFrame, width: int = DAY) -> DataFrame:
    """Of each event's user, spend in the 24 hours and calls in the 60 seconds up to it, both ends included; events of the same moment count each other."""
    rows = with_look_back(events.select("event_id", "user_id", "value", micros("ts").alias("_at")), "_at", DAY, width)
    back = lambda us: Window.partitionBy("user_id", "_slice").orderBy("_at").rangeBetween(-us, 0)
    spend, n = F.round(F.sum("value").over(back(DAY)), 4), F.count(F.lit(1))
    counted = rows.select("_own", "event_id", spend.alias("spend_24h"), n.over(back(60 * SECOND)).alias("calls_60s"), n.over(back(DAY)).alias("calls_24h"))
    return counted.filter("_own").drop("_own")


def q_a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(table(spark, sf_dir, "events"))


def q_w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's count of its user's events in the 24 hours up to it."""
    return usage(table(spark, sf_dir, "events")).select("event_id", F.col("calls_24h").alias("in_day"))


def gaps(events: DataFrame, width: int = DAY) -> DataFrame:
    """Each user's longest and mean gap between successive events, in seconds; one event has neither.

    A slice gives its longest gap and its ends, ends of neighbouring slices give the gaps between them; the mean is the whole span over one less than the events.
    """
    rows = events.select("user_id", micros("ts").alias("_at")).withColumn("_slice", slice_of(F.col("_at"), width))
    before = F.lag("_at").over(Window.partitionBy("user_id", "_slice").orderBy("_at"))
    per = rows.withColumn("gap", F.col("_at") - before).groupBy("user_id", "_slice").agg(F.max("gap").alias("gap"), F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("_at").alias("n"))
    between = F.col("first") - F.lag("last").over(Window.partitionBy("user_id").orderBy("_slice"))
    whole = per.withColumn("gap", F.greatest("gap", between)).groupBy("user_id").agg(F.max("gap").alias("gap"), (F.max("last") - F.min("first")).alias("span"), F.sum("n").alias("n"))
    return whole.select("user_id", F.round(F.col("gap") / 1e6, 3).alias("longest"), F.round(F.try_divide(F.col("span") / 1e6, F.nullif(F.col("n") - 1, F.lit(0))), 3).alias("mean"))


def q_w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps(table(spark, sf_dir, "events"))


def since_yield(events: DataFrame, yields: Column, width: int = DAY) -> DataFrame:
    """The running count of empty scans since the user's last yield, which itself has 0, in the order of moment and id.

    Rows before the first yield of their slice add what the slices before left: one summary row a slice tells whether it yielded and how many scans came after.
    """
    rows = events.select("user_id", "event_id", micros("ts").alias("_at"), F.coalesce(yields, F.lit(False)).cast("int").alias("_y"))
    rows = rows.withColumn("_slice", slice_of(F.col("_at"), width))
    upto = lambda *by: Window.partitionBy(*by).orderBy("_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum("_y").over(upto("user_id", "_slice")))
    rows = rows.withColumn("_n", F.sum(1 - F.col("_y")).over(upto("user_id", "_slice", "_run")))
    tail = F.max_by("_n", F.struct("_run", "_n"))
    per = rows.groupBy("user_id", "_slice").agg((F.max("_run") > 0).cast("int").alias("hit"), tail.alias("tail"))
    by_slice = Window.partitionBy("user_id").orderBy("_slice")
    per = per.withColumn("era", F.sum("hit").over(by_slice))
    per = per.withColumn("end", F.sum("tail").over(Window.partitionBy("user_id", "era").orderBy("_slice")))
    carried = per.select("user_id", "_slice", F.coalesce(F.lag("end").over(by_slice), F.lit(0)).alias("_carried"))
    same = F.col("a.user_id").eqNullSafe(F.col("b.user_id")) & (F.col("a._slice") == F.col("b._slice"))
    return rows.alias("a").join(carried.alias("b"), same).select("a.event_id", (F.col("_n") + F.when(F.col("_run") == 0, F.col("_carried")).otherwise(0)).alias("empty_scans"))


def q_g09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since_yield(table(spark, sf_dir, "events"), F.col("event_type") == "purchase")


def two_cursors(events: DataFrame, budget: int = 50) -> DataFrame:
    """Two cursors per user with their own rules: all that was read, and what was processed within a budget.

    The first ids up to the budget are kept by each task before anything moves, the rest are only counted.
    """
    first = Window.partitionBy("user_id").orderBy("event_id")
    done = events.select("user_id", "event_id").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= budget).groupBy("user_id").agg(F.max("event_id").alias("processed_to"))
    read = events.groupBy("user_id").agg(F.max("event_id").alias("read_to"), F.greatest(F.count(F.lit(1)) - budget, F.lit(0)).alias("left"))
    return read.join(done.withColumnRenamed("user_id", "_u"), F.col("user_id").eqNullSafe(F.col("_u"))).select("user_id", "read_to", "processed_to", "left")


def q_t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_cursors(table(spark, sf_dir, "events"))


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], most: int = 1_000_000, edges: int = 256) -> DataFrame:
    """(keys, n, a column per rank): exact values at ranks from 1 among a group's values in order, nulls left out; a rank is an expression of the count `n`.

    By refinement: of each rank only the interval that holds it is kept. While one holds more than `most` rows of differing values, a quantile sketch of
    bounded size cuts it at `edges` places, and its rows are counted below and inside a few cuts about the rank; then equal values are counted and
    summed up in order. Sketches only choose the cuts: an interval that misses its rank by the exact counts is opened again as it was.
    """
    data = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    names = list(ranks)
    counted = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), ranks[name].cast("long").alias("r")) for i, name in enumerate(names)])
    none = F.lit(None).cast("double")
    state = counted.select(*keys, "n", F.inline(asked)).select(*keys, "n", "i", "r", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = cut(state)
    low, high = F.col("lo").isNull() | (F.col("_v") >= F.col("lo")), F.col("hi").isNull() | (F.col("_v") <= F.col("hi"))

    def met(bounds: DataFrame) -> DataFrame:
        named = bounds.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], *[c for c in bounds.columns if c not in keys])
        same = F.lit(True)
        for j, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
        return data.join(sent_whole(named), same)

    wide = (F.col("inside") > most) & ~F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    by = [*keys, "i"]
    for _ in range(64):
        open_ones = state.filter(wide)
        if open_ones.isEmpty():
            break
        cuts = F.percentile_approx("_v", [j / edges for j in range(edges + 1)], 20 * edges)
        sketch = met(open_ones).filter(low & high).groupBy(*by).agg(cuts.alias("cuts"))
        at = F.floor((F.col("r") - F.col("below")) / F.col("inside") * edges).cast("int")
        near = lambda j: F.element_at("cuts", F.least(F.greatest(j, F.lit(0)), F.lit(edges)) + 1)
        named = sketch.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("i").alias("_i"), "cuts")
        same = F.col("i") == F.col("_i")
        for j, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{j}"))
        tried = open_ones.join(named, same).select(*by, "n", "r", near(at - 1).alias("lo"), near(at + 2).alias("hi"))
        counts = met(tried).filter(high).groupBy(*by, "n", "r", "lo", "hi").agg(F.count_if(~low).alias("below"), F.count_if(low).alias("inside"))
        fits = (F.col("r") > F.col("below")) & (F.col("r") <= F.col("below") + F.col("inside"))
        better = cut(counts.filter(fits).select(*state.columns))
        before = state.agg(F.sum("inside")).first()[0]
        rest = state.alias("s").join(better.alias("b"), [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by], "left_anti")
        state = cut(rest.select(*better.columns).unionByName(better))
        if state.agg(F.sum("inside")).first()[0] == before:  # values too alike for further cuts: what is left is counted as it is
            break
    values = met(state).filter(high).groupBy(*by, "n", "r", F.when(low, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v")))
    found = values.withColumn("upto", upto).groupBy(*by, "n", "r").agg(F.min(F.when(F.col("upto") >= F.col("r"), F.col("_v"))).alias("v"))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(name) for i, name in enumerate(names)])


def quantiles(rows: DataFrame, keys: list[str], value: str, interpolated: dict[str, float], nearest: dict[str, float], most: int = 1_000_000) -> DataFrame:
    """(keys, a column per name): quantiles between the two neighbouring values, and at the nearest rank from above; both exact."""
    ranks = {}
    for name, q in interpolated.items():
        place = (F.col("n") - 1) * F.lit(q)
        ranks |= {f"{name}_0": F.floor(place) + 1, f"{name}_1": F.ceil(place) + 1}
    for name, q in nearest.items():
        ranks[name] = F.greatest(F.ceil(F.col("n") * F.lit(q)), F.lit(1))
    got = order_statistics(rows, keys, value, ranks, most)
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    between = [(F.col(f"{x}_0") * (1 - part(q)) + F.col(f"{x}_1") * part(q)).alias(x) for x, q in interpolated.items()]
    return got.select(*keys, *between, *nearest)


def q_m06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated and nearest-rank percentiles and the median of prices by priority."""
    got = quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"p90": 0.9, "median": 0.5}, {"p90_nearest": 0.9})
    return got.select("o_orderpriority", F.round("p90", 4).alias("p90"), "p90_nearest", F.round("median", 4).alias("median"))


QUERIES = {"A12_usage": q_a12, "W04_gaps": q_w04, "W06_rolling_day": q_w06, "G09_empty_scans": q_g09, "T02_two_cursors": q_t02, "M06_percentiles": q_m06}
ORACLES = {
    "A12_usage": """select event_id,
  round(sum(value) over (partition by user_id order by ts range between interval 24 hours preceding and current row), 4) as spend_24h,
  count(*) over (partition by user_id order by ts range between interval 60 seconds preceding and current row) as calls_60s,
  count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) as calls_24h from events""",
    "W04_gaps": "with g as (select user_id, date_diff('microsecond', lag(ts) over (partition by user_id order by ts, event_id), ts) / 1e6 as gap from events) select user_id, round(max(gap), 3) as longest, round(avg(gap), 3) as mean from g group by 1",
    "W06_rolling_day": "select event_id, count(*) over (partition by user_id order by ts range between interval 24 hours preceding and current row) as in_day from events",
    "G09_empty_scans": """with r as (select *, sum((event_type = 'purchase')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events)
select event_id, (sum((event_type <> 'purchase')::int) over (partition by user_id, run order by ts, event_id rows unbounded preceding))::bigint as empty_scans from r""",
    "T02_two_cursors": """with k as (select *, row_number() over (partition by user_id order by event_id) as k from events)
select user_id, max(event_id) as read_to, case when count(*) <= 50 then max(event_id) else max(event_id) filter (k <= 50) end as processed_to, count(*) filter (k > 50) as "left" from k group by 1""",
    "M06_percentiles": "select o_orderpriority, round(quantile_cont(o_totalprice, 0.9), 4) as p90, quantile_disc(o_totalprice, 0.9) as p90_nearest, round(median(o_totalprice), 4) as median from orders group by 1",
}
