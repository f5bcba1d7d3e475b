"""Places, chips, audits, packing and title cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.rules import _class_sql, classification, ladder
from millrace.plans.projections import AXES, LISTINGS, SCORES, days_between, let, listings, scores, table

AS_OF = "1996-01-01"
# Placeholders for a place, separators of several places.
PLACEHOLDERS = ("n/a", "na", "tbd", "tba", "unknown", "various", "varies", "multiple locations", "see job description", "see jd", "see description", "not specified", "none", "-", "--")
SEPARATORS = r"(?i)\s*[|;]\s*|\s+/\s+|\s+&\s+|\s+or\s+"
EDGES = " \t\n\x0b\f\r-–—.,;:|"


def place(c: Column) -> Column:
    """Edges and spaces trimmed, placeholders and empties null; case is kept."""
    s = F.trim(F.regexp_replace(F.btrim(c, F.lit(EDGES)), r"\s+", " "))
    return let(s, lambda x: F.when((x != "") & ~F.lower(x).isin(*PLACEHOLDERS), x))


def places(c: Column) -> Column:
    """The places of a text with several, each once without regard to case, the first casing wins."""
    found = F.array_compact(F.transform(F.split(c, SEPARATORS), place))
    new = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(found, F.array().cast("array<string>"), new)


def place_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array(*[F.lit(x) for x in ("New  York; Boston", " remote | Remote", "N/A", "Oslo / Bergen or oslo", "- Lima -", "TBD; Paris & Lyon", "", "see JD")])
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(text, (F.col("c_custkey") % 8 + 1).cast("int")).alias("text"))


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays, row by row of the usual table."""

    def following(prev: Column, x: Column) -> Column:
        cell = lambda cur, j: F.concat(cur, F.array(F.when(F.element_at(b, j) == x, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(cur, -1), F.element_at(prev, j + 1)))))
        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), following), -1)


def similar_titles(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of a cohort's distinct titles whose common subsequence is `least` of the longer one.

    Similar titles share that much of their tokens, so one of the first tokens in a common order: titles meet only by the
    (cohort, token) of the rarest tokens that must hold one of the shared.
    """
    tokens = F.filter(F.split(F.regexp_replace(F.lower("title"), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: t != "")
    titles = rows.select("cohort", tokens.alias("t")).filter(F.size("t") > 0).distinct().withColumn("title", F.array_join("t", " "))
    # Rare tokens come first in the order that all titles of a cohort share, so that few titles meet by one key.
    often = titles.select("cohort", F.explode(F.array_distinct("t")).alias("k")).groupBy("cohort", "k").agg(F.count(F.lit(1)).alias("n"))
    ranked = titles.select("cohort", "title", F.explode(F.array_distinct("t")).alias("k")).join(often, ["cohort", "k"]).groupBy("cohort", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "k"))), lambda x: x["k"]).alias("keys"))
    titles = titles.join(ranked, ["cohort", "title"])
    # Of m tokens at least ceil(least * m) are shared, so one of the first m - ceil(least * m) + 1 is.
    first = F.slice("keys", F.lit(1), F.greatest(F.size("t") - F.ceil(F.size("t") * least).cast("int") + 1, F.lit(1)))
    keyed = titles.withColumn("key", F.explode(first))
    a, b = keyed.select("cohort", "key", F.col("t").alias("a"), F.col("title").alias("title_a")), keyed.select("cohort", "key", F.col("t").alias("b"), F.col("title").alias("title_b"))
    pairs = a.join(b, ["cohort", "key"]).filter((F.col("title_a") < F.col("title_b")) & (F.least(F.size("a"), F.size("b")) >= least * F.greatest(F.size("a"), F.size("b")))).dropDuplicates(["cohort", "title_a", "title_b"])
    pairs = pairs.withColumn("similarity", F.round(lcs(F.col("a"), F.col("b")) / F.greatest(F.size("a"), F.size("b")), 6))
    return pairs.filter(F.col("similarity") >= least).select("cohort", "title_a", "title_b", "similarity")


def q_j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("cohort"), F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") % 3).cast("string")).alias("title"))
    return similar_titles(rows)


def packed(items: Column, most_items: int, most_size: int) -> Column:
    """Greedy packing of an ordered array of sizes: a new batch when the next item would pass either bound; longer items are cut first."""
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("of"))

    def put(s: Column, x: Column) -> Column:
        size = F.least(x, F.lit(most_size))
        full = (s["n"] + 1 > most_items) | (s["size"] + size > most_size)
        batch = s["batch"] + (full & (s["n"] > 0)).cast("int")
        fresh = full & (s["n"] > 0)
        return F.struct(batch.alias("batch"), F.when(fresh, 1).otherwise(s["n"] + 1).alias("n"), F.when(fresh, size).otherwise(s["size"] + size).alias("size"), F.concat(s["of"], F.array(batch)).alias("of"))

    return F.aggregate(items, zero, put)["of"]


def q_o07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each conversation's turns."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.char_length(F.coalesce("text", F.lit(""))).alias("size")))).alias("t"))
    of = packed(F.transform("t", lambda x: x["size"]), 3, 400)
    return rows.select("conv_id", F.size("t").alias("turns"), F.array_max(of).alias("last_batch"), F.array_join(of.cast("array<string>"), ",").alias("batches"))


def q_c08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_texts(spark, sf_dir).select("c_custkey", F.array_join(places(F.col("text")), "+").alias("places"))


def q_c06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows all of whose axes are one value say nothing; pay without a statement is neutral."""
    rows = scores(spark, sf_dir)
    degenerate = F.size(F.array_distinct(F.array(*AXES))) == 1
    pay = F.when(F.col("tier").isNull(), 3).otherwise(F.col("comp_fit"))
    return rows.groupBy(degenerate.alias("degenerate"), pay.alias("pay")).agg(F.count(F.lit(1)).alias("n"))


def q_a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of axes read from JSON text with a type guard, per company."""
    text = F.when(F.col("listing_id") % 10 == 0, F.lit('{"title_fit": "x"}')).otherwise(F.to_json(F.struct(*AXES)))
    value = lambda a: F.get_json_object("j", f"$.{a}").try_cast("int")
    total = sum((F.coalesce(value(a), F.lit(0)) for a in AXES[1:]), F.coalesce(value(AXES[0]), F.lit(0)))
    return scores(spark, sf_dir).select("company_id", text.alias("j")).groupBy("company_id").agg(F.sum(total).alias("axis_sum"), F.count_if(value("title_fit").isNull()).alias("unread"))


def q_c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is due for an audit: a high sum, no audit of the same text, skipped no more than twice."""
    rows = scores(spark, sf_dir).withColumn("sum", sum((F.col(a) for a in AXES[1:]), F.col(AXES[0]))).filter("sum >= 20")
    text = F.to_json(F.struct(*AXES))
    line = table(spark, sf_dir, "lineitem")
    audits = line.filter("l_tax < 0.04").withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).filter("r = 1")
    audits = audits.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("listing_id"), F.floor("l_quantity").cast("int").alias("skips")).groupBy("listing_id").agg(F.min("skips").alias("skips"))
    out = rows.withColumn("snapshot", text).join(audits, "listing_id", "left")
    return out.groupBy(ladder([(F.col("skips").isNull(), "due"), (F.col("skips") <= 2, "due_again")], "skipped").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("snapshot").alias("snapshots"))


def q_g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assessment's write: class and ordered text together, provenance only where known; an invalid row clears all."""
    rows = scores(spark, sf_dir).withColumn("class", classification())
    valid = ~F.col("class").isin("low_signal", "quarantined")
    return rows.groupBy(F.when(valid, F.col("class")).alias("class"), F.when(valid, F.coalesce("tier", F.lit("unknown"))).alias("tier"), (F.when(valid, F.to_json(F.struct(*AXES)))).isNull().alias("cleared")).agg(F.count(F.lit(1)).alias("n"))


def q_f25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """misses that may be probed again after a cool-down; enabled rows without an address."""
    rows = table(spark, sf_dir, "customer")
    tried = F.to_date(F.lit("1995-12-01")) + (F.col("c_custkey") % 60).cast("int")
    again = (F.col("c_acctbal") < 2000) & (tried < F.to_date(F.lit(AS_OF)) - 7)
    return rows.filter(again).select("c_custkey", tried.alias("tried")).orderBy("tried", "c_custkey")


def q_x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first way in which a title isn't one."""
    shape = F.array(F.col("p_name"), F.concat("p_name", F.lit("\u0007")), F.lit("Posted Jan 5, 2024"), F.lit("3 days ago"), F.lit("Apply now"), F.lit("See all jobs →"), F.concat("p_name", F.lit(" ›")), F.lit("Privacy Policy"))
    title = F.element_at(shape, (F.col("p_partkey") % 8 + 1).cast("int"))
    why = lambda t: ladder([
        (t.rlike(r"[\x00-\x08\x0e-\x1f]"), "control"), (t.rlike(r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* \d{1,2}, \d{4}"), "date"), (t.rlike(r"(?i)\b\d+ (?:day|hour|week|month)s? ago\b"), "age"),
        (t.rlike(r"(?i)^(?:apply now|see all|view all|learn more)"), "call"), (t.rlike("[→›»]"), "arrow"), (t.rlike(r"(?i)^(?:privacy policy|terms of (?:use|service)|cookie)"), "not_a_posting"),
    ])
    return table(spark, sf_dir, "part").groupBy(let(title, why).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


def q_x27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's chips in order of priority, three at most; the address to apply at."""
    age = days_between(F.col("last_seen"), F.lit(AS_OF).cast("timestamp_ntz"))
    chips = F.array_compact(F.array(ladder([(age <= 7, "new"), (age <= 30, "recent")]), F.when(F.col("stratum") == "P", "priority"), F.when(F.col("discount") >= 0.05, "discount"), F.when(F.col("quantity") >= 25, "bulk"), F.when(F.col("flag") == "R", "returned")))
    urls = F.array_compact(F.array(F.when(F.col("listing_id") % 4 == 0, "direct"), F.when(F.col("listing_id") % 3 == 0, "board"), F.lit("aggregator")))
    rows = listings(spark, sf_dir).filter((F.col("last_seen") < F.lit(AS_OF).cast("timestamp_ntz")) & (age <= 60))
    return rows.select("listing_id", F.array_join(F.slice(chips, 1, 3), ",").alias("chips"), F.element_at(urls, 1).alias("apply_at"))


def q_c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: the ingest contract: rows come out clean, quarantined with ordered reason codes, or dropped."""
    docs = table(spark, sf_dir, "documents")
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "text_short"), F.when(F.col("text").rlike(r"[#$%&*]{3}"), "text_junk"), F.when(F.col("lang").isNull(), "no_lang"), F.when(F.col("text").rlike("(?i)password="), "secret")))
    route = ladder([(F.trim("text") == "", "dropped"), (F.size(reasons) > 0, "quarantined")], "clean")
    return docs.groupBy(route.alias("route"), F.array_join(reasons, ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


_SUM = " + ".join(AXES)
QUERIES = {
    "J15_similar_titles": q_j15, "O07_packing": q_o07, "C08_places": q_c08, "C06_degenerate": q_c06, "A25_axis_sums": q_a25, "C15_audit_due": q_c15, "G11_assessment": q_g11,
    "F25_cool_down": q_f25, "X11_title_contract": q_x11, "X27_chips": q_x27, "C14_ingest": q_c14,
}
_JSON = "'{' || " + " || ',' || ".join(f"'\"{a}\":' || {a}" for a in AXES) + " || '}'"
ORACLES = {
    "G11_assessment": f"""with {SCORES}, c as (select *, {_class_sql()} as class from scores), v as (select *, class not in ('low_signal', 'quarantined') as valid from c)
select case when valid then class end as class, case when valid then coalesce(tier, 'unknown') end as tier, not valid as cleared, count(*) as n from v group by 1, 2, 3""",
    "O07_packing": """with recursive t as (select conv_id, least(length(coalesce(text, '')), 400) as size, row_number() over (partition by conv_id order by turn, length(coalesce(text, ''))) as i from conversations),
r as (select conv_id, i, size, 0 as batch, 1 as n, size as held from t where i = 1
  union all
  select t.conv_id, t.i, t.size, r.batch + (r.n + 1 > 3 or r.held + t.size > 400)::int, case when r.n + 1 > 3 or r.held + t.size > 400 then 1 else r.n + 1 end, case when r.n + 1 > 3 or r.held + t.size > 400 then t.size else r.held + t.size end
  from r join t on t.conv_id = r.conv_id and t.i = r.i + 1)
select conv_id, count(*)::int as turns, max(batch)::int as last_batch, string_agg(batch::varchar, ',' order by i) as batches from r group by 1""",
    "C08_places": "select c_custkey, ['New York+Boston', 'remote', '', 'Oslo+Bergen', 'Lima', 'Paris+Lyon', '', ''][(c_custkey % 8 + 1)::int] as places from customer",
    "C06_degenerate": f"with {SCORES} select greatest({', '.join(AXES)}) = least({', '.join(AXES)}) as degenerate, case when tier is null then 3 else comp_fit end as pay, count(*) as n from scores group by all",
    "A25_axis_sums": f"with {SCORES} select company_id, sum(case when listing_id % 10 = 0 then 0 else {_SUM} end)::bigint as axis_sum, count(*) filter (listing_id % 10 = 0) as unread from scores group by 1",
    "C15_audit_due": f"""with {SCORES}, a as (select listing_id, min(skips) as skips from (select l_orderkey * 10 + l_linenumber as listing_id, floor(l_quantity)::int as skips, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as r from lineitem where l_tax < 0.04) where r = 1 group by 1)
select case when skips is null then 'due' when skips <= 2 then 'due_again' else 'skipped' end as state, count(*) as n, count(distinct {_JSON}) as snapshots from scores left join a using (listing_id) where {_SUM} >= 20 group by 1""",
    "F25_cool_down": f"select c_custkey, date '1995-12-01' + (c_custkey % 60)::int as tried from customer where c_acctbal < 2000 and date '1995-12-01' + (c_custkey % 60)::int < date '{AS_OF}' - 7",
    "X11_title_contract": "select [null, 'control', 'date', 'age', 'call', 'call', 'arrow', 'not_a_posting'][(p_partkey % 8 + 1)::int] as violation, count(*) as n from part group by 1",
    "X27_chips": f"""with {LISTINGS}, a as (select *, (epoch_us(timestamp '{AS_OF}') - epoch_us(last_seen)) / 86400000000.0::double as age from listings where last_seen < timestamp '{AS_OF}')
select listing_id, array_to_string(list_filter([case when age <= 7 then 'new' when age <= 30 then 'recent' end, case when stratum = 'P' then 'priority' end, case when discount >= 0.05 then 'discount' end, case when quantity >= 25 then 'bulk' end, case when flag = 'R' then 'returned' end], lambda x: x is not null)[1:3], ',') as chips,
  case when listing_id % 4 = 0 then 'direct' when listing_id % 3 = 0 then 'board' else 'aggregator' end as apply_at from a where age <= 60""",
    "C14_ingest": r"""with r as (select text, list_filter([case when n_chars < 200 then 'text_short' end, case when regexp_matches(text, '[#$%&*]{3}') then 'text_junk' end, case when lang is null then 'no_lang' end, case when regexp_matches(text, '(?i)password=') then 'secret' end], lambda x: x is not null) as r from documents)
select case when trim(text) = '' then 'dropped' when len(r) > 0 then 'quarantined' else 'clean' end as route, array_to_string(r, ',') as reasons, count(*) as n from r group by all""",
}
