"""Filters, joins, windows, ordering, paging and set operations (F, J, W, O, U)."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.projections import AXES, LISTINGS, POSTINGS, SCORES, listings, postings, scores, table
from millrace.session import ship

PAGE_MAX = 25
AS_OF = "1996-01-01"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


#: Orders by public name; an unknown name is an error, nothing else reaches a sort.
SORTS = {
    "default": [F.desc_nulls_last, ("rank", "last_seen", "listing_id")],
    "price": [F.desc_nulls_last, ("price", "listing_id")],
    "oldest": [F.asc_nulls_last, ("first_seen", "listing_id")],
}


def feed_filter(rows: DataFrame, companies: list[int] | None = None, contains: str | None = None, stratum: str | None = None) -> DataFrame:
    """an empty or missing choice filters nothing; substrings are literal, so % and _ are themselves."""
    if companies:
        rows = rows.filter(F.col("company_id").isin(companies))
    if contains:
        rows = rows.filter(F.col("priority").contains(contains))
    if stratum:
        rows = rows.filter(F.col("stratum") == stratum)
    return rows.filter(~F.col("flag").eqNullSafe("R"))


def ranked(rows: DataFrame) -> DataFrame:
    """A rank score for one listing in three, infinite and NaN ones among them; null for the rest."""
    rank = F.when(F.col("listing_id") % 3 == 0, F.round(F.col("price") / 1000, 3)).when(F.col("listing_id") % 331 == 1, F.lit(float("nan"))).when(F.col("listing_id") % 333 == 2, F.lit(float("inf")))
    return rows.withColumn("rank", rank)


def after(rank: float | None, last_seen: datetime, listing_id: int) -> Column:
    """what comes after a cursor in (rank nulls last, last_seen, id) order, all descending; NaN is greatest."""
    low = float("-inf")
    here = F.struct((~F.col("rank").isNull()).alias("a"), F.coalesce("rank", F.lit(low)).alias("b"), F.col("last_seen").alias("c"), F.col("listing_id").alias("d"))
    there = F.struct(F.lit(rank is not None).alias("a"), F.lit(low if rank is None else float(rank)).alias("b"), F.lit(last_seen).cast("timestamp_ntz").alias("c"), F.lit(listing_id).cast("long").alias("d"))
    return here < there


def page(rows: DataFrame, sort: str = "default", limit: int = PAGE_MAX, cursor: tuple | None = None, offset: int = 0) -> DataFrame:
    """A page of at most PAGE_MAX rows; a cursor goes with the default order and without an offset."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort: {sort}")
    if cursor and (sort != "default" or offset):
        raise ValueError("a cursor goes with the default sort and no offset")
    direction, columns = SORTS[sort]
    if cursor:
        rows = rows.filter(after(*cursor))
    rows = rows.orderBy(*[direction(c) for c in columns])
    return (rows.offset(offset) if offset else rows).limit(max(0, min(limit, PAGE_MAX)))


def q_f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_filter(listings(spark, sf_dir), companies=[1, 2, 3, 5, 8], contains="URGENT").select("listing_id", "company_id", "priority", "flag")


def q_f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(listings(spark, sf_dir)).filter(after(None, datetime(1996, 6, 1), 100)).select("listing_id", "last_seen")


def q_f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows of a list of ids in the list's order; unknown ids fall out."""
    wanted = spark.createDataFrame([([331, 11, 999999999, 71, 12],)], "ids array<long>").select(F.posexplode("ids").alias("pos", "listing_id"))
    return listings(spark, sf_dir).join(F.broadcast(wanted), "listing_id").select("pos", "listing_id", "price").orderBy("pos")


def last_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the newest moment that a listing of theirs was seen up to the reference time."""
    seen = listings(spark, sf_dir).filter(F.col("last_seen") < as_of()).groupBy("company_id").agg(F.max("last_seen").alias("last_scan"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "supplier").join(seen, F.col("s_suppkey") == F.col("company_id"), "left")


def q_f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enabled companies never scanned or not for eight hours before the reference time, never-scanned first."""
    due = F.col("last_scan").isNull() | (F.col("last_scan") < as_of() - F.expr("interval 8 hours"))
    return last_scan(spark, sf_dir).filter((F.col("s_acctbal") > 0) & due).select("s_suppkey", "s_name", "last_scan").orderBy(F.asc_nulls_first("last_scan"), "s_name")


def eligible() -> Column:
    """a hit, or an error that may be tried again; not on an excluded platform; with an identity; not dormant."""
    status = F.when(F.col("s_acctbal") < 0, "error").when(F.col("s_acctbal") < 3000, "miss").otherwise("hit")
    retry = (status == "error") & (F.col("s_suppkey") % 3 < 2)
    dormant = (F.coalesce("n", F.lit(0)) < 5) & (F.col("last_scan") > as_of() - F.expr("interval 3 days"))
    return ((status == "hit") | retry) & ~F.col("s_nationkey").isin(3, 7) & F.col("s_name").isNotNull() & ~F.coalesce(dormant, F.lit(False))


def q_f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = last_scan(spark, sf_dir).filter(eligible())
    return rows.select("s_suppkey").crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("eligible"))))


def q_f09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with a wanted listing (exists), and those without any (not exists, limited)."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    wanted = listings(spark, sf_dir).filter((F.col("flag") == "R") & (F.col("quantity") >= 49)).select(F.col("company_id").alias("s_suppkey"))
    lane1 = supplier.join(wanted, "s_suppkey", "left_semi").withColumn("lane", F.lit(1))
    lane2 = supplier.join(wanted, "s_suppkey", "left_anti").orderBy("s_suppkey").limit(20).withColumn("lane", F.lit(2))
    return lane1.unionByName(lane2)


def q_f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """companies without a hit and with enough strikes; clean reasons and old rows don't strike."""
    rows = listings(spark, sf_dir)
    recent = F.col("last_seen") >= as_of() - F.expr("interval 700 days")
    strike = (F.col("flag") != "N") & recent & (F.col("discount") != 0.0)
    per = rows.groupBy("company_id").agg(F.count_if((F.col("flag") == "N") & (F.col("quantity") == 50)).alias("hits"), F.count_if(strike).alias("strikes"))
    return per.filter("hits = 0 and strikes >= 5")


def q_f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose latest event by (time, id) was an error."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).filter("r = 1 and event_type = 'error'").select("user_id", "event_id", "ts")


def q_f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """non-blank texts with no reason of a set whose version is stale."""
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign"), F.when(F.col("doc_id") % 11 == 0, "blocked")))
    rows = table(spark, sf_dir, "documents").withColumn("reasons", reasons).withColumn("version", F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 4).cast("int")))
    good = (F.trim("text") != "") & ~F.arrays_overlap("reasons", F.array(F.lit("short"), F.lit("blocked"))) & (F.col("version").isNull() | (F.col("version") < 3))
    return rows.filter(good).select("doc_id", "version", F.array_join("reasons", ",").alias("reasons"))


def skip_reason() -> Column:
    """why a score row can't be scored, the first reason that holds; null if it can."""
    return F.when(F.col("text_length") < 300, "awaiting_text").when(F.col("location_fit") == 1, "awaiting_location").when(F.col("tier").eqNullSafe("exhausted") & (F.col("text_length") < 900), "awaiting_adjudication")


def q_f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).groupBy(skip_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first matching exclusion: title keyword, denied company, price under 85 % of the floor."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("title"))
    denied = spark.createDataFrame([(n,) for n in (4, 9, 16, 25)], "denied long")
    rows = listings(spark, sf_dir).join(part, F.col("part_id") == F.col("p_partkey")).join(F.broadcast(denied), F.col("company_id") == F.col("denied"), "left")
    rule = F.when(F.col("title").contains("red"), "title").when(F.col("denied").isNotNull(), "company").when(F.col("price") < 20_000 * 0.85, "pay").otherwise("kept")
    return rows.groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"))


def q_f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN over terminal tiers; a null tier falls out, as in SQL."""
    return scores(spark, sf_dir).filter(~F.col("tier").isin("exhausted", "expired")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def q_f16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates by attempt budget or cool-down that have not expired, never-checked first."""
    rows = scores(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("company_id") == F.col("s_suppkey"), "left")
    checked = F.when(F.col("skills_match") > 2, F.col("scored_at"))
    ok = ((F.col("title_fit") < 3) | (F.col("scored_at") < as_of() - F.expr("interval 30 days"))) & (F.col("s_acctbal") > 0)
    return rows.filter(ok).select("listing_id", checked.alias("checked_at")).orderBy(F.asc_nulls_first("checked_at"), "listing_id")


def q_f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows whose version is distinct from the current one (null too) and whose text has a visible character."""
    version = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 3).cast("int"))
    return table(spark, sf_dir, "documents").filter(~version.eqNullSafe(F.lit(2)) & F.col("text").rlike(r"\S")).select("doc_id", version.alias("version"))


def q_f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings whose tags contain one."""
    return postings(spark, sf_dir).filter(F.array_contains("sources", "portal_jooble")).select("doc_id", F.array_join("sources", "+").alias("tags"))


def q_f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events whose JSON key isn't a value, null-safe."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").filter(~k.eqNullSafe("7")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def q_f21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """membership of a target set: mean of six axes at a floor and no hard negative."""
    mean = sum((F.col(a) for a in AXES[1:]), F.col(AXES[0])) / len(AXES)
    return scores(spark, sf_dir).filter((mean >= 3.5) & ~F.col("flagged") & (F.least(*AXES) > 1)).select("listing_id", F.round(mean, 6).alias("mean"))


#: Health signatures: name, path, test, operand, severity.
SIGNATURES = [("big_value", "$.k", "gt", "50", 2), ("odd_seven", "$.k", "eq", "7", 3), ("has_k", "$.k", "truthy", "", 1), ("nine", "$.k", "contains", "9", 1), ("small", "$.k", "lte", "3", 2)]


def q_f22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """which signatures each event meets, and the worst severity; the registry is a literal of a few rows."""
    rows = table(spark, sf_dir, "events")
    hits = []
    for name, path, test, operand, severity in SIGNATURES:
        v = F.get_json_object("props", path)
        number = F.expr(f"try_cast(get_json_object(props, '{path}') as double)")
        met = {"gt": lambda: number > float(operand), "lte": lambda: number <= float(operand), "eq": lambda: v == operand, "contains": lambda: v.contains(operand), "truthy": lambda: v.isNotNull() & ~v.isin("", "0", "false", "null")}[test]()
        hits.append(F.when(met, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("name"))))
    found = rows.withColumn("hits", F.array_compact(F.array(*hits)))
    return found.filter(F.size("hits") > 0).select("event_id", F.size("hits").alias("n"), F.array_max("hits")["severity"].alias("worst"), F.array_join(F.array_sort(F.transform("hits", lambda h: h["name"])), ",").alias("names"))


def q_f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers of a segment prefix with no order before the reference time, for the reaper."""
    early = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") < as_of()).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").filter(F.startswith("c_mktsegment", F.lit("B"))).join(early, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def q_f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings all of whose tags the registry explains as gated or opaque."""
    gated = ("linkedin", "glassdoor", "indeed", "portal_jooble", "portal_adzuna", "dataforseo", "primary_source_llm")
    rows = postings(spark, sf_dir)
    return rows.select("doc_id", (F.forall("sources", lambda s: s.isin(*gated))).alias("unverifiable"), F.exists("sources", lambda s: F.startswith(s, F.lit("portal_"))).alias("opaque"))


def q_f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages whose own address already is canonical: no tracking, https, a path."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").filter(~url.contains("utm_") & F.startswith(url, F.lit("http")) & url.rlike(r"^[a-z]+://[^/?#]+/.")).select("page_id", "url")


def q_f27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per user, whether they signed up, and the latest consent record at or below a version."""
    rows = table(spark, sf_dir, "events")
    version = (F.get_json_object("props", "$.k").cast("int") % 4)
    consent = F.max_by(F.struct("event_type", version.alias("version")), F.struct("ts", "event_id"))
    return rows.filter(version <= 2).groupBy("user_id").agg((F.count_if(F.col("event_type") == "signup") > 0).alias("signed_up"), consent["event_type"].alias("latest"), consent["version"].alias("version"))


def q_j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user's overlays on the feed; each right side is cut to the user before the join."""
    user = 7
    rows = listings(spark, sf_dir).filter(F.col("company_id") <= 10)
    applied = table(spark, sf_dir, "orders").filter(F.col("o_custkey") == user).select((F.col("o_orderkey") * 10 + 1).alias("listing_id"), F.col("o_orderstatus").alias("status"))
    watched = listings(spark, sf_dir).filter(F.col("user_id") == user).select("company_id").distinct().withColumn("watched", F.lit(True))
    return rows.join(applied, "listing_id", "left").join(watched, "company_id", "left").select("listing_id", "company_id", "status", F.coalesce("watched", F.lit(False)).alias("watched"))


def q_j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner with a status list, left with a default key, and the count that finds no partner."""
    rows, supplier = listings(spark, sf_dir), table(spark, sf_dir, "supplier").filter("s_suppkey % 7 > 0")
    on = F.col("company_id") == F.col("s_suppkey")
    inner = rows.filter(F.col("stratum").isin("F", "P")).join(supplier, on).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("inner"))
    anti = rows.join(supplier, on, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("anti"))
    keyed = rows.join(supplier, on, "left").groupBy(F.coalesce(F.nullif(F.substring("s_name", 1, 8), F.lit("")), F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return inner.unionByName(anti).unionByName(keyed)


def q_j08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest value and number of rows per key, by one grouped pass instead of correlated subqueries."""
    newest = listings(spark, sf_dir).groupBy("company_id").agg(F.max_by("price", F.struct("last_seen", "listing_id")).alias("latest_price"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "supplier").join(newest, F.col("s_suppkey") == F.col("company_id"), "left").select("s_suppkey", "latest_price", F.coalesce("n", F.lit(0)).alias("n"))


def siblings(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k latest other rows of the same company.

    Of each company the k + 1 latest are kept, by each task before anything moves, as one array; a row meets its company's array and drops itself from it.
    """
    w = Window.partitionBy("company_id").orderBy(F.desc("last_seen"), F.desc("listing_id"))
    rows = rows.groupBy("company_id", "listing_id").agg(F.max("last_seen").alias("last_seen"))
    top = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("r", "listing_id"))).alias("top"))
    others = F.slice(F.filter(F.transform("top", lambda t: t["listing_id"]), lambda x: x != F.col("listing_id")), 1, k)
    out = rows.select("company_id", "listing_id").join(top, "company_id").select("company_id", "listing_id", F.posexplode(others).alias("place", "sibling"))
    return out.select("company_id", "listing_id", "sibling", (F.col("place") + 1).cast("long").alias("k"))


def q_j09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siblings(listings(spark, sf_dir)).select("listing_id", "sibling", "k")


def q_j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with filtered aggregates of their events."""
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_purchase"))
    return table(spark, sf_dir, "customer").join(events, F.col("c_custkey") == F.col("user_id")).select("c_custkey", "errors", "last_purchase")


def q_j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match on a primary key, else on a secondary one; the primary wins."""
    batch = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3000).alias("k1"), (F.col("user_id") % 50).alias("k2"))
    first = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k1"), F.col("o_custkey").alias("by_key"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k2"), F.col("s_suppkey").alias("by_source"))
    out = batch.join(first, "k1", "left").join(second, "k2", "left")
    return out.select("event_id", F.coalesce("by_key", "by_source").alias("match"), F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_source").isNotNull(), "source").otherwise("none").alias("how"))


def q_j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve parts by normalised title; several candidates are narrowed by token overlap; verdict by how many are left."""
    part = table(spark, sf_dir, "part")
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    tokens = F.coalesce(F.array_sort(F.array_distinct(F.split(F.lower("p_type"), " "))), F.array().cast("array<string>"))
    rows = part.select("p_partkey", norm(F.col("p_name")).alias("title"), tokens.alias("tokens"))
    return resolution(rows.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "job"), rows.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "posting"))


def resolution(jobs: DataFrame, postings: DataFrame) -> DataFrame:
    """Jobs (job, title, tokens) against postings (posting, title, tokens), token sets sorted.

    Only the different token sets of a title meet: postings are counted by title and set first, and a title's jobs of one set share what they find, so
    no job is paired with each posting of its title.
    """
    have = postings.groupBy("title", F.col("tokens").alias("other")).agg(F.count(F.lit(1)).alias("m"), F.min("posting").alias("first"))
    near = F.arrays_overlap("tokens", "other")
    kinds = jobs.select("title", "tokens").distinct().join(have, "title").groupBy("title", "tokens").agg(F.sum("m").alias("n"), F.sum(F.when(near, F.col("m")).otherwise(0)).alias("n_near"), F.min(F.when(near, F.col("first"))).alias("near"), F.min("first").alias("only"))
    per = jobs.join(kinds, ["title", "tokens"]).groupBy("job").agg(F.sum("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("near").alias("near"), F.min("only").alias("only"))
    verdict = F.when(F.col("n") == 1, "strict").when(F.col("n_near") == 1, "loose").otherwise("ambiguous")
    return per.select("job", "n", "n_near", verdict.alias("verdict"), F.when(F.col("n") == 1, F.col("only")).when(F.col("n_near") == 1, F.col("near")).alias("posting"))


def q_j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that hold a target phrase as words or all of a target's tokens, less exclusions; targets are a literal list."""
    targets = [["red", "green"], ["small"], ["large", "steel"]]
    tokens = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), r"[^a-z0-9]+")
    hit = F.lit(False)
    for t in targets:
        hit = hit | (F.size(F.array_except(F.array(*[F.lit(x) for x in t]), tokens)) == 0) | F.lower("p_name").rlike(r"\b" + " ".join(t) + r"\b")
    return table(spark, sf_dir, "part").filter(hit & ~F.array_contains(tokens, "blue")).select("p_partkey", "p_name", "p_type")


def best_of_cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest vectors of each query within one block of queries and one of vectors, as a matrix product."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        rows = np.array(column.to_pylist(), np.float64)
        with np.errstate(invalid="ignore"):
            return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return kind.empty_table()
        ids, among = (t.column(c).to_numpy().astype(np.int64) for t, c in ((queries, "query_id"), (vectors, "vec_id")))
        cosine = np.round(unit(queries.column("q")) @ unit(vectors.column("v")).T, 6)
        # NaN is the greatest value to an ordering of both engines.
        rank = np.where(np.isnan(cosine), np.inf, cosine)
        rank[ids[:, None] == among] = -np.inf
        most = min(k, len(among))
        least = -np.partition(-rank, most - 1, axis=1)[:, most - 1]
        q, v = np.nonzero((rank >= least[:, None]) & (rank > -np.inf))
        order = np.lexsort((among[v], -rank[q, v], q))
        q, v = q[order], v[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, v = q[place < k], v[place < k]
        return pa.Table.from_arrays([pa.array(ids[q]), pa.array(among[v]), pa.array(cosine[q, v])], schema=kind)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """The k nearest vectors by cosine of each query, exact; a row without a vector has no neighbours and is none.

    Both sides are dealt into blocks of about `block` rows by a hash of their ids. Each pair of blocks is a group that
    gives its k best of each query, and these few are merged; nothing is broadcast, however many queries there are.
    """
    ship(vectors.sparkSession)
    vectors, queries = vectors.filter("v is not null"), queries.filter("q is not null")
    n_v, n_q = (max(1, math.ceil(rows.count() / block)) for rows in (vectors, queries))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.withColumn("qb", dealt("query_id", n_q)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))
    right = vectors.withColumn("vb", dealt("vec_id", n_v)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    best = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(best_of_cell(k), "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")


def q_j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the stated query set, every vector whose id is divisible by 100, among all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return nearest(rows, rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))


def q_o02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(ranked(listings(spark, sf_dir)), cursor=(float("inf"), datetime(1997, 1, 1), 5_000)).select("listing_id", "rank", "last_seen")


def q_o03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(ranked(listings(spark, sf_dir)), sort="price", limit=99, offset=50).select("listing_id", "price")


def q_o04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of 100 of which 60 are kept for the first cohort; what it doesn't use goes to the second."""
    rows = scores(spark, sf_dir)
    cohort = F.when((F.col("flagged")) & (F.col("tier") == "free"), 1).when(F.col("title_fit") == 5, 2)
    w = Window.partitionBy("cohort").orderBy(F.desc("text_length"), "listing_id")
    some = rows.withColumn("cohort", cohort).filter("cohort is not null").withColumn("r", F.row_number().over(w).cast("long")).filter("r <= 100")
    used = F.least(F.count_if(F.col("cohort") == 1).over(Window.partitionBy()), F.lit(60))
    return some.withColumn("used", used).filter(F.when(F.col("cohort") == 1, F.col("r") <= 60).otherwise(F.col("r") <= 100 - F.col("used"))).select("cohort", "listing_id", "r")


def q_o05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by a test, then by a case's rank."""
    rank = F.when(F.col("stratum") == "P", 0).when(F.col("stratum") == "O", 1).otherwise(2)
    rows = listings(spark, sf_dir).select("listing_id", rank.alias("rank"), (F.col("flag") == "R").alias("flagged"))
    return rows.orderBy(F.desc("flagged"), "rank", "listing_id").limit(40)


def q_o06(spark: SparkSession, sf_dir: str, k: int = 8) -> DataFrame:
    """K rows of each company spread evenly over its order by id."""
    w = Window.partitionBy("company_id")
    rows = listings(spark, sf_dir).select("company_id", "listing_id", (F.row_number().over(w.orderBy("listing_id")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    spread = (F.col("n") <= k) | (F.floor(F.col("i") * k / F.col("n")) != F.floor((F.col("i") - 1) * k / F.col("n")))
    return rows.filter(spread).select("company_id", "listing_id")


def q_u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cohorts stacked, what is new against the time before, and rows missing from a set."""
    rows = listings(spark, sf_dir).select("company_id", "part_id", "last_seen")
    now, then = (rows.filter(t).select("company_id", "part_id").distinct() for t in (F.col("last_seen") >= as_of(), F.col("last_seen") < as_of()))
    tally = lambda df, name: df.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(name))
    return tally(now.exceptAll(then), "new").unionByName(tally(now.intersect(then), "kept")).unionByName(tally(then.subtract(now), "gone"))


def q_u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole text's words as an ordered set of reasons: one appended if absent, one removed in place; how many of three words it shares."""
    words = F.split("text", r"\s+")
    add = lambda a, x: F.when(F.array_contains(a, x), a).otherwise(F.concat(a, F.array(F.lit(x))))
    rows = table(spark, sf_dir, "documents").withColumn("w", words)
    told = lambda a: F.md5(F.array_join(a, " "))
    removed = F.filter("w", lambda x: x != "the")
    return rows.select("doc_id", told(add(F.col("w"), "the")).alias("added"), told(removed).alias("removed"), F.size(removed).alias("n_removed"), F.size(F.array_intersect("w", F.array(F.lit("the"), F.lit("of"), F.lit("de")))).alias("overlap"))


def q_u06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetched set must hold one earlier filing at least, else it is downgraded."""
    fetched = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    filed = listings(spark, sf_dir).filter(F.col("quantity") == 50).select(F.floor(F.col("listing_id") / 10).alias("o_orderkey")).distinct().withColumn("filed", F.lit(1))
    return fetched.join(filed, "o_orderkey", "left").groupBy("o_custkey").agg(F.when(F.count("filed") > 0, "trusted").otherwise("downgraded").alias("state"), F.count(F.lit(1)).alias("n"))


def q_w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trailing baseline without the current row, the gap to the row before, and a share of the total."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    past = F.expr("percentile(o_totalprice, 0.9)").over(w.rowsBetween(-10, -1))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(past, 4).alias("p90"), F.timestamp_diff("HOUR", F.lag("o_orderdate").over(w), F.col("o_orderdate")).alias("gap_hours"), F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 8).alias("share"))


_LAST = f"""{LISTINGS}, last_scan as (select * from supplier left join (select company_id, max(last_seen) as last_scan, count(*) as n from listings where last_seen < timestamp '{AS_OF}' group by 1) on s_suppkey = company_id)"""
_RANKED = f"""{LISTINGS}, ranked as (select *, case when listing_id % 3 = 0 then round(price / 1000, 3) when listing_id % 331 = 1 then 'nan'::double when listing_id % 333 = 2 then 'inf'::double end as rank from listings)"""
_MEAN = "(" + " + ".join(AXES) + ") / 6.0"
_TAIL = "order by rank desc nulls last, last_seen desc nulls last, listing_id desc"
QUERIES = {
    "F01_feed_filter": q_f01, "F04_seek": q_f04, "F05_lookup": q_f05, "F06_due": q_f06, "F07_eligible": q_f07, "F09_lanes": q_f09, "F10_bench": q_f10, "F11_last_event": q_f11,
    "F12_adjudication": q_f12, "F13_skip_reason": q_f13, "F14_exclusion": q_f14, "F15_not_in": q_f15, "F16_candidates": q_f16, "F18_resweep": q_f18, "F19_contains": q_f19, "F20_json_key": q_f20,
    "F21_target_set": q_f21, "F22_signatures": q_f22, "F23_reaper": q_f23, "F24_unverifiable": q_f24, "F26_canonical_pages": q_f26, "F27_consent": q_f27,
    "J01_overlays": q_j01, "J03_join_counts": q_j03, "J08_latest_value": q_j08, "J09_siblings": q_j09, "J10_filtered_join": q_j10, "J11_secondary_key": q_j11, "J12_resolution": q_j12,
    "J13_title_sets": q_j13, "J16_nearest": q_j16, "O02_seek_page": q_o02, "O03_offset_page": q_o03, "O04_cohort_batch": q_o04, "O05_case_order": q_o05, "O06_spread_sample": q_o06,
    "U01_set_changes": q_u01, "U04_ordered_sets": q_u04, "U06_trusted_sets": q_u06, "W03_baselines": q_w03,
}
ORACLES = {
    "F01_feed_filter": f"with {LISTINGS} select listing_id, company_id, priority, flag from listings where company_id in (1, 2, 3, 5, 8) and priority like '%URGENT%' and flag is distinct from 'R'",
    "F04_seek": f"""with {_RANKED} select listing_id, last_seen from ranked where rank is null and (last_seen < timestamp '1996-06-01' or (last_seen = timestamp '1996-06-01' and listing_id < 100))""",
    "F05_lookup": f"""with {LISTINGS} select pos, listing_id, price from listings join (values (0, 331), (1, 11), (2, 999999999), (3, 71), (4, 12)) v(pos, id) on id = listing_id""",
    "F06_due": f"with {_LAST} select s_suppkey, s_name, last_scan from last_scan where s_acctbal > 0 and (last_scan is null or last_scan < timestamp '{AS_OF}' - interval 8 hours)",
    "F07_eligible": f"""with {_LAST}, s as (select *, case when s_acctbal < 0 then 'error' when s_acctbal < 3000 then 'miss' else 'hit' end as status from last_scan)
select s_suppkey, count(*) over () as eligible from s where (status = 'hit' or (status = 'error' and s_suppkey % 3 < 2)) and s_nationkey not in (3, 7) and s_name is not null
  and not coalesce(coalesce(n, 0) < 5 and last_scan > timestamp '{AS_OF}' - interval 3 days, false)""",
    "F09_lanes": f"""with {LISTINGS}, w as (select distinct company_id from listings where flag = 'R' and quantity >= 49)
select s_suppkey, s_name, 1 as lane from supplier where exists (select 1 from w where company_id = s_suppkey)
union all (select s_suppkey, s_name, 2 from supplier where not exists (select 1 from w where company_id = s_suppkey) order by s_suppkey limit 20)""",
    "F10_bench": f"""with {LISTINGS} select company_id, count(*) filter (flag = 'N' and quantity = 50) as hits,
  count(*) filter (flag <> 'N' and last_seen >= timestamp '{AS_OF}' - interval 700 days and discount <> 0) as strikes from listings group by 1 having hits = 0 and strikes >= 5""",
    "F11_last_event": "select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1 and event_type = 'error'",
    "F12_adjudication": """with r as (select doc_id, text, case when doc_id % 4 <> 0 then (doc_id % 4)::int end as version,
  list_filter([case when n_chars < 200 then 'short' end, case when lang <> 'en' then 'foreign' end, case when doc_id % 11 = 0 then 'blocked' end], lambda x: x is not null) as reasons from documents)
select doc_id, version, array_to_string(reasons, ',') as reasons from r where trim(text) <> '' and not list_has_any(reasons, ['short', 'blocked']) and (version is null or version < 3)""",
    "F13_skip_reason": f"""with {SCORES} select case when text_length < 300 then 'awaiting_text' when location_fit = 1 then 'awaiting_location' when tier is not distinct from 'exhausted' and text_length < 900 then 'awaiting_adjudication' end as reason,
  count(*) as n from scores group by 1""",
    "F14_exclusion": f"""with {LISTINGS} select case when contains(lower(p_name), 'red') then 'title' when company_id in (4, 9, 16, 25) then 'company' when price < 17000 then 'pay' else 'kept' end as rule,
  count(*) as n, round(sum(price), 2) as price from listings join part on part_id = p_partkey group by 1""",
    "F15_not_in": f"with {SCORES} select tier, count(*) as n from scores where tier not in ('exhausted', 'expired') group by 1",
    "F16_candidates": f"""with {SCORES} select listing_id, case when skills_match > 2 then scored_at end as checked_at from scores left join supplier on company_id = s_suppkey
where (title_fit < 3 or scored_at < timestamp '{AS_OF}' - interval 30 days) and s_acctbal > 0 order by checked_at nulls first, listing_id""",
    "F18_resweep": r"select doc_id, case when doc_id % 3 > 0 then (doc_id % 3)::int end as version from documents where (case when doc_id % 3 > 0 then doc_id % 3 end) is distinct from 2 and regexp_matches(text, '\S')",
    "F19_contains": f"with {POSTINGS} select doc_id, array_to_string(sources, '+') as tags from postings where list_contains(sources, 'portal_jooble')",
    "F20_json_key": "select event_type, count(*) as n from events where json_extract_string(props, '$.k') is distinct from '7' group by 1",
    "F21_target_set": f"with {SCORES} select listing_id, round({_MEAN}, 6) as mean from scores where {_MEAN} >= 3.5 and not flagged and least({', '.join(AXES)}) > 1",
    "F22_signatures": """with e as (select event_id, json_extract_string(props, '$.k') as v from events), d as (select *, try_cast(v as double) as x from e),
h as (select event_id, list_filter([case when x > 50 then {'s': 2, 'n': 'big_value'} end, case when v = '7' then {'s': 3, 'n': 'odd_seven'} end,
  case when v is not null and v not in ('', '0', 'false', 'null') then {'s': 1, 'n': 'has_k'} end, case when contains(v, '9') then {'s': 1, 'n': 'nine'} end, case when x <= 3 then {'s': 2, 'n': 'small'} end], lambda z: z is not null) as h from d)
select event_id, len(h)::int as n, list_max(list_transform(h, lambda z: z.s))::int as worst, array_to_string(list_sort(list_transform(h, lambda z: z.n)), ',') as names from h where len(h) > 0""",
    "F23_reaper": f"select c_custkey, c_mktsegment from customer where starts_with(c_mktsegment, 'B') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate < timestamp '{AS_OF}')",
    "F24_unverifiable": f"""with {POSTINGS} select doc_id, len(list_filter(sources, lambda s: s not in ('linkedin', 'glassdoor', 'indeed', 'portal_jooble', 'portal_adzuna', 'dataforseo', 'primary_source_llm'))) = 0 as unverifiable,
  len(list_filter(sources, lambda s: starts_with(s, 'portal_'))) > 0 as opaque from postings""",
    "F26_canonical_pages": r"select page_id, url from pages where not contains(url, 'utm_') and starts_with(url, 'http') and regexp_matches(url, '^[a-z]+://[^/?#]+/.')",
    "F27_consent": """with v as (select *, json_extract_string(props, '$.k')::int % 4 as version from events)
select user_id, count(*) filter (event_type = 'signup') > 0 as signed_up, arg_max(event_type, (ts, event_id)) as latest, arg_max(version, (ts, event_id)) as version from v where version <= 2 group by 1""",
    "J01_overlays": f"""with {LISTINGS} select listing_id, company_id, o_orderstatus as status, exists (select 1 from listings w where w.user_id = 7 and w.company_id = l.company_id) as watched
from listings l left join (select * from orders where o_custkey = 7) o on l.listing_id = o_orderkey * 10 + 1 where company_id <= 10""",
    "J03_join_counts": f"""with {LISTINGS}, s as (select * from supplier where s_suppkey % 7 > 0)
select 'inner' as kind, count(*) as n from listings join s on company_id = s_suppkey where stratum in ('F', 'P')
union all select 'anti', count(*) from listings anti join s on company_id = s_suppkey
union all select coalesce(nullif(substr(s_name, 1, 8), ''), 'none'), count(*) from listings left join s on company_id = s_suppkey group by 1""",
    "J08_latest_value": f"""with {LISTINGS} select s_suppkey, (select price from listings where company_id = s_suppkey order by last_seen desc, listing_id desc limit 1) as latest_price,
  (select count(*) from listings where company_id = s_suppkey) as n from supplier""",
    "J09_siblings": f"""with {LISTINGS}, d as (select company_id, listing_id, max(last_seen) as last_seen from listings group by all),
r as (select company_id, listing_id, row_number() over (partition by company_id order by last_seen desc, listing_id desc) as r from d)
select * from (select a.listing_id, b.listing_id as sibling, row_number() over (partition by a.company_id, a.listing_id order by b.r) as k from r a join r b on a.company_id = b.company_id and a.listing_id <> b.listing_id where b.r <= 6) where k <= 5""",
    "J10_filtered_join": "select c_custkey, count(*) filter (event_type = 'error') as errors, max(ts) filter (event_type = 'purchase') as last_purchase from customer join events on c_custkey = user_id group by 1",
    "J11_secondary_key": """select event_id, coalesce(o_custkey, s_suppkey) as match, case when o_custkey is not null then 'key' when s_suppkey is not null then 'source' else 'none' end as how
from events left join orders on event_id % 3000 = o_orderkey left join supplier on user_id % 50 = s_suppkey""",
    "J12_resolution": r"""with n as (select p_partkey, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) as title, string_split(lower(p_type), ' ') as tokens from part),
p as (select a.p_partkey as job, b.p_partkey as posting, list_has_any(a.tokens, b.tokens) as near from n a join n b on a.title = b.title where a.p_partkey % 2 = 0 and b.p_partkey % 2 = 1),
g as (select job, count(*) as n, count(*) filter (near) as n_near, min(posting) filter (near) as near, min(posting) as only_one from p group by 1)
select job, n, n_near, case when n = 1 then 'strict' when n_near = 1 then 'loose' else 'ambiguous' end as verdict, case when n = 1 then only_one when n_near = 1 then near end as posting from g""",
    "J13_title_sets": r"""with t as (select *, regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+') as w from part)
select p_partkey, p_name, p_type from t where (list_has_all(w, ['red', 'green']) or list_has_all(w, ['small']) or list_has_all(w, ['large', 'steel'])
  or regexp_matches(lower(p_name), '\bred green\b|\bsmall\b|\blarge steel\b')) and not list_contains(w, 'blue')""",
    "J16_nearest": """with p as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as cosine from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
select query_id, rank, vec_id, cosine from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from p) where rank <= 5""",
    "O02_seek_page": f"""with {_RANKED}, k as (select * from ranked where (rank is not null and not isnan(rank) and (rank < 'inf'::double or (last_seen < timestamp '1997-01-01' or (last_seen = timestamp '1997-01-01' and listing_id < 5000)))) or rank is null)
select listing_id, rank, last_seen from k {_TAIL} limit 25""",
    "O03_offset_page": f"with {LISTINGS} select listing_id, price from listings order by price desc nulls last, listing_id desc limit 25 offset 50",
    "O04_cohort_batch": f"""with {SCORES}, c as (select listing_id, text_length, case when flagged and tier = 'free' then 1 when title_fit = 5 then 2 end as cohort from scores),
r as (select *, row_number() over (partition by cohort order by text_length desc, listing_id) as r from c where cohort is not null)
select cohort, listing_id, r from r where case when cohort = 1 then r <= 60 else r <= 100 - (select least(count(*), 60) from c where cohort = 1) end""",
    "O05_case_order": f"""with {LISTINGS} select listing_id, case stratum when 'P' then 0 when 'O' then 1 else 2 end as rank, flag = 'R' as flagged from listings order by flagged desc, rank, listing_id limit 40""",
    "O06_spread_sample": f"""with {LISTINGS}, r as (select company_id, listing_id, row_number() over (partition by company_id order by listing_id) - 1 as i, count(*) over (partition by company_id) as n from listings)
select company_id, listing_id from r where n <= 8 or floor(i * 8 / n) <> floor((i - 1) * 8 / n)""",
    "U01_set_changes": f"""with {LISTINGS}, a as (select distinct company_id, part_id from listings where last_seen >= timestamp '{AS_OF}'), b as (select distinct company_id, part_id from listings where last_seen < timestamp '{AS_OF}')
select company_id, count(*) as n, 'new' as kind from (select * from a except select * from b) group by 1
union all select company_id, count(*), 'kept' from (select * from a intersect select * from b) group by 1
union all select company_id, count(*), 'gone' from (select * from b except select * from a) group by 1""",
    "U04_ordered_sets": r"""with w as (select doc_id, regexp_split_to_array(text, '[ \t\n\x0b\f\r]+') as w from documents), k as (select *, list_filter(w, lambda x: x <> 'the') as removed from w)
select doc_id, md5(array_to_string(case when list_contains(w, 'the') then w else w || ['the'] end, ' ')) as added, md5(array_to_string(removed, ' ')) as removed, len(removed)::int as n_removed,
  len(list_intersect(list_distinct(w), ['the', 'of', 'de']))::int as overlap from k""",
    "U06_trusted_sets": f"""with {LISTINGS}, f as (select distinct listing_id // 10 as k from listings where quantity = 50)
select o_custkey, case when count(k) > 0 then 'trusted' else 'downgraded' end as state, count(*) as n from orders left join f on o_orderkey = k group by 1""",
    "W03_baselines": """select o_orderkey, round(quantile_cont(o_totalprice, 0.9) over (w rows between 10 preceding and 1 preceding), 4) as p90,
  (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) over w)) // 3600000000 as gap_hours, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 8) as share
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
}
