"""Merges as pure functions of (current, batch), retention, change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.projections import LISTINGS, listings, table

AS_OF = "1996-01-01"


def keyed_merge(current: DataFrame, batch: DataFrame, keys: list[str], policy: str) -> DataFrame:
    """Rows of both by key. ignore keeps what is there, replace takes the batch's, coalesce fills nulls from what was there.

    One full outer join; the batch must hold a key once. The result is a new table: writing it is the caller's.
    """
    values = [c for c in current.columns if c not in keys]
    old, new = current.withColumn("_old", F.lit(True)).alias("o"), batch.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, keys, "full_outer")
    there, comes = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    pick = {
        "ignore": lambda c: F.when(there, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")),
        "replace": lambda c: F.when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")),
        "coalesce": lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")),
    }[policy]
    return joined.select(*keys, *[pick(c).alias(c) for c in values])


def folded(sightings: DataFrame) -> DataFrame:
    """Sightings (key, source, seen, tie, text, pay, posted, rank) folded per key as if applied one by one in order.

    Each rule of the fold is an associative minimum or maximum over (seen, tie): the first known pay, the longest text and of
    equal ones the first, the date of the best precision and of equal ones the first, sources in order of
    first sight. So partial sums do it, and a key with very many sightings is never gathered in a row.
    """
    order = F.struct("seen", "tie")
    per_source = sightings.groupBy("key", "source").agg(
        F.min(order).alias("first"), F.max("seen").alias("last_seen"),
        F.min(F.when(F.col("pay").isNotNull(), F.struct(order.alias("at"), "pay"))).alias("pay"),
        F.max(F.when(F.col("text").isNotNull(), F.struct(F.char_length("text").alias("n"), (-F.unix_micros(F.col("seen").cast("timestamp"))).alias("a"), (-F.col("tie")).alias("b"), "text"))).alias("text"),
        F.max(F.when(F.col("posted").isNotNull(), F.struct("rank", (-F.unix_micros(F.col("seen").cast("timestamp"))).alias("a"), (-F.col("tie")).alias("b"), "posted"))).alias("posted"),
    )
    return per_source.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("first", "source"))).alias("s"), F.max("last_seen").alias("last_seen"), F.min("pay").alias("pay"), F.max("text").alias("text"), F.max("posted").alias("posted")
    ).select("key", F.transform("s", lambda x: x["source"]).alias("sources"), "last_seen", F.col("pay.pay").alias("pay"), F.col("text.text").alias("text"), F.col("posted.posted").alias("posted"), F.col("posted.rank").alias("rank"))


def upsert(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Folded state of both, and each key's kind: inserted, updated (something canonical changed), touched (a new source), unchanged.

    Pay is filled only if unknown, a text only replaced by a longer one, a date only by better precision; sources are an ordered union;
    being seen again moves last_seen alone. Kinds are relative to the state before the batch.
    """
    o, n = current.alias("o"), batch.alias("n")
    j = o.join(n, F.col("o.key") == F.col("n.key"), "full_outer")
    has, new = F.col("o.key").isNotNull(), F.col("n.key").isNotNull()
    longer = F.coalesce(F.char_length("n.text"), F.lit(0)) > F.coalesce(F.char_length("o.text"), F.lit(0))
    better = F.coalesce(F.col("n.rank"), F.lit(0)) > F.coalesce(F.col("o.rank"), F.lit(0))
    filled = F.col("o.pay").isNull() & F.col("n.pay").isNotNull()
    none = F.array().cast("array<string>")
    added = F.filter(F.coalesce("n.sources", none), lambda s: ~F.array_contains(F.coalesce("o.sources", none), s))
    kind = F.when(~new, "absent").when(~has, "inserted").when(longer | better | filled, "updated").when(F.size(added) > 0, "touched").otherwise("unchanged")
    return j.select(
        F.coalesce("o.key", "n.key").alias("key"), F.concat(F.coalesce("o.sources", none), added).alias("sources"), F.greatest("o.last_seen", "n.last_seen").alias("last_seen"),
        F.coalesce("o.pay", "n.pay").alias("pay"), F.when(longer, F.col("n.text")).otherwise(F.col("o.text")).alias("text"),
        F.when(better, F.col("n.posted")).otherwise(F.col("o.posted")).alias("posted"), F.when(better, F.col("n.rank")).otherwise(F.col("o.rank")).alias("rank"), kind.alias("kind"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = (F.col("quantity") % 4).cast("int")
    return listings(spark, sf_dir).select(
        F.col("part_id").alias("key"), F.concat("flag", "stratum").alias("source"), F.col("last_seen").alias("seen"), F.col("listing_id").alias("tie"),
        F.when(F.col("listing_id") % 5 > 0, F.concat("priority", F.repeat(F.lit("x"), (F.col("quantity") % 7).cast("int")))).alias("text"),
        F.when(F.col("listing_id") % 3 == 0, F.col("price")).alias("pay"), F.when(rank > 0, F.col("first_seen")).alias("posted"), F.when(rank > 0, rank).alias("rank"),
    )


def q_g01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sightings(spark, sf_dir)
    # Repeated (part, moment, listing) rows would tie; one of them, the smallest, counts.
    now = F.lit(AS_OF).cast("timestamp_ntz")
    out = upsert(folded(rows.filter(F.col("seen") < now)), folded(rows.filter((F.col("seen") >= now) & (F.col("key") % 3 > 0))))
    return out.select("key", F.array_join("sources", ",").alias("sources"), "last_seen", F.char_length("text").alias("text_length"), "rank", F.col("pay").isNotNull().alias("paid"), "kind")


def _balances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), "s_name")
    new = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.col("c_name").alias("s_name"))
    return old, new


def q_g04(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _balances(spark, sf_dir)
    out = None
    for policy in ("ignore", "replace", "coalesce"):
        df = keyed_merge(old, new, ["id"], policy).withColumn("policy", F.lit(policy))
        out = df if out is None else out.unionByName(df)
    return out


def q_g06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What retention reaps and keeps, durable kinds apart."""
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    reaped = old & ~F.col("event_type").isin("signup", "purchase")
    return table(spark, sf_dir, "events").groupBy(F.when(reaped, "reaped").otherwise("kept").alias("fate"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def q_g07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per changed field, null-safe."""
    old, new = _balances(spark, sf_dir)
    j = old.alias("o").join(new.alias("n"), "id")
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new")) for c in ("s_name", "balance")])
    changed = j.select("id", F.explode(fields).alias("f")).filter(~F.col("f.old").eqNullSafe(F.col("f.new")))
    return changed.select("id", "f.field", F.col("f.new").isNull().alias("cleared"))


def q_g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way merge: a side that didn't change takes the other's; lists add up, capped."""
    old, new = _balances(spark, sf_dir)
    base, mine, fresh = F.col("o.balance"), F.col("n.balance"), F.when(F.col("id") % 8 == 0, F.col("o.balance") + 1).otherwise(F.col("o.balance"))
    j = old.alias("o").join(new.alias("n"), "id")
    lists = F.slice(F.array_union(F.sequence(F.lit(1), F.lit(3)), F.sequence(F.lit(2), (F.col("id") % 5 + 2).cast("int"))), 1, 5)
    return j.select("id", F.when(mine.eqNullSafe(base), fresh).otherwise(mine).alias("balance"), F.array_join(lists.cast("array<string>"), ",").alias("keys"))


def q_g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that pass validation and the consent gate; durable kinds bypass the gate; a payload key is renamed."""
    k = F.get_json_object("props", "$.k").cast("int")
    consent = F.col("user_id") % 3 > 0
    valid = k.isNotNull() & (k <= 90) & (F.char_length("props") <= 200)
    rows = table(spark, sf_dir, "events").filter(valid & (consent | F.col("event_type").isin("signup", "purchase")))
    renamed = F.transform_keys(F.from_json("props", "map<string,string>"), lambda a, _: F.when(a == "k", "key").otherwise(a))
    return rows.select("event_id", F.to_json(renamed).alias("payload"))


def q_g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cut to their target unless another row already has it or two want it."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.regexp_replace("p_name", r"^\w+ ", "").alias("target"))
    taken = rows.select(F.col("name").alias("target")).distinct().withColumn("taken", F.lit(True))
    w = Window.partitionBy("target")
    out = rows.join(taken, "target", "left").withColumn("wanted", F.count(F.lit(1)).over(w))
    return out.groupBy(F.when(F.col("target") == F.col("name"), "same").when(F.col("taken").isNotNull(), "taken").when(F.col("wanted") > 1, "contested").otherwise("renamed").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def q_r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed JSON told from null and from empty; typed reading; ordered filter of array elements."""
    raw = F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 10 == 1, F.lit(None)).when(F.col("event_id") % 10 == 2, "[]").otherwise(F.concat(F.lit('["a","'), F.col("event_type"), F.lit('","b"]')))
    parsed = F.from_json(raw, "array<string>")
    state = F.when(raw.isNull(), "null").when(parsed.isNull(), "malformed").when(F.size(parsed) == 0, "empty").otherwise("list")
    return table(spark, sf_dir, "events").groupBy(state.alias("state"), F.array_join(F.filter(parsed, lambda x: x != "a"), "+").alias("rest")).agg(F.count(F.lit(1)).alias("n"))


def q_r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in order of first sight without regard to case, Remote and Hybrid first; per source first and last sight."""
    rows = listings(spark, sf_dir).withColumn("place", F.element_at(F.array(*[F.lit(x) for x in ("Remote", "remote", "Oslo", "OSLO", "Hybrid", "Lima")]), (F.col("listing_id") % 6 + 1).cast("int")))
    per = rows.groupBy("company_id", F.lower("place").alias("k")).agg(F.min(F.struct("last_seen", "listing_id", "place")).alias("f"), F.max("last_seen").alias("last"), F.count(F.lit(1)).alias("n"))
    first = F.struct((~F.col("k").isin("remote", "hybrid")).alias("later"), F.col("f"), F.col("n"))
    out = per.groupBy("company_id").agg(F.array_sort(F.collect_list(first)).alias("s"), F.max("last").alias("last_seen"))
    return out.select("company_id", F.array_join(F.transform("s", lambda x: x["f"]["place"]), ",").alias("places"), "last_seen")


_ORDER = "(seen, tie)"
_FOLD = """select key, source, min((seen, tie)) as first, max(seen) as last_seen, arg_min(pay, (seen, tie)) filter (pay is not null) as pay, min((seen, tie)) filter (pay is not null) as pay_at,
    max({{'n': length(text), 'a': -epoch_us(seen), 'b': -tie, 'text': text}}) filter (text is not null) as text,
    max({{'rank': rank, 'a': -epoch_us(seen), 'b': -tie, 'posted': posted}}) filter (posted is not null) as posted from sightings where {where} group by key, source"""
_STATE = "select key, list(source order by first) as sources, max(last_seen) as last_seen, count(pay_at) > 0 as paid, max(text).text as text, max(posted).rank as rank from ({fold}) group by key"
QUERIES = {"G01_upsert": q_g01, "G04_keyed_merge": q_g04, "G06_retention": q_g06, "G07_changes": q_g07, "G10_three_way": q_g10, "G14_event_gate": q_g14, "G15_rename": q_g15, "R01_json_states": q_r01, "R05_ordered_places": q_r05}
ORACLES = {
    "G01_upsert": f"""with {LISTINGS}, sightings as (select part_id as key, flag || stratum as source, last_seen as seen, listing_id as tie, case when listing_id % 5 > 0 then priority || repeat('x', (quantity % 7)::int) end as text,
    case when listing_id % 3 = 0 then price end as pay, case when quantity % 4 > 0 then first_seen end as posted, case when quantity % 4 > 0 then (quantity % 4)::int end as rank from listings),
o as ({_STATE.format(fold=_FOLD.format(where=f"seen < timestamp '{AS_OF}'"))}), n as ({_STATE.format(fold=_FOLD.format(where=f"seen >= timestamp '{AS_OF}' and key % 3 > 0"))}),
j as (select coalesce(o.key, n.key) as key, o.key is not null as has, n.key is not null as new, list_filter(coalesce(n.sources, []), lambda s: not list_contains(coalesce(o.sources, []), s)) as added, coalesce(o.sources, []) as os,
  greatest(o.last_seen, n.last_seen) as last_seen, o.text as ot, n.text as nt, o.rank as orank, n.rank as nrank, coalesce(o.paid, false) as op, coalesce(n.paid, false) as np from o full outer join n on o.key = n.key)
select key, array_to_string(os || added, ',') as sources, last_seen, length(case when coalesce(length(nt), 0) > coalesce(length(ot), 0) then nt else ot end)::int as text_length,
  case when coalesce(nrank, 0) > coalesce(orank, 0) then nrank else orank end as rank, op or np as paid,
  case when not new then 'absent' when not has then 'inserted' when coalesce(length(nt), 0) > coalesce(length(ot), 0) or coalesce(nrank, 0) > coalesce(orank, 0) or (not op and np) then 'updated' when len(added) > 0 then 'touched' else 'unchanged' end as kind from j""",
    "G04_keyed_merge": """with o as (select s_suppkey as id, s_acctbal as balance, s_name from supplier), n as (select c_custkey as id, case when c_acctbal > 0 then c_acctbal end as balance, c_name as s_name from customer where c_custkey % 4 = 0),
j as (select coalesce(o.id, n.id) as id, o.id is not null as has, n.id is not null as new, o.balance as ob, n.balance as nb, o.s_name as os, n.s_name as ns from o full outer join n on o.id = n.id)
select id, case when has then ob else nb end as balance, case when has then os else ns end as s_name, 'ignore' as policy from j
union all select id, case when new then nb else ob end, case when new then ns else os end, 'replace' from j
union all select id, coalesce(nb, ob), coalesce(ns, os), 'coalesce' from j""",
    "G06_retention": "select case when ts < timestamp '2024-01-15' and event_type not in ('signup', 'purchase') then 'reaped' else 'kept' end as fate, event_type, count(*) as n from events group by all",
    "G07_changes": """with j as (select s_suppkey as id, s_acctbal as ob, case when c_acctbal > 0 then c_acctbal end as nb, s_name as os, c_name as ns from supplier join customer on s_suppkey = c_custkey where c_custkey % 4 = 0)
select id, 's_name' as field, ns is null as cleared from j where os is distinct from ns union all select id, 'balance', nb is null from j where ob is distinct from nb""",
    "G10_three_way": """select s_suppkey as id, case when (case when c_acctbal > 0 then c_acctbal end) is not distinct from s_acctbal then case when s_suppkey % 8 = 0 then s_acctbal + 1 else s_acctbal end else case when c_acctbal > 0 then c_acctbal end end as balance,
  array_to_string(list_sort(list_distinct([1, 2, 3] || range(2, (s_suppkey % 5 + 3)::bigint)))[1:5], ',') as keys from supplier join customer on s_suppkey = c_custkey where c_custkey % 4 = 0""",
    "G14_event_gate": """select event_id, '{"key":"' || json_extract_string(props, '$.k') || '"}' as payload from events where json_extract_string(props, '$.k')::int <= 90 and length(props) <= 200 and (user_id % 3 > 0 or event_type in ('signup', 'purchase'))""",
    "G15_rename": r"""with r as (select p_name as name, regexp_replace(p_name, '^\w+ ', '') as target from part), w as (select *, count(*) over (partition by target) as wanted, target in (select name from r) as taken from r)
select case when target = name then 'same' when taken then 'taken' when wanted > 1 then 'contested' else 'renamed' end as outcome, count(*) as n from w group by 1""",
    "R01_json_states": """select case event_id % 10 when 0 then 'malformed' when 1 then 'null' when 2 then 'empty' else 'list' end as state,
  case when event_id % 10 in (0, 1) then null when event_id % 10 = 2 then '' else event_type || '+b' end as rest, count(*) as n from events group by all""",
    "R05_ordered_places": f"""with {LISTINGS}, p as (select *, ['Remote', 'remote', 'Oslo', 'OSLO', 'Hybrid', 'Lima'][(listing_id % 6 + 1)::int] as place from listings),
g as (select company_id, lower(place) as k, min((last_seen, listing_id, place)) as f, arg_min(place, (last_seen, listing_id, place)) as first, max(last_seen) as last from p group by all)
select company_id, string_agg(first, ',' order by k not in ('remote', 'hybrid'), f) as places, max(last) as last_seen from g group by 1""",
}
