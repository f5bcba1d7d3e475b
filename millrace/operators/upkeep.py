"""Attribution, free-target writes, slugs, title sweeps, missing fields, append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.names import NAMED, company_key, key_sql, named, repeated_suffix_sql, title_key, title_key_sql, without_repeated_suffix
from millrace.operators.rules import ladder
from millrace.plans.projections import let, table
from millrace.streaming.events import shared_folder

# A small gazetteer (city, country, population) for names that several countries share.
CITIES = (("boston", "US", 675_000), ("boston", "GB", 45_000), ("paris", "FR", 2_100_000), ("paris", "US", 24_000), ("oslo", "NO", 700_000), ("lima", "PE", 9_700_000), ("lima", "US", 35_000), ("bonn", "DE", 330_000))
COUNTRIES = {"united states": "US", "usa": "US", "france": "FR", "germany": "DE", "norway": "NO", "peru": "PE", "uk": "GB", "united kingdom": "GB"}


#: What comes off a title's text: requisition numbers, place tails, card junk.
REQUISITION = r"(?i)\s*[\(\[]?(?:req(?:uisition)?|job)\s*(?:id|#|no\.?)?\s*[:#-]?\s*[A-Z]{0,3}-?\d{3,}[\)\]]?"
PLACE_TAIL = r"(?i)\s*[-–|,]\s*(?:remote|hybrid|on-?site)\s*$"
CARD_JUNK = r"(?i)\s*(?:new|apply now|save job|full[- ]time)\s*$"


def slugs(name: Column) -> Column:
    """Slug candidates of a company name: joined, hyphenated, its first word, each once."""
    words = F.filter(F.split(F.regexp_replace(company_key(name), "[^a-z0-9 ]", ""), r"\s+"), lambda w: w != "")
    return let(words, lambda w: F.array_distinct(F.array(F.array_join(w, ""), F.array_join(w, "-"), F.element_at(F.concat(w, F.array(F.lit(""))), 1))))


def clean_title(title: Column) -> Column:
    """Requisition numbers, place tails, card junk and lone leading letters off a title, in that order."""
    s = title
    for pattern in (REQUISITION, PLACE_TAIL, CARD_JUNK):
        s = F.regexp_replace(s, pattern, "")
    return F.trim(F.regexp_replace(s, r"^[A-Z] (?=[A-Z][a-z])", ""))


def resolved_city(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """The city of (id, city, country): in the stated country; without one the United States' if several share the name; then the largest.

    The gazetteer is a literal of a few rows and is broadcast; a real one is a table of bounded size.
    """
    cities = spark.createDataFrame(list(CITIES), "name string, code string, people long")
    codes = F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair])
    named_rows = rows.withColumn("want", F.element_at(codes, F.lower("country"))).withColumn("name", F.lower("city"))
    found = named_rows.join(F.broadcast(cities), "name").filter(F.col("want").isNull() | (F.col("want") == F.col("code")))
    best = F.max(F.struct((F.col("code") == "US").cast("int").alias("us"), "people", "code"))
    largest = F.max(F.struct("people", "code"))
    per = found.groupBy("id", "name", "want").agg(best.alias("b"), largest.alias("l"), F.count(F.lit(1)).alias("n"))
    return per.select("id", "name", F.when(F.col("want").isNull() & (F.col("n") > 1) & (F.col("b.us") == 1), F.col("b.code")).otherwise(F.col("l.code")).alias("code"))


def q_x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(spark, sf_dir).select("p_partkey", F.array_join(slugs(F.col("company")), ",").alias("slugs"))


def q_x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.array(*[F.lit(x) for x in (" (Req #12345)", " - Remote", " | Hybrid", " Full-time", "", " Job ID: AB-9876")])
    title = F.concat(F.when(F.col("p_partkey") % 7 == 0, "R Data ").otherwise(""), "p_name", F.element_at(tail, (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", clean_title(title).alias("title"))


def q_j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    city, country = F.array(*[F.lit(x) for x in ("Boston", "Paris", "Oslo", "LIMA", "Bonn", "Nowhere")]), F.array(*[F.lit(x) for x in ("", "USA", "France", "UK", "Peru")])
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.element_at(city, (k % 6 + 1).cast("int")).alias("city"), F.element_at(country, (k % 5 + 1).cast("int")).alias("country"))
    return resolved_city(rows, spark)


def q_a30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of title rules over the corpus: per rule how many titles would change."""
    rows = named(spark, sf_dir)
    rules = {"repeated_suffix": without_repeated_suffix(F.col("title")), "clean": clean_title(F.col("title")), "key": title_key(F.col("title"))}
    return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), (~c.eqNullSafe(F.col("title"))).alias("changes")) for n, c in rules.items()])).alias("r")).groupBy("r.rule").agg(F.count(F.lit(1)).alias("n"), F.count_if("r.changes").alias("changed"))


def q_c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that a row still lacks, and the enrichment step that comes next."""
    lacks = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "pay"), F.when(F.col("c_nationkey") % 5 == 0, "place"), F.when(F.col("c_custkey") % 3 == 0, "text")))
    step = ladder([(F.array_contains(lacks, "text"), "fetch"), (F.size(lacks) > 1, "search"), (F.size(lacks) == 1, "extract")], "done")
    return table(spark, sf_dir, "customer").groupBy(F.array_join(lacks, "+").alias("lacks"), step.alias("next")).agg(F.count(F.lit(1)).alias("n"))


def q_c26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity conflict is evidence that none of the accepted names explains; no evidence is no conflict."""
    evidence = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r'href="https?://(?:www\.)?([a-z0-9-]+)\.'), F.lit(1)), F.lower))
    own = F.lower(F.regexp_extract("url", r"^[a-z]+://(?:www\.)?([a-zA-Z0-9-]+)\.", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(evidence).alias("evidence"), ((F.size(evidence) > 0) & ~F.array_contains(evidence, own)).alias("conflict"))


def q_c29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of navigation pages, by their first path part."""
    first = F.lower(F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)", 1))
    return table(spark, sf_dir, "pages").groupBy(first.isin("about", "contact", "login", "privacy", "terms", "").alias("navigation"), F.substring(first, 1, 3).alias("path")).agg(F.count(F.lit(1)).alias("n"))


def q_g02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribution is written if none is there or the new rank is better, and only to a slot that no other row holds."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("old"), F.max("l_suppkey").alias("wanted"), F.max("l_linenumber").alias("rank"))
    slots = Window.partitionBy("wanted").orderBy(F.desc("rank"), "l_partkey")
    out = rows.withColumn("place", F.row_number().over(slots))
    return out.groupBy(ladder([(F.col("wanted") == F.col("old"), "same"), (F.col("rank") < 3, "no_downgrade"), (F.col("place") > 1, "taken")], "written").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def q_s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log written in two runs and read back: rows per run and kind."""
    path = shared_folder(spark, "appends")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    for run in (1, 2):
        rows.filter(F.col("event_id") % 2 == run - 1).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("run").cast("int").alias("run"), "event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "X20_slugs": q_x20, "X09_clean_title": q_x09, "J14_cities": q_j14, "A30_title_sweep": q_a30, "C21_missing_fields": q_c21, "C26_identity": q_c26, "C29_navigation": q_c29, "G02_free_slots": q_g02, "S12_append_log": q_s12, 
}
_LACKS = "list_filter([case when c_acctbal < 0 then 'pay' end, case when c_nationkey % 5 = 0 then 'place' end, case when c_custkey % 3 = 0 then 'text' end], lambda x: x is not null)"


def clean_sql(t: str) -> str:
    for pattern in (REQUISITION, PLACE_TAIL, CARD_JUNK):
        t = f"regexp_replace({t}, '{pattern}', '', 'g')"
    return f"trim(regexp_replace({t}, '^[A-Z] ([A-Z][a-z])', '\\1'))"


_SLUG = "array_to_string([a] || case when b <> a then [b] else [] end || case when c not in (a, b) then [c] else [] end, ',')"
ORACLES = {
    "X09_clean_title": f"""with t as (select p_partkey, case when p_partkey % 7 = 0 then 'R Data ' else '' end || p_name || [' (Req #12345)', ' - Remote', ' | Hybrid', ' Full-time', '', ' Job ID: AB-9876'][(p_partkey % 6 + 1)::int] as title from part)
select p_partkey, {clean_sql('title')} as title from t""",
    "X20_slugs": f"""with {NAMED}, {key_sql("k", "named", "company")}, w as (select p_partkey, list_filter(regexp_split_to_array(regexp_replace(company, '[^a-z0-9 ]', '', 'g'), '\\s+'), lambda x: x <> '') as w from k),
s as (select p_partkey, coalesce(array_to_string(w, ''), '') as a, coalesce(array_to_string(w, '-'), '') as b, coalesce(w[1], '') as c from w) select p_partkey, {_SLUG} as slugs from s""",
    "A30_title_sweep": f"""with {NAMED}, c as (select unnest([{{'rule': 'repeated_suffix', 'c': {repeated_suffix_sql('title')} is distinct from title}}, {{'rule': 'clean', 'c': {clean_sql('title')} is distinct from title}}, {{'rule': 'key', 'c': {title_key_sql('title')} is distinct from title}}]) as r from named)
select r.rule as rule, count(*) as n, count(*) filter (r.c) as changed from c group by 1""",
    "J14_cities": f"""with g(name, code, people) as (values {", ".join(f"('{n}', '{c}', {p})" for n, c, p in CITIES)}),
r as (select c_custkey as id, lower(['Boston', 'Paris', 'Oslo', 'LIMA', 'Bonn', 'Nowhere'][(c_custkey % 6 + 1)::int]) as name, [null, 'US', 'FR', 'GB', 'PE'][(c_custkey % 5 + 1)::int] as want from customer),
f as (select id, r.name, want, code, people, count(*) over (partition by id) as n from r join g on r.name = g.name and (want is null or want = code))
select id, name, arg_max(code, (case when want is null and n > 1 and code = 'US' then 1 else 0 end, people)) as code from f group by id, name""",
    "C21_missing_fields": f"with l as (select {_LACKS} as l from customer) select array_to_string(l, '+') as lacks, case when list_contains(l, 'text') then 'fetch' when len(l) > 1 then 'search' when len(l) = 1 then 'extract' else 'done' end as next, count(*) as n from l group by all",
    "C26_identity": r"""with e as (select page_id, list_distinct(list_transform(regexp_extract_all(html, 'href="https?://(?:www\.)?([a-z0-9-]+)\.', 1), lambda x: lower(x))) as e, lower(regexp_extract(url, '^[a-z]+://(?:www\.)?([a-zA-Z0-9-]+)\.', 1)) as own from pages)
select page_id, len(e)::int as evidence, len(e) > 0 and not list_contains(e, own) as conflict from e""",
    "C29_navigation": r"with f as (select lower(regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]*)', 1)) as p from pages) select p in ('about', 'contact', 'login', 'privacy', 'terms', '') as navigation, substr(p, 1, 3) as path, count(*) as n from f group by all",
    "G02_free_slots": """with r as (select l_partkey, min(l_suppkey) as o, max(l_suppkey) as w, max(l_linenumber) as rank from lineitem group by 1), p as (select *, row_number() over (partition by w order by rank desc, l_partkey) as place from r)
select case when w = o then 'same' when rank < 3 then 'no_downgrade' when place > 1 then 'taken' else 'written' end as outcome, count(*) as n from p group by 1""",
    "S12_append_log": "select (event_id % 2 + 1)::int as run, event_type, count(*) as n from events group by all",
}
