"""Places out of free text by a gazetteer of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.phrases import said
from millrace.operators.cohorts import places
from millrace.plans.bounds import sent_whole
from millrace.plans.projections import table

# Wordings of a workplace in order of precedence, the tags of a posting's body, aliases of countries, what parts edges.
WORKPLACES = (
    ("REMOTE", ("fully remote", "remote only", "remote-only", "remoteonly", "remote")),
    ("HYBRID", ("hybrid",)),
    ("ONSITE", ("on site", "on-site", "onsite", "in office", "in-office", "inoffice")),
)
TAGS = (("REMOTE", "Remote"), ("HYBRID", "Hybrid"), ("ONSITE", "Onsite"))
ALIASES = {"uk": "GB", "u.k.": "GB", "usa": "US", "u.s.a.": "US", "u.s.": "US", "america": "US"}
EDGES = " \t\n\r-–—,/;|"
NO_PLACE = "struct<city:string,region:string,region_code:string,country:string,country_code:string,workplace:string,raw:string,unresolved:boolean>"


@dataclass
class Gazetteer:
    """Lookup tables, each with one row for a key, broadcast only if their counted bytes allow.

    anchors: key -> country_code, country, and whether the key is a region's code of the home country.
    regions: (country_code, key) -> region_code, region. cities: key -> candidates, the largest first.
    """

    anchors: DataFrame
    regions: DataFrame
    cities: DataFrame
    home: str
    home_name: str


def gazetteer(countries: DataFrame, regions: DataFrame, cities: DataFrame, home: str = "US", aliases: dict[str, str] = ALIASES, most_bytes: int = 32_000_000) -> Gazetteer:
    """Lookup tables out of countries (code, code3, name, official), regions (country_code, code, name) and cities (id, name, others, country_code, region_code, people).

    An alias comes before a code, a code before a name; of a country's regions a code comes before a name; of
    cities that share a name the largest comes first, then the smaller id. A city is found by its other names too.
    """
    spark = countries.sparkSession
    low = lambda c: F.lower(F.trim(c))
    forms = F.array(*[F.struct(F.lit(r).alias("r"), low(F.col(c)).alias("key")) for r, c in ((1, "code"), (2, "code3"), (3, "name"), (4, "official"))])
    known = countries.select("code", "name", F.explode(forms).alias("f")).select("code", "name", "f.*")
    by_hand = spark.createDataFrame(list(aliases.items()), "key string, code string").join(countries.select("code", "name"), "code").withColumn("r", F.lit(0))
    keys = known.unionByName(by_hand).filter("key <> ''").groupBy("key").agg(F.min_by(F.struct("code", "name"), F.struct("r", "code")).alias("c"))
    states = regions.filter(F.col("country_code") == home).select(low(F.col("code")).alias("key"), F.lit(True).alias("state")).distinct()
    anchors = keys.join(states, "key", "full").select("key", F.col("c.code").alias("country_code"), F.col("c.name").alias("country"), F.coalesce("state", F.lit(False)).alias("state"))
    forms = F.array(F.struct(F.lit(0).alias("r"), low(F.col("code")).alias("key")), F.struct(F.lit(1).alias("r"), low(F.col("name")).alias("key")))
    parts = regions.select("country_code", F.upper("code").alias("code"), "name", F.explode(forms).alias("f")).groupBy("country_code", "f.key").agg(F.min_by(F.struct("code", "name"), F.struct("f.r", "code")).alias("p"))
    parts = parts.select("country_code", "key", F.col("p.code").alias("region_code"), F.col("p.name").alias("region"))
    names = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("others", F.array().cast("array<string>"))), low))
    named = cities.join(countries.select(F.col("code").alias("country_code"), F.col("name").alias("country")), "country_code", "left")
    named = named.join(regions.select("country_code", F.upper("code").alias("region_code"), F.col("name").alias("region")), ["country_code", "region_code"], "left")
    one = F.struct((-F.coalesce("people", F.lit(0))).alias("order"), "id", F.col("name").alias("city"), "country_code", "country", "region_code", "region")
    towns = named.select(F.explode(names).alias("key"), one.alias("one")).filter("key <> ''").groupBy("key").agg(F.array_sort(F.collect_set("one")).alias("candidates"))
    home_name = (countries.filter(F.col("code") == home).select("name").first() or [home])[0]
    return Gazetteer(*[sent_whole(x, most_bytes) for x in (anchors, parts, towns)], home, home_name)


def workplace_of(text: Column) -> Column:
    """The first workplace that a text names by its precedence, or UNSPECIFIED."""
    out = F.lit("UNSPECIFIED")
    for name, wordings in reversed(WORKPLACES):
        out = F.when(text.rlike(said(wordings)), name).otherwise(out)
    return out


def without_workplace(text: Column) -> Column:
    """The text without all wordings of the workplace that it names, and without what parted them from the rest."""
    out = text
    for name, wordings in reversed(WORKPLACES):
        out = F.when(workplace_of(text) == name, F.regexp_replace(text, said(wordings), " ")).otherwise(out)
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(EDGES))


def tagged_workplace(body: Column) -> Column:
    """What a posting's body says by a hashtag; prose is not read."""
    out = F.lit("UNSPECIFIED")
    for name, tag in reversed(TAGS):
        out = F.when(body.rlike(rf"(?i)#LI[\-\s]?{tag}\b"), name).otherwise(out)
    return out


def ending(text: Column) -> tuple[Column, Column]:
    """(text before, workplace) where a text ends in a slash and a bare workplace, which holds for all of it; else the text and null."""
    bare = F.lower(F.trim(F.element_at(F.split(text, r"\s+/\s+"), -1)))
    base = F.trim(F.regexp_replace(text, r"\s+/\s+(?:(?!\s/\s).)*$", ""))
    tail = F.when(F.size(F.split(text, r"\s+/\s+")) > 1, bare)
    out = F.lit(None).cast("string")
    for name, wordings in WORKPLACES:
        plain = [w for w in wordings if "only" not in w]
        out = F.when(F.regexp_replace(tail, r"\s+", " ").isin(*plain), name).otherwise(out)
    return F.when(out.isNull(), text).otherwise(base), out


def once(found: Column) -> Column:
    """Places without later ones of the same country, region, city and workplace."""
    same = lambda a, b: a["country_code"].eqNullSafe(b["country_code"]) & a["region_code"].eqNullSafe(b["region_code"]) & a["city"].eqNullSafe(b["city"]) & a["workplace"].eqNullSafe(b["workplace"])
    return F.aggregate(found, F.array().cast(f"array<{NO_PLACE}>"), lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def _segments(texts: DataFrame) -> DataFrame:
    """(t, at, raw, promoted) of texts (t array<string>): each place of each, in order."""
    cut_ = F.transform("t", lambda x: F.struct(*[c.alias(n) for c, n in zip(ending(x), ("base", "promoted"), strict=True)]))
    rows = texts.withColumn("e", cut_)
    rows = rows.withColumn("promoted", F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.col("e.promoted"), lambda p: p.isNotNull())), -1))
    rows = rows.withColumn("found", F.flatten(F.transform(F.filter(F.col("e.base"), lambda b: b.isNotNull()), places)))
    # A text of nothing but "/ Remote" says that much.
    alone = (F.size("found") == 0) & F.col("promoted").isNotNull()
    return rows.select("t", "promoted", F.posexplode(F.when(alone, F.array(F.lit(""))).otherwise(F.col("found"))).alias("at", "raw"))


def parsed_places(rows: DataFrame, by: Gazetteer, text: str = "place", body: str | None = None) -> DataFrame:
    """The rows with `places`, an array of NO_PLACE structs, in the order of the text; empty where there is none.

    `text` is a string or an array of strings. A text is parted into places, and each is read once whatever number of rows holds it: its workplace;
    then by its last part a country, or the home country where that part is one of its regions' codes and more parts stand before it; then a
    region of that country, if a part is left for the city; then, by the first part, a city: of the country if known, else of the home country if
    several share the name, of the region where that leaves any in the home country, the largest. A city fills in a missing country and, at home, a
    region. A place with neither city nor country is unresolved. A workplace behind a final slash holds for every place without one, a hashtag of the body for those that still have none.
    Null texts have no places. A hot text is one row of the texts read, and adaptive execution splits its rows where the results are joined back.
    """
    as_list = F.col(text) if dict(rows.dtypes)[text].startswith("array") else F.array(F.col(text))
    rows = rows.withColumn("_t", F.coalesce(as_list, F.array().cast("array<string>")))
    seen = _segments(rows.select(F.col("_t").alias("t")).distinct())
    dashed = F.regexp_extract("raw", r"^\s*(?i:remote)\s*[-–—]\s*(.+?)\s*$", 1)
    seen = seen.withColumns({"dash": F.lower(F.trim(dashed)), "workplace": workplace_of(F.col("raw")), "rest": without_workplace(F.col("raw"))})
    seen = seen.withColumn("parts", F.filter(F.transform(F.split("rest", ","), lambda p: F.trim(p)), lambda p: p != ""))
    key = lambda at: F.lower(F.try_element_at("parts", F.lit(at)))
    anchors = by.anchors
    seen = seen.join(anchors.select(F.col("key").alias("dash"), F.struct("country_code", "country").alias("whole")), "dash", "left")
    seen = seen.withColumn("last", key(-1)).join(anchors.select(F.col("key").alias("last"), F.struct("country_code", "country").alias("named"), "state"), "last", "left")
    whole = F.coalesce(F.col("whole.country_code").isNotNull() & (F.col("dash") != ""), F.lit(False))
    at_home = F.coalesce(F.col("state"), F.lit(False)) & (F.size("parts") >= 2)
    named = F.col("named.country_code").isNotNull() & ~at_home
    country = F.when(at_home, F.struct(F.lit(by.home).alias("country_code"), F.lit(by.home_name).alias("country"))).when(named, F.col("named"))
    all_but_last = F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0)))
    seen = seen.withColumns({"is_whole": whole, "c": F.when(whole, F.col("whole")).otherwise(country), "parts": F.when(whole, F.array().cast("array<string>")).when(named, all_but_last).otherwise(F.col("parts"))})
    may_hold = F.when(F.col("c").isNotNull() & (F.size("parts") >= 2), key(-1))
    seen = seen.withColumns({"region_key": may_hold, "in_country": F.col("c.country_code")})
    seen = seen.join(by.regions.select(F.col("country_code").alias("in_country"), F.col("key").alias("region_key"), F.struct("region_code", "region").alias("r")), ["in_country", "region_key"], "left")
    seen = seen.withColumn("parts", F.when(F.col("r").isNotNull(), all_but_last).otherwise(F.col("parts")))
    seen = seen.withColumn("city_key", key(1)).join(by.cities.select(F.col("key").alias("city_key"), "candidates"), "city_key", "left")

    some = lambda of, test: F.filter(of, test)
    or_all = lambda few, all_: F.when(F.size(few) > 0, few).otherwise(all_)
    in_country = F.when(F.col("c").isNotNull(), some("candidates", lambda x: x["country_code"] == F.col("in_country")))
    at_large = F.when(F.size("candidates") >= 2, or_all(some("candidates", lambda x: x["country_code"] == by.home), F.col("candidates"))).otherwise(F.col("candidates"))
    seen = seen.withColumn("candidates", F.coalesce(in_country, at_large))
    in_region = F.when(F.col("r").isNotNull() & (F.col("in_country") == by.home), or_all(some("candidates", lambda x: x["region_code"] == F.col("r.region_code")), F.col("candidates")))
    seen = seen.withColumn("city", F.try_element_at(F.coalesce(in_region, F.col("candidates")), F.lit(1)))
    code = F.coalesce(F.col("c.country_code"), F.col("city.country_code"))
    own = F.when(F.col("r").isNull() & (code == by.home), F.struct(F.when(F.col("city.region").isNotNull(), F.col("city.region_code")).alias("region_code"), F.col("city.region").alias("region")))
    region = F.coalesce(F.col("r"), own)
    workplace = F.when(F.col("is_whole"), "REMOTE").when(F.col("workplace") == "UNSPECIFIED", F.coalesce("promoted", F.lit("UNSPECIFIED"))).otherwise(F.col("workplace"))
    place = F.struct(
        F.col("city.city").alias("city"), region["region"].alias("region"), region["region_code"].alias("region_code"), F.when(F.col("c").isNotNull(), F.col("c.country")).otherwise(F.col("city.country")).alias("country"), code.alias("country_code"),
        workplace.alias("workplace"), F.when(F.col("raw") == "", F.col("t")[0]).otherwise(F.col("raw")).alias("raw"), (F.col("city").isNull() & code.isNull()).alias("unresolved"),
    )
    found = seen.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("at", place.alias("place")))).alias("found")).select(F.col("t").alias("_t"), once(F.col("found.place")).alias("places"))
    out = rows.join(found, "_t", "left").withColumn("places", F.coalesce("places", F.array().cast(f"array<{NO_PLACE}>"))).drop("_t")
    if body is None:
        return out
    tag = tagged_workplace(F.col(body))
    with_tag = F.transform("places", lambda p: p.withField("workplace", F.when((p["workplace"] == "UNSPECIFIED") & tag.isNotNull(), tag).otherwise(p["workplace"])))
    return out.withColumn("places", once(with_tag))


def tables_gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    """Nations as countries (the first is home), the five regions as every nation's regions, suppliers as towns with shared names."""
    nation, region, supplier = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    code = lambda c: F.concat(F.char(F.lit(65) + c), F.lit("Z"))
    countries = nation.select(code(F.col("n_nationkey")).alias("code"), F.concat(code(F.col("n_nationkey")), F.lit("Y")).alias("code3"), F.col("n_name").alias("name"), F.concat(F.lit("Republic of "), "n_name").alias("official"))
    regions = nation.crossJoin(F.broadcast(region)).select(code(F.col("n_nationkey")).alias("country_code"), F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("name"))
    k = F.col("s_suppkey")
    cities = supplier.select(k.alias("id"), F.concat(F.lit("Port "), k % 37).alias("name"), F.array("s_name").alias("others"), code(F.col("s_nationkey")).alias("country_code"), F.concat(F.lit("R"), k % 5).alias("region_code"), F.floor("s_acctbal").alias("people"))
    return gazetteer(countries, regions, cities, home="AZ", aliases={"zero": "AZ", "one": "BZ"})


def customer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' places in the shapes that boards use, and a body with or without a tag."""
    k, town, land = F.col("c_custkey"), F.concat(F.lit("Port "), F.col("c_custkey") % 41), F.concat(F.lit("NATION_"), F.col("c_nationkey"))
    code, part = F.concat(F.char(F.lit(65) + F.col("c_nationkey")), F.lit("Z")), F.concat(F.lit("r"), F.col("c_custkey") % 6)
    shapes = [
        F.concat(town, F.lit(", "), part), F.concat(town, F.lit(", "), land), F.concat(F.lit("Remote - "), code), F.concat(F.lit("Hybrid - "), town, F.lit(", "), part, F.lit(", "), code), F.concat(town, F.lit(" / On-Site")),
        F.concat(town, F.lit(", "), part, F.lit("; "), F.lit("port 3, zero or Remote")), F.lit("TBD"), F.concat(F.lit("nowhere, "), town), F.concat(F.lit("supplier#00000000"), k % 10, F.lit(", Republic of "), land), F.concat(F.lit("  "), town, F.lit(" | "), town),
        F.concat(land, F.lit(" & Fully Remote, ASIA")), F.lit(None).cast("string"), F.concat(town, F.lit(", AMERICA, "), code, F.lit("Y / Remote")),
    ]
    body = F.when(k % 4 == 0, F.concat("c_mktsegment", F.lit(" #LI-Hybrid"))).when(k % 4 == 1, F.lit("#LI-Hybridised remote"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*shapes), (k % len(shapes) + 1).cast("int")).alias("place"), body.alias("body"))


def q_c07(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsed_places(customer_texts(spark, sf_dir), tables_gazetteer(spark, sf_dir), body="body")
    return rows.select("c_custkey", F.posexplode("places").alias("at", "p")).select("c_custkey", "at", "p.*")


QUERIES = {"C07_places": q_c07}
ORACLES = {
    "C07_places": r"""with lands as (select chr(65 + n_nationkey) || 'Z' as code, n_name as name from nation),
names as (select lower(code) as key, code, name from lands union select lower(code) || 'y', code, name from lands union select lower(name), code, name from lands union select 'republic of ' || lower(name), code, name from lands
  union select * from (select case code when 'AZ' then 'zero' else 'one' end as key, code, name from lands where code in ('AZ', 'BZ'))),
towns as (select s_suppkey as id, 'Port ' || (s_suppkey % 37) as city, lower(s_name) as other, chr(65 + s_nationkey) || 'Z' as land, s_suppkey % 5 as part, floor(s_acctbal) as people from supplier),
keyed as (select lower(city) as key, * from towns union all select other, * from towns),
texts as (select c_custkey, [
    town || ', ' || part, town || ', ' || land, 'Remote - ' || code, 'Hybrid - ' || town || ', ' || part || ', ' || code, town || ' / On-Site', town || ', ' || part || '; port 3, zero or Remote', 'TBD', 'nowhere, ' || town,
    'supplier#00000000' || (c_custkey % 10) || ', Republic of ' || land, '  ' || town || ' | ' || town, land || ' & Fully Remote, ASIA', null, town || ', AMERICA, ' || code || 'Y / Remote'][c_custkey % 13 + 1] as place,
    case c_custkey % 4 when 0 then 'HYBRID' end as tag
  from (select *, 'Port ' || (c_custkey % 41) as town, 'NATION_' || c_nationkey as land, chr(65 + c_nationkey) || 'Z' as code, 'r' || (c_custkey % 6) as part from customer)),
ended as (select *, case when regexp_matches(place, ' / (Remote|On-Site)$') then upper(replace(string_split(place, ' / ')[-1], '-', '')) end as promoted, regexp_replace(place, ' / (Remote|On-Site)$', '') as base from texts where place is not null and place <> 'TBD'),
split as (select c_custkey, tag, promoted, unnest(string_split_regex(base, '\s*[|;]\s*|\s+(&|or)\s+')) as raw, generate_subscripts(string_split_regex(base, '\s*[|;]\s*|\s+(&|or)\s+'), 1) as i from ended),
one as (select *, row_number() over (partition by c_custkey, lower(trim(raw)) order by i) as again from split),
read as (select c_custkey, i, trim(raw) as raw, case when raw ilike '%remote%' then 'REMOTE' when raw ilike '%hybrid%' then 'HYBRID' else coalesce(promoted, tag, 'UNSPECIFIED') end as workplace,
    list_filter(string_split_regex(trim(regexp_replace(raw, '(?i)(fully )?remote|hybrid', '', 'g'), ' -,'), '\s*,\s*'), lambda x: x <> '') as p from one where again = 1),
lead as (select r.*, n.code, n.name, regexp_matches(p[-1], '(?i)^r[0-4]$') and len(p) >= 2 as home from read r left join names n on n.key = lower(p[-1])),
land as (select * exclude (code, name, p), case when home then 'AZ' else code end as code, case when home then 'NATION_0' else name end as name, case when not home and code is not null then p[:-2] else p end as p from lead),
part as (select l.* exclude (p), coalesce(r.r_regionkey, s.r_regionkey) as part, case when coalesce(r.r_regionkey, s.r_regionkey) is not null then p[:-2] else p end as p
  from land l left join region r on l.code is not null and len(p) >= 2 and lower(p[-1]) = 'r' || r.r_regionkey left join region s on l.code is not null and len(p) >= 2 and lower(p[-1]) = lower(s.r_name)),
fits as (select b.c_custkey, b.i, b.code, b.part, k.*, count(*) over (partition by b.c_custkey, b.i) as n from part b join keyed k on k.key = lower(b.p[1]) where b.code is null or k.land = b.code),
chosen as (select * from fits qualify row_number() over (partition by c_custkey, i order by (code is null and n >= 2 and land = 'AZ') desc, (code = 'AZ' and part_1 is not distinct from part and part is not null) desc, people desc, id) = 1),
done as (select b.c_custkey, b.i, c.city, coalesce(b.code, c.land) as country_code, coalesce(b.name, w.name) as country, coalesce(b.part, case when coalesce(b.code, c.land) = 'AZ' then c.part_1 end) as part, workplace, raw
  from part b left join chosen c on c.c_custkey = b.c_custkey and c.i = b.i left join lands w on w.code = c.land),
firsts as (select *, row_number() over (partition by c_custkey, country_code, part, city, workplace order by i) as again from done)
select c_custkey, (row_number() over (partition by c_custkey order by i) - 1)::int as "at", city, r_name as region, 'R' || part as region_code, country, country_code, workplace, raw, city is null and country_code is null as unresolved
from firsts left join region on r_regionkey = part where again = 1""",
}
