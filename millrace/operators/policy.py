"""Place policy and the nightly packet's verdicts (C10, C16), and the plain cursor fetch."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.measures import _RUNS, duration_bands, out_of_band, runs
from millrace.operators.rules import ladder
from millrace.plans.projections import table

# States of the US as they trail a city, by code and by name.
STATE_CODES = "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split()
STATE_NAMES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana",
    "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia", "wisconsin", "wyoming",
)
# Countries by the names that listings use, the states' and provinces' codes by name, spellings of workplaces.
COUNTRIES = {
    "US": ("united states", "united states of america", "usa", "u s a", "u.s.", "u.s.a."), "CA": ("canada",), "GB": ("united kingdom", "uk", "u.k.", "great britain"), "IN": ("india",), "DE": ("germany",), "FR": ("france",),
    "AU": ("australia",), "CN": ("china",), "JP": ("japan",), "NL": ("netherlands",), "ES": ("spain",), "IT": ("italy",), "CH": ("switzerland",), "SE": ("sweden",), "NO": ("norway",), "DK": ("denmark",), "FI": ("finland",),
    "IE": ("ireland",), "BE": ("belgium",), "AT": ("austria",), "PT": ("portugal",), "PL": ("poland",), "IL": ("israel",), "SG": ("singapore",), "HK": ("hong kong",), "NZ": ("new zealand",), "BR": ("brazil",), "MX": ("mexico",),
    "KR": ("south korea", "korea"), "RU": ("russia",), "TR": ("turkey",), "AE": ("united arab emirates", "uae", "u.a.e."),
}
PROVINCES = {
    "ontario": "on", "quebec": "qc", "british columbia": "bc", "alberta": "ab", "manitoba": "mb", "saskatchewan": "sk", "nova scotia": "ns", "new brunswick": "nb", "newfoundland and labrador": "nl",
    "prince edward island": "pe", "northwest territories": "nt", "nunavut": "nu", "yukon": "yt",
}
WORKPLACES = {"remote": ("remote",), "hybrid": ("hybrid",), "onsite": ("onsite", "on-site", "on_site", "on site")}
_ZIP, _STATE = r"\s+\d{5}(?:-\d{4})?$", rf"\s+(?:{'|'.join((*STATE_NAMES, *STATE_CODES))})$"
# What a run's counters should do, and those that new rows alone push up.
COUNTERS = {"total_jobs": 1, "scoring_backlog": -1, "classification_null": -1, "missing_jd_full": -1, "first_seen_today": 1}
PENDING = ("classification_null", "missing_jd_full")


@dataclass(frozen=True)
class Policy:
    """A reader's market; codes are upper case, cities as `bare_city` leaves them."""

    remote_in: tuple[str, ...] = ("US",)
    home: str | None = None
    country: str = "US"
    region: str | None = None
    primary: str | None = None
    metro: tuple[str, ...] = ()

    def digest(self) -> str:
        said = asdict(self) | {"remote_in": sorted(self.remote_in), "metro": sorted(self.metro)}
        return hashlib.sha256(json.dumps(said, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def bare_city(c: Column) -> Column:
    """A city in lower case, up to its first comma, without a trailing ZIP code and state."""
    head = F.lower(F.trim(F.element_at(F.split(c, ","), 1)))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(head, _ZIP, "")), _STATE, ""))


def _named(c: Column, codes: dict[str, tuple[str, ...]]) -> Column:
    return ladder([(c.isin(*names), code) for code, names in codes.items()])


def country_of(c: Column) -> Column:
    """A country's code out of a text: two letters as they are, a known code in the first brackets that hold two letters, else a name with or without its dots and commas."""
    said = F.trim(c)
    bracketed = F.regexp_extract(F.upper(said), r"\(([A-Z]{2})\)", 1)
    name = lambda x: _named(F.lower(x), COUNTRIES)
    return F.when(said.rlike("^[A-Za-z]{2}$"), F.upper(said)).when(bracketed.isin(*COUNTRIES), bracketed).otherwise(F.coalesce(name(said), name(F.regexp_replace(said, "[.,]", ""))))


def region_of(c: Column) -> Column:
    """The code of a state or province, by its code or name, with or without dots; null for others."""
    regions = {**dict(zip(STATE_NAMES, STATE_CODES, strict=False)), "district of columbia": "dc", **PROVINCES}
    codes = {code.upper(): (name, code) for name, code in regions.items()}
    name = lambda x: _named(F.lower(x), codes)
    return F.coalesce(name(F.trim(c)), name(F.replace(F.trim(c), F.lit("."), F.lit(""))))


def workplace_of(c: Column) -> Column:
    """remote, hybrid or onsite by its usual spellings; null for anything else."""
    return _named(F.lower(F.trim(c)), WORKPLACES)


def coded(places: Column) -> Column:
    """Places as (city, region, country, region_code, country_code, kind, unresolved) with codes filled in from the names where they are missing or empty."""
    code = lambda given, name: F.coalesce(F.nullif(F.upper(F.trim(given)), F.lit("")), name)
    return F.transform(places, lambda p: F.struct(p["city"].alias("city"), code(p["region_code"], region_of(p["region"])).alias("region_code"), code(p["country_code"], country_of(p["country"])).alias("country_code"), p["kind"].alias("kind"), p["unresolved"].alias("unresolved")))


#: What a place comes to: (eligibility, tier, rank, sort order, fit); an open fit is null.
OPEN, OUTSIDE, REMOTE = ("unknown", "unknown", 0, 1, None), ("ineligible", "outside_target", 0, 0, 1), ("eligible", "remote", 5, 2, 5)


def _outcome(kind: Column | str, of: tuple, *reason: Column | str) -> Column:
    eligibility, tier, rank, order, fit = of
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    why = F.concat(*[r if isinstance(r, Column) else F.lit(r) for r in reason])
    return F.struct(number(order).alias("sort_order"), number(rank).alias("rank"), number(fit).alias("fit"), F.lit(eligibility).alias("eligibility"), F.lit(tier).alias("tier"), F.lit(kind).alias("workplace"), why.alias("reason"))


def place_outcome(p: Column, policy: Policy) -> Column:
    """One place (city, said, region_code, country_code, kind) by the first rule that decides, with its reason; said is the city as written."""
    kind, country, region, city, said = p["kind"], p["country_code"], p["region_code"], p["city"], F.coalesce(p["said"], F.lit(""))
    remote, hybrid = kind == "remote", kind == "hybrid"
    where = F.concat(kind, F.lit(" in "), said, F.lit(", "), region, F.lit(", "), country)
    return ladder([
        (kind.isNull(), _outcome("unknown", OPEN, "unspecified workplace type for ", F.when(said == "", "location").otherwise(said))),
        (remote & country.isNull(), _outcome(kind, OPEN, "remote with no country information")),
        (remote & country.isin(*policy.remote_in, policy.home or "-"), _outcome(kind, REMOTE, "remote in ", country, " (eligible)")),
        (remote & F.lit(policy.home is None), _outcome(kind, OPEN, "remote in ", country, " (home country unknown)")),
        (remote, _outcome(kind, OUTSIDE, "remote in ", country, " (not eligible)")),
        (country != policy.country, _outcome(kind, OUTSIDE, kind, " in ", country, " (outside target)")),
        ((region != (policy.region or "-")) & F.lit(policy.region is not None), _outcome(kind, OUTSIDE, kind, " in ", region, " (outside target)")),
        (country.isNull() | region.isNull(), _outcome("unknown", OPEN, kind, " with insufficient location data")),
        (said == "", _outcome("unknown", OPEN, kind, " with missing city")),
        ((city != "") & (city == (policy.primary or "-")), _outcome(kind, ("eligible", "primary", F.when(hybrid, 4).otherwise(2), 2, F.when(hybrid, 4).otherwise(2)), where, " (primary target)")),
        (city.isin(*policy.metro, "-"), _outcome(kind, ("eligible", "metro", F.when(hybrid, 3).otherwise(1), 2, F.when(hybrid, 3).otherwise(2)), where, " (metro)")),
    ], _outcome(kind, OUTSIDE, where, " (outside target)"))


def place_policy(places: Column, kind: Column, country: Column, policy: Policy) -> Column:
    """The verdict over a listing's places: the best by (sort_order, rank), the first of equals; null without any place.

    places are structs (city, region_code, country_code, kind, unresolved), few a listing; unresolved ones don't count and
    a kind left open is the listing's own. Without any, the listing's kind and country stand for a place.
    """
    some = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    none = F.lit(None).cast("string")
    own = F.struct(none.alias("city"), none.alias("said"), none.alias("region_code"), some(country).alias("country_code"), workplace_of(kind).alias("kind"))
    known = F.transform(F.filter(places, lambda p: ~F.coalesce(p["unresolved"], F.lit(False))), lambda p: F.struct(
        bare_city(p["city"]).alias("city"), p["city"].alias("said"), some(p["region_code"]).alias("region_code"), some(p["country_code"]).alias("country_code"),
        F.coalesce(workplace_of(p["kind"]), workplace_of(kind)).alias("kind"),
    ))
    known = F.when(F.coalesce(F.size(known), F.lit(0)) > 0, known).when(some(kind).isNotNull() | some(country).isNotNull(), F.array(own))
    judged = F.transform(known, lambda p, i: F.struct(place_outcome(p, policy).alias("o"), (-i).alias("i")))
    ranked = F.transform(judged, lambda x: F.struct(x["o"]["sort_order"], x["o"]["rank"], x["i"], x["o"].alias("o")))
    return F.array_max(ranked)["o"]


def sure(verdict: Column) -> Column:
    """A verdict, open where there was no place to judge."""
    return F.coalesce(verdict, _outcome("unknown", OPEN, "no location data available"))


def fold(verdict: Column, at: Column) -> Column:
    """An aggregate: the verdict of a job over its postings' verdicts, the best by (sort_order, rank), of equals the one with
    the smallest `at`, with that `at`. It is a maximum, so postings of one job needn't meet in a row."""
    return F.max(F.struct(verdict["sort_order"].alias("sort_order"), verdict["rank"].alias("rank"), (-at).alias("back"), verdict.alias("verdict")))


def fingerprint(places: Column, kind: Column, country: Column, policy: Policy) -> Column:
    """A digest of what a verdict hangs on, so that unchanged listings aren't judged again."""
    known = lambda c: F.coalesce(c, F.lit("~"))
    one = lambda p: F.concat_ws("|", known(F.lower(F.trim(p["city"]))), known(F.upper(p["region_code"])), known(F.upper(p["country_code"])), known(F.lower(p["kind"])), known(p["unresolved"].cast("string")))
    said = F.concat_ws(";", F.array_join(F.transform(F.coalesce(places, F.array()), one), "+"), known(F.lower(kind)), known(F.upper(country)), F.lit(policy.digest()))
    return F.sha2(said, 256)


MARKET = Policy(remote_in=("N1", "N2", "N7"), home="N4", country="N3", region="R1", primary="city 1", metro=("city 2", "city 4"))
_OWN_KIND = {"1-URGENT": "remote", "2-HIGH": "hybrid", "5-LOW": "onsite"}


def q_c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listings, their lines' suppliers as places."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    nation = F.when(F.col("l_partkey") % 4 == 0, 3).otherwise(F.col("s_nationkey") % 9)
    place = F.struct(
        F.col("l_linenumber").alias("n"),
        F.when(F.col("l_discount") > 0, F.concat(F.lit("City "), (F.col("l_suppkey") % 5).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, ", CA").when(F.col("l_partkey") % 3 == 0, " new jersey 07030").otherwise(""))).alias("city"),
        F.when(F.col("l_tax") < 0.07, F.concat(F.lit("r"), (F.col("l_linenumber") % 2).cast("string"))).alias("region_code"),
        F.when(F.col("l_tax") > 0, F.concat(F.lit("N"), nation.cast("string"))).alias("country_code"),
        F.when(F.col("l_returnflag") == "A", "Remote").when(F.col("l_returnflag") == "R", "HYBRID").when(F.col("l_linestatus") == "F", "onsite").alias("kind"),
        (F.col("l_quantity") < 3).alias("unresolved"),
    )
    places = line.join(supplier, line.l_suppkey == supplier.s_suppkey).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(place)).alias("places"))
    own = ladder([(F.col("o_orderpriority") == p, k) for p, k in _OWN_KIND.items()])
    country = F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("n"), (F.col("o_custkey") % 9).cast("string")))
    rows = table(spark, sf_dir, "orders").join(places, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "places", own.alias("kind"), country.alias("country"))
    given = F.col("places"), F.col("kind"), F.col("country")
    out = rows.select("o_orderkey", place_policy(*given, MARKET).alias("v"), fingerprint(*given, MARKET).alias("fingerprint"))
    open_ = {"eligibility": F.lit("unknown"), "tier": F.lit("unknown"), "workplace": F.lit("unknown"), "rank": F.lit(0), "sort_order": F.lit(1), "fit": F.lit(None)}
    return out.select("o_orderkey", *[F.coalesce(F.col(f"v.{k}"), v).alias(k) for k, v in open_.items()], "fingerprint")


WEST = Policy(remote_in=("US", "CA"), home="CN", country="US", region="CA", primary="city 1", metro=("city 2",))
_POSTED = {"1-URGENT": "Remote", "2-HIGH": "on-site", "3-MEDIUM": " HYBRID ", "4-NOT SPECIFIED": "Unspecified"}


def q_c10_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as jobs, their orders as postings whose places have names instead of codes; a job's verdict over all of them."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    named = F.expr("case c_custkey % 5 when 0 then n_name when 1 then lower(n_name) || '.' when 2 then 'Remote (us)' when 3 then substr(n_name, 1, 2) end")
    jobs = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", named.alias("country"), F.when(F.col("c_mktsegment") == "BUILDING", "Hybrid").alias("own"))
    region, city = F.expr("case o_orderkey % 4 when 0 then 'California' when 1 then ' ca' when 2 then 'N.Y.' end"), F.expr("case when o_orderkey % 7 > 0 then 'City ' || o_orderkey % 5 end")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", region.alias("region"), city.alias("city"), ladder([(F.col("o_orderpriority") == p, k) for p, k in _POSTED.items()]).alias("kind"))
    none = F.lit(None).cast("string")
    place = F.struct("city", "region", "country", none.alias("region_code"), none.alias("country_code"), "kind", F.lit(False).alias("unresolved"))
    rows = orders.join(jobs, F.col("o_custkey") == F.col("c_custkey")).withColumn("places", coded(F.array(place)))
    judged = rows.select("c_custkey", "o_orderkey", sure(place_policy(F.col("places"), F.col("own"), F.lit(None).cast("string"), WEST)).alias("v"))
    best = judged.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("postings"), F.count_if(F.col("v.eligibility") == "eligible").alias("eligible"), fold(F.col("v"), F.col("o_orderkey")).alias("b"))
    return best.select("c_custkey", "postings", "eligible", (-F.col("b.back")).alias("posting"), *[F.col(f"b.verdict.{k}").alias(k) for k in ("eligibility", "tier", "workplace", "rank", "fit", "reason")])


def movement(name: str, delta: Column, fresh: Column, attributable: Column) -> Column:
    """A counter's change in words. New rows push some counters up by as many as they are; only what exceeds them is worse."""
    d = F.coalesce(delta, F.lit(0))
    size = F.abs(d).cast("string")
    rungs = [(~attributable, F.lit("not_attributable")), (d == 0, F.lit("unchanged")), (F.sign(d) == COUNTERS[name], F.concat(F.lit("improved_by_"), size))]
    if name in PENDING:
        rungs += [(d <= fresh, F.concat(F.lit("pending_from_new_rows_"), size)), (fresh > 0, F.concat(F.lit("worsened_by_"), (d - fresh).cast("string")))]
    return ladder(rungs, F.concat(F.lit("worsened_by_"), size))


def forced(disposition: Column, error: Column) -> Column:
    """Verdicts that the disposition alone decides; null leaves a run to the later reader."""
    return ladder([(disposition == "failed", "FAIL"), (disposition == "orphaned", "ANOMALY"), ((disposition == "degraded") & (F.coalesce(error, F.lit("")) != ""), "ANOMALY")])


def packets(ends: DataFrame, bands: DataFrame) -> DataFrame:
    """Run ends (id, disposition, error, alone, and the counters' changes) with bands (id, verdict) as packets."""
    fresh = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("total_jobs", "first_seen_today")], F.lit(0))
    band = F.when(F.col("verdict").isin("fast", "slow"), "out_of_band").otherwise(F.coalesce("verdict", F.lit("insufficient_history")))
    return ends.join(bands.select("id", "verdict"), "id", "left").select(
        "id", forced(F.col("disposition"), F.col("error")).alias("forced"), band.alias("band"), *[movement(c, F.col(c), fresh, F.col("alone")).alias(c) for c in COUNTERS]
    )


def q_c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, changes counted in their lines."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = lambda test: F.count_if(F.expr(test))
    changes = line.groupBy(F.col("l_orderkey").alias("id")).agg(
        (n("l_returnflag = 'N'") - n("l_linestatus = 'O'")).alias("total_jobs"), (n("l_quantity > 25") - n("l_quantity <= 25")).alias("scoring_backlog"), n("l_tax > 0.03").alias("classification_null"),
        (n("l_returnflag = 'A'") - n("l_returnflag = 'R'")).alias("missing_jd_full"), n("l_linenumber > 4").alias("first_seen_today"),
    )
    disposition = F.expr("case when o_orderkey % 11 = 0 then 'orphaned' when o_orderstatus = 'P' then 'degraded' when o_orderpriority = '1-URGENT' then 'failed' else 'ok' end")
    ends = orders.select(F.col("o_orderkey").alias("id"), disposition.alias("disposition"), F.expr("case o_custkey % 3 when 0 then '' when 1 then o_orderpriority end").alias("error"), (F.col("o_orderkey") % 6 > 0).alias("alone"))
    return packets(ends.join(changes, "id", "left"), out_of_band(duration_bands(runs(spark, sf_dir))))


def fetched(rows: DataFrame, id_col: str, since: int, most: int) -> DataFrame:
    """The next rows behind a cursor in id order; the bound is the page."""
    return rows.filter(F.col(id_col) > since).orderBy(id_col).limit(most)


def q_o08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetched(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 41, 200)


QUERIES = {"C10_place_policy": q_c10, "C10_postings": q_c10_postings, "C16_packets": q_c16, "O08_cursor_fetch": q_o08}


def _movement_sql(name: str) -> str:
    more = f"when {name} <= fresh then 'pending_from_new_rows_' || {name} when fresh > 0 then 'worsened_by_' || {name} - fresh" if name in PENDING else ""
    return f"case when not alone then 'not_attributable' when {name} = 0 then 'unchanged' when sign({name}) = {COUNTERS[name]} then 'improved_by_' || abs({name}) {more} else 'worsened_by_' || abs({name}) end as {name}"


ORACLES = {
    "O08_cursor_fetch": "select event_id, user_id, event_type from events where event_id > 41 order by event_id limit 200",
    "C10_place_policy": rf"""with l as (select l_orderkey, l_linenumber as n,
    case when l_discount > 0 then 'City ' || l_suppkey % 5 || case when l_linenumber % 2 = 0 then ', CA' when l_partkey % 3 = 0 then ' new jersey 07030' else '' end end as city,
    case when l_tax < 0.07 then 'R' || l_linenumber % 2 end as region, case when l_tax > 0 then 'N' || case when l_partkey % 4 = 0 then 3 else s_nationkey % 9 end end as country,
    case when l_returnflag = 'A' then 'Remote' when l_returnflag = 'R' then 'HYBRID' when l_linestatus = 'F' then 'onsite' end as kind, l_quantity < 3 as unresolved
  from lineitem join supplier on l_suppkey = s_suppkey),
o as (select o_orderkey, case o_orderpriority {" ".join(f"when '{p}' then '{k}'" for p, k in _OWN_KIND.items())} end as own, case when o_custkey % 3 > 0 then 'N' || o_custkey % 9 end as own_country from orders),
s as (select l_orderkey, string_agg(concat_ws('|', coalesce(lower(trim(city)), '~'), coalesce(region, '~'), coalesce(country, '~'), coalesce(lower(kind), '~'), unresolved::varchar), '+'
    order by n, city nulls first, region nulls first, country nulls first, kind nulls first, unresolved) as said from l group by 1),
p as (select l_orderkey as k, n, city, region, country, coalesce(lower(kind), own) as kind, kind as raw_kind from l join o on l_orderkey = o_orderkey where not unresolved
  union all select o_orderkey, 0, null, null, own_country, own, null from o where (own is not null or own_country is not null) and not exists (from l where l_orderkey = o_orderkey and not unresolved)),
c as (select *, trim(regexp_replace(trim(regexp_replace(lower(trim(split_part(city, ',', 1))), '{_ZIP}', '')), '{_STATE}', '')) as bare from p),
j as (select *, case when kind is null then 'open' when kind = 'remote' then case when country is null then 'open_remote' when country in ('N1', 'N2', 'N7', 'N4') then 'remote' else 'outside' end
    when country <> 'N3' or region <> 'R1' then 'outside' when country is null or region is null or coalesce(bare, '') = '' then 'open'
    when bare = 'city 1' then 'primary' when bare in ('city 2', 'city 4') then 'metro' else 'outside' end as w from c),
r as (select *, case w when 'outside' then 0 when 'open' then 1 when 'open_remote' then 1 else 2 end as so,
    case w when 'remote' then 5 when 'primary' then if(kind = 'hybrid', 4, 2) when 'metro' then if(kind = 'hybrid', 3, 1) else 0 end as rk from j),
b as (select * from r qualify row_number() over (partition by k order by so desc, rk desc, n, city nulls first, region nulls first, country nulls first, raw_kind nulls first) = 1)
select o_orderkey, case coalesce(so, 1) when 2 then 'eligible' when 1 then 'unknown' else 'ineligible' end as eligibility,
  case when w in ('remote', 'primary', 'metro') then w when w = 'outside' then 'outside_target' else 'unknown' end as tier,
  case when w is null or w = 'open' then 'unknown' else kind end as workplace, coalesce(rk, 0) as rank, coalesce(so, 1) as sort_order,
  case w when 'outside' then 1 when 'remote' then 5 when 'primary' then rk when 'metro' then if(kind = 'hybrid', 3, 2) end as fit,
  sha256(concat_ws(';', coalesce(said, ''), coalesce(own, '~'), coalesce(own_country, '~'), '{MARKET.digest()}')) as fingerprint
from o left join b on k = o_orderkey left join s on l_orderkey = o_orderkey""",
    "C10_postings": """with p as (select c_custkey, o_orderkey, case when o_orderkey % 7 > 0 then 'City ' || o_orderkey % 5 end as city,
    case c_custkey % 5 when 0 then map {'brazil': 'BR', 'canada': 'CA', 'china': 'CN', 'france': 'FR', 'germany': 'DE', 'india': 'IN', 'japan': 'JP', 'russia': 'RU', 'united kingdom': 'GB', 'united states': 'US'}[lower(n_name)]
      when 1 then map {'brazil': 'BR', 'canada': 'CA', 'china': 'CN', 'france': 'FR', 'germany': 'DE', 'india': 'IN', 'japan': 'JP', 'russia': 'RU', 'united kingdom': 'GB', 'united states': 'US'}[lower(n_name)]
      when 2 then 'US' when 3 then upper(n_name[1:2]) end as cc,
    case o_orderkey % 4 when 0 then 'CA' when 1 then 'CA' when 2 then 'NY' end as rc,
    case o_orderpriority when '1-URGENT' then 'remote' when '2-HIGH' then 'onsite' when '3-MEDIUM' then 'hybrid' else if(c_mktsegment = 'BUILDING', 'hybrid', null) end as kind
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
w as (select *, case when kind is null then 'untold' when kind = 'remote' and cc is null then 'nowhere' when kind = 'remote' then if(cc in ('US', 'CA', 'CN'), 'remote', 'far')
    when cc <> 'US' then 'abroad' when rc <> 'CA' then 'elsewhere' when cc is null or rc is null then 'vague' when city is null then 'cityless'
    when city = 'City 1' then 'primary' when city = 'City 2' then 'metro' else 'other' end as w from p),
v as (select c_custkey, o_orderkey, case when w in ('remote', 'primary', 'metro') then 2 when w in ('untold', 'nowhere', 'vague', 'cityless') then 1 else 0 end as so,
    case w when 'remote' then 5 when 'primary' then if(kind = 'hybrid', 4, 2) when 'metro' then if(kind = 'hybrid', 3, 1) else 0 end as rank,
    case w when 'remote' then 5 when 'primary' then if(kind = 'hybrid', 4, 2) when 'metro' then if(kind = 'hybrid', 3, 2) when 'far' then 1 when 'abroad' then 1 when 'elsewhere' then 1 when 'other' then 1 end as fit,
    case when w in ('remote', 'primary', 'metro') then w when w in ('far', 'abroad', 'elsewhere', 'other') then 'outside_target' else 'unknown' end as tier,
    if(w in ('untold', 'vague', 'cityless'), 'unknown', kind) as workplace,
    case w when 'untold' then 'unspecified workplace type for ' || coalesce(city, 'location') when 'nowhere' then 'remote with no country information' when 'remote' then 'remote in ' || cc || ' (eligible)'
      when 'far' then 'remote in ' || cc || ' (not eligible)' when 'abroad' then kind || ' in ' || cc || ' (outside target)' when 'elsewhere' then kind || ' in ' || rc || ' (outside target)'
      when 'vague' then kind || ' with insufficient location data' when 'cityless' then kind || ' with missing city'
      else kind || ' in ' || city || ', ' || rc || ', ' || cc || case w when 'primary' then ' (primary target)' when 'metro' then ' (metro)' else ' (outside target)' end end as reason from w),
n as (select c_custkey, count(*) as postings, count(*) filter (so = 2) as eligible from v group by 1)
select c_custkey, postings, eligible, o_orderkey as posting, case so when 2 then 'eligible' when 1 then 'unknown' else 'ineligible' end as eligibility, tier, workplace, rank, fit, reason
from v join n using (c_custkey) qualify row_number() over (partition by c_custkey order by so desc, rank desc, o_orderkey) = 1""",
    "C16_packets": f"""with {_RUNS}, n as (select *, row_number() over (partition by job order by began desc, id desc) as r from runs),
p as (select a.job, a.id, b.seconds as past, row_number() over (partition by a.job, a.id order by b.r) as k from runs a join n b on a.job = b.job and a.id <> b.id where b.r <= 11 and b.good),
b as (select job, id, count(*) as history, round(quantile_cont(past, 0.1), 6) as low, round(quantile_cont(past, 0.9), 6) as high from p where k <= 10 group by all),
v as (select id, case when history is null or history < 5 then 'insufficient_history' when seconds > high + greatest(high * 0.25, 5.0) or seconds < low - greatest(low * 0.25, 5.0) then 'out_of_band' else 'in_band' end as band
  from runs left join b using (job, id)),
c as (select l_orderkey as id, count(*) filter (l_returnflag = 'N') - count(*) filter (l_linestatus = 'O') as total_jobs, count(*) filter (l_quantity > 25) - count(*) filter (l_quantity <= 25) as scoring_backlog,
    count(*) filter (l_tax > 0.03) as classification_null, count(*) filter (l_returnflag = 'A') - count(*) filter (l_returnflag = 'R') as missing_jd_full, count(*) filter (l_linenumber > 4) as first_seen_today
  from lineitem group by 1),
e as (select o_orderkey as id, o_orderkey % 6 > 0 as alone, case when o_orderkey % 11 = 0 then 'ANOMALY' when o_orderstatus = 'P' then if(o_custkey % 3 = 1, 'ANOMALY', null) when o_orderpriority = '1-URGENT' then 'FAIL' end as forced,
    {", ".join(f"coalesce({x}, 0) as {x}" for x in COUNTERS)}, greatest(coalesce(total_jobs, 0), coalesce(first_seen_today, 0), 0) as fresh from orders left join c on id = o_orderkey)
select e.id, forced, band, {", ".join(_movement_sql(x) for x in COUNTERS)} from e join v on v.id = e.id""",
}
