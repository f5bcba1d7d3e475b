"""Addresses as column expressions: canonical form, host tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.projections import let, table

# Parameters that only track, two-label suffixes, hosts by kind.
TRACKING = ("refid", "trk", "lipi", "ref", "fbclid", "_hsenc", "_hsmi")
TRACKING_PREFIXES = ("utm_", "mc_")
TWO_LABEL = ("co.uk", "com.au", "co.nz", "com.br", "co.jp", "co.in")
AGGREGATORS = ("linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "monster.com")


def canonical(url: Column) -> Column:
    """Scheme and host lower, tracking parameters off, the rest sorted; what can't be parsed stays."""
    m = F.array(*[F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?$", k) for k in range(1, 6)])
    key = lambda p: F.lower(F.substring_index(p, "=", 1))
    tracks = lambda p: key(p).isin(*TRACKING) | key(p).rlike("^(?:" + "|".join(TRACKING_PREFIXES) + ")")
    query = lambda q: F.array_join(F.array_sort(F.filter(F.split(q, "&"), lambda p: (p != "") & ~tracks(p))), "&")
    whole = lambda p, q: F.concat(F.lower(p[0]), F.lit("://"), F.lower(p[1]), p[2], F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""), p[4])
    return let(m, lambda p: F.when(p[0] == "", url).otherwise(let(query(p[3]), lambda q: whole(p, q))))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def registrable(h: Column) -> Column:
    """The last two labels, three where the last two are a suffix of their own."""
    n = lambda k: F.substring_index(h, ".", -k)
    return F.when(n(2).isin(*TWO_LABEL), n(3)).otherwise(n(2))


def is_aggregator(url: Column) -> Column:
    """The host is, or is below, an aggregator's."""
    h = host(url)
    out = F.lit(False)
    for name in AGGREGATORS:
        out = out | (h == name) | h.endswith("." + name)
    return out


def posting_id(url: Column) -> Column:
    """The stable posting id in an address: a gh_jid parameter, else digits behind /jobs/."""
    a, b = F.regexp_extract(url, r"[?&]gh_jid=(\d+)", 1), F.regexp_extract(url, r"/jobs?/(\d+)", 1)
    return F.when(a != "", a).when(b != "", b)


def direct_address(url: Column) -> Column:
    """The address lies on a platform's own board."""
    return url.rlike(r"(?i)://(?:boards\.greenhouse\.io|(?:api|jobs)\.lever\.co|jobs\.ashbyhq\.com)/")


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses, with platform hosts and parameters put on some."""
    n, url = F.col("page_id"), F.col("url")
    shape = F.array(
        url, F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("gh_jid="), n.cast("string"), F.lit("&ref=x&b=2&a=1")), F.concat(F.lit("HTTPS://Boards.Greenhouse.IO/Acme"), n.cast("string"), F.lit("/jobs/"), n.cast("string"), F.lit("?utm_Source=q#top")),
        F.concat(F.lit("https://api.lever.co/v0/postings/Co-"), n.cast("string")), F.concat(F.lit("https://www.linkedin.com/jobs/view/"), n.cast("string"), F.lit("/?trk=z&refId=1")), F.concat(F.lit("https://jobs.example.co.uk/job/"), n.cast("string")),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(shape, (n % 6 + 1).cast("int")).alias("url"))


ADDRESSES = """addresses as (select page_id, [url, url || case when contains(url, '?') then '&' else '?' end || 'gh_jid=' || page_id || '&ref=x&b=2&a=1',
    'HTTPS://Boards.Greenhouse.IO/Acme' || page_id || '/jobs/' || page_id || '?utm_Source=q#top', 'https://api.lever.co/v0/postings/Co-' || page_id,
    'https://www.linkedin.com/jobs/view/' || page_id || '/?trk=z&refId=1', 'https://jobs.example.co.uk/job/' || page_id][(page_id % 6 + 1)::int] as url from pages)"""


def q_x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select("page_id", canonical(F.col("url")).alias("url"))


def q_x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return addresses(spark, sf_dir).select("page_id", host(u).alias("host"), registrable(host(u)).alias("domain"), is_aggregator(u).alias("aggregator"), posting_id(u).alias("posting_id"))


_P = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*)?$'"
QUERIES = {"X15_canonical_url": q_x15, "X16_hosts": q_x16}
ORACLES = {
    "X15_canonical_url": rf"""with {ADDRESSES}, p as (select page_id, url, regexp_extract(url, {_P}, 1) as s, regexp_extract(url, {_P}, 2) as h, regexp_extract(url, {_P}, 3) as path, regexp_extract(url, {_P}, 4) as q, regexp_extract(url, {_P}, 5) as f from addresses),
k as (select *, array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' and lower(split_part(x, '=', 1)) not in ('refid', 'trk', 'lipi', 'ref', 'fbclid', '_hsenc', '_hsmi') and not regexp_matches(lower(split_part(x, '=', 1)), '^(?:utm_|mc_)'))), '&') as kept from p)
select page_id, case when s = '' then url else lower(s) || '://' || lower(h) || path || case when kept <> '' then '?' || kept else '' end || f end as url from k""",
    "X16_hosts": rf"""with {ADDRESSES}, h as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host from addresses),
l as (select *, string_split(host, '.') as l from h)
select page_id, host, array_to_string(case when array_to_string(l[-2:], '.') in ('co.uk', 'com.au', 'co.nz', 'com.br', 'co.jp', 'co.in') then l[-3:] else l[-2:] end, '.') as domain,
  regexp_matches(host, '(^|\.)(linkedin|indeed|glassdoor|ziprecruiter|monster)\.com$') as aggregator,
  coalesce(nullif(regexp_extract(url, '[?&]gh_jid=(\d+)', 1), ''), nullif(regexp_extract(url, '/jobs?/(\d+)', 1), '')) as posting_id from l""",
}
