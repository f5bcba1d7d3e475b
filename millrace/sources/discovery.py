"""Postings in the JSON of pages and payloads: state blocks, JSON-LD, job arrays at any depth, fields by alias.

JSON is parsed once into VARIANT; trees are walked level by level over all pages at a time, until no container is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.bounds import cut
from millrace.plans.projections import let, table

# Field names of vendors' payloads, the first that holds something counts.
ARRAY_KEYS = ("jobs", "results", "data", "positions", "openings", "postings", "items", "jobPostings", "records", "hits")
OUTER_KEYS = ("data", "results", "response", "body")
TITLE_FIELDS = ("title", "text", "name", "jobTitle", "job_title", "positionTitle", "role", "position")
URL_FIELDS = ("url", "hostedUrl", "absolute_url", "applyUrl", "apply_url", "link", "href", "detailUrl", "detail_url", "jobUrl", "canonicalUrl")
# What keys of embedded objects are told by, without regard to case.
TITLE_LIKE, URL_LIKE, PLACE_LIKE = "(?i)title", "(?i)url|slug|path", "(?i)location|city|country"

#: Where a block of JSON comes from, in the order in which a page's blocks are asked; the last is told by its own rules.
KINDS = ("next", "nuxt", "apollo", "generic", "linked")


def part(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "variant")


def elements(v: Column) -> Column:
    """The elements of an array, null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def members(v: Column) -> Column:
    """The members of an object by key, in the order of keys, null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def text_of(v: Column) -> Column:
    """The text of a JSON string, null for anything else."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def filled(v: Column) -> Column:
    """Is it something: no null, empty text, 0, false, empty array or empty object."""
    return v.isNotNull() & ~F.coalesce(F.to_json(v), F.lit("null")).isin("null", '""', "0", "0.0", "false", "[]", "{}")


def field(v: Column, names: tuple[str, ...]) -> Column:
    """The first of an object's fields under these names that holds something, as text."""
    return F.coalesce(*[let(part(v, f"$.{n}"), lambda x: F.when(filled(x), F.coalesce(text_of(x), F.to_json(x)))) for n in names])


def payload_jobs(v: Column, array_keys: tuple[str, ...] = ARRAY_KEYS) -> Column:
    """A payload's array of jobs: itself if it begins with an object, else under a known key, else under one inside a known outer object."""
    itself = let(elements(v), lambda a: F.when(members(F.get(a, F.lit(0))).isNotNull(), a))
    keyed = [elements(part(v, f"$.{k}")) for k in array_keys]
    nested = [elements(part(v, f"$.{o}.{k}")) for o in OUTER_KEYS for k in array_keys]
    return F.when(elements(v).isNotNull(), itself).otherwise(F.coalesce(*keyed, *nested))


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, place, kind, v): the JSON of each page's script elements, by KINDS; what doesn't parse is left out."""
    attrs, bodies = (F.regexp_extract_all("html", F.lit(r"(?is)<script\b([^>]*)>(.*?)</script>"), F.lit(g)) for g in (1, 2))
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(attrs.alias("a"), bodies.alias("b"))).alias("place", "s")).select("page_id", "url", "place", F.lower("s.a").alias("a"), F.col("s.b").alias("b"))

    def assigned(name: str) -> Column:
        """What stands behind `name =`, without the closing semicolon."""
        behind = F.substring_index(F.substring("b", F.locate(name, F.col("b")), 1 << 30), name, -1)
        value = F.regexp_replace(F.regexp_extract(behind, r"(?s)\A\s*=\s*(\{.*)", 1), r"[\s;]+\z", "")
        return F.when(value != "", value)

    typed = lambda t: F.col("a").rlike(rf"""\btype\s*=\s*["']?{t}\b""")
    nuxt, apollo = assigned("__NUXT__"), assigned("__APOLLO_STATE__")
    plain = typed("application/json")
    kind = F.when(plain & F.col("a").rlike(r"""\bid\s*=\s*["']?__next_data__\b"""), 0).when(plain, 3).when(typed(r"application/ld\+json"), 4).when(nuxt.isNotNull(), 1).when(apollo.isNotNull(), 2)
    rows = rows.withColumn("kind", kind).filter("kind is not null")
    source = F.when(F.col("kind") == 1, nuxt).when(F.col("kind") == 2, apollo).otherwise(F.col("b"))
    return rows.select("page_id", "url", "place", "kind", F.try_parse_json(source).alias("v")).filter("v is not null")


def job_like(v: Column) -> Column:
    """The job-like objects of an array of like objects, else null.

    Four in five elements are objects, two at least, and four in five of these have the same keys; seven in ten elements hold a key like a title and one like
    an address.
    """
    has = lambda m, p: F.exists(F.map_keys(m), lambda k: k.rlike(p))
    keys = lambda maps: F.array_sort(F.transform(maps, lambda m: F.array_join(F.map_keys(m), "\x00")))
    step = lambda s, k: F.struct(k.alias("last"), F.when(s["last"] == k, s["run"] + 1).otherwise(1).alias("run"), F.greatest(s["most"], F.when(s["last"] == k, s["run"] + 1).otherwise(1)).alias("most"))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    alike = lambda maps: F.aggregate(keys(maps), start, step)["most"]

    def judged(a: Column) -> Column:
        objects = F.filter(F.transform(a, members), lambda m: m.isNotNull())
        jobs = lambda maps: F.filter(maps, lambda m: has(m, TITLE_LIKE) & has(m, URL_LIKE))
        enough = lambda maps: (F.size(maps) >= 2) & (F.size(maps) * 10 >= F.size(a) * 8) & (alike(maps) * 10 >= F.size(maps) * 8)
        return let(objects, lambda maps: F.when(enough(maps), let(jobs(maps), lambda j: F.when((F.size(j) > 0) & (F.size(j) * 10 >= F.size(a) * 7), j))))

    return let(elements(v), judged)


def _walked(roots: DataFrame, found: callable, below: callable, levels: int) -> DataFrame:
    """Roots (columns, v) walked to the end: `path` and `got` of every node for which found(v) isn't null; only other nodes are entered, by below(v)."""
    ids = [c for c in roots.columns if c != "v"]
    rows = roots.select(*ids, F.array().cast("array<int>").alias("path"), "v", found(F.col("v")).alias("got"))
    while True:
        for _ in range(levels):
            inner = F.transform(below(F.col("v")), lambda x, i: F.struct(F.concat("path", F.array(i)).alias("path"), x.alias("v")))
            inner = F.filter(inner, lambda n: elements(n["v"]).isNotNull() | members(n["v"]).isNotNull())
            rows = rows.select(*ids, "got", F.explode(F.when(F.col("got").isNotNull(), F.array(F.struct("path", "v"))).otherwise(inner)).alias("n"))
            rows = rows.select(*ids, "n.path", "n.v", F.coalesce("got", found(F.col("n.v"))).alias("got"))
        rows = cut(rows)
        if rows.filter("got is null").isEmpty():
            return rows.select(*ids, "path", "got")


def children(v: Column) -> Column:
    return F.coalesce(elements(v), F.map_values(members(v)))


def embedded_jobs(found: DataFrame, levels: int = 4) -> DataFrame:
    """(page_id, source, place, title, url, location) of each page's largest job-like array, from the first kind of state block that has one.

    Arrays inside such an array aren't searched. VARIANT keeps an object's keys in order, not as written: of equally long arrays the first by path
    in that order is taken, and of several title-like keys the shortest with a text. Rows without a title are left out; relative addresses are
    resolved against the page.
    """
    arrays = _walked(found.filter(F.col("kind") < 4), job_like, children, levels)
    best = arrays.groupBy("page_id", "url").agg(F.min_by(F.struct("kind", "got"), F.struct("kind", "place", -F.size("got"), "path")).alias("b"))
    rows = best.select("page_id", F.col("url").alias("base"), F.col("b.kind").alias("kind"), F.posexplode("b.got").alias("place", "m"))
    origin = F.regexp_extract("base", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)

    def first(pattern: str, use=lambda t: F.nullif(t, F.lit(""))) -> Column:
        said = F.transform(F.map_entries("m"), lambda e: F.struct(F.char_length(e["key"]).alias("n"), e["key"].alias("k"), F.when(e["key"].rlike(pattern), use(text_of(e["value"]))).alias("t")))
        return F.array_min(F.filter(said, lambda e: e["t"].isNotNull()))["t"]

    resolved = lambda t: F.when(t.startswith("/"), F.concat(origin, t)).when(t.rlike("^https?://"), t)
    names = F.array(*[F.lit(k) for k in KINDS])
    return rows.select("page_id", F.get(names, F.col("kind")).alias("source"), "place", first(TITLE_LIKE).alias("title"), first(URL_LIKE, resolved).alias("url"), first(PLACE_LIKE).alias("location")).filter("title is not null")


def linked_jobs(found: DataFrame, levels: int = 3) -> DataFrame:
    """The same columns from JSON-LD: job postings in arrays, item lists and graphs; `place` counts a page's postings.

    A place is its text, its address or the address's town, region or country, the first that is there, or its name; several are joined by " | ".
    """
    kind = lambda v: text_of(part(v, "$['@type']"))
    posting = lambda v: F.when(kind(v) == "JobPosting", v)
    below = lambda v: F.coalesce(elements(v), F.when(kind(v) == "ItemList", elements(part(v, "$.itemListElement"))).otherwise(F.when(part(v, "$['@graph']").isNotNull(), F.array(part(v, "$['@graph']")))))
    rows = _walked(found.filter(F.col("kind") == 4), posting, below, levels)
    said = lambda v: F.nullif(F.trim(text_of(v)), F.lit(""))
    paths = ("$", "$.address", "$.address.addressLocality", "$.address.addressRegion", "$.address.addressCountry", "$.name")
    one = lambda p: F.coalesce(*[said(part(p, x)) for x in paths])
    where = part(F.col("got"), "$.jobLocation")
    several = F.array_join(F.filter(F.transform(F.coalesce(elements(where), F.array(where)), one), lambda x: x.isNotNull()), " | ")
    per = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "path", said(part(F.col("got"), "$.title")).alias("title"), said(part(F.col("got"), "$.url")).alias("url"), F.nullif(several, F.lit("")).alias("location")))).alias("a"))
    out = per.select("page_id", F.posexplode("a").alias("place", "j"))
    return out.select("page_id", F.lit("linked").alias("source"), "place", "j.title", "j.url", "j.location").filter("title is not null")


def _state_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the orders of the customer of their number as embedded state, in one of five ways."""
    item = F.expr(_ITEM)
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i"), F.expr(_POSTING).alias("l")))).alias("x"))
    lists = lists.select("page_id", F.concat(F.lit("["), F.array_join("x.i", ","), F.lit("]")).alias("a"), F.concat(F.lit("["), F.array_join("x.l", ","), F.lit("]")).alias("l"))
    return table(spark, sf_dir, "pages").join(lists, "page_id").select("page_id", "url", F.expr(_STATE).alias("html"))


_ITEM = """case when o_orderkey % 13 = 0 then '{"jobTitle":"Short ' || o_orderkey || '","slugPath":"/s/' || o_orderkey || '"}'
  else '{"jobTitle":"' || case when o_orderkey % 11 = 0 then '' else o_orderpriority || ' ' || o_orderkey end || '","slugPath":"/jobs/' || o_orderkey || '","city":"' || o_orderstatus || '"}' end"""
_POSTING = """'{"@type":"JobPosting","title":"' || o_orderpriority || '","url":"https://a.example/' || o_orderkey || '","jobLocation":{"address":{"addressLocality":"' || o_orderstatus || '","addressCountry":"XX"}}}'"""
_STATE = """html || case page_id % 5
  when 0 then '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"found":' || a || ',"nav":[{"title":"Home","url":"/h"},{"title":"Us","url":"/u"},{"title":"Q","path":"/q"}]}}}</script>'
  when 1 then '<script>window.__NUXT__ = {"data":[{"x":' || a || '}],"more":[{"title":"Menu","url":"/m"},{"title":"More","url":"/n"}]};</script>'
  when 2 then '<script>__APOLLO_STATE__ = {"ROOT":{"a":{"b":{"c":{"d":{"e":' || a || '}}}}}}</script>'
  when 3 then '<script type="application/json">{"theme":"dark"}</script><script type="application/json">[[1,2],{"rows":' || a || '}]</script>'
  else '<script type="application/ld+json">{"@graph":[{"@type":"ItemList","itemListElement":' || l || '},{"@type":"Organization"}]}</script>' end"""


def q_s08_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks(_state_pages(spark, sf_dir))
    return embedded_jobs(found).unionByName(linked_jobs(found))


def q_r04_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of four shapes, one order each, their arrays found and titles and addresses read under any name."""
    v = F.try_parse_json(F.expr(_PAYLOAD))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", payload_jobs(v).alias("jobs"))
    rows = rows.select("o_orderkey", F.size("jobs").alias("n"), F.posexplode_outer("jobs").alias("place", "job"))
    return rows.select("o_orderkey", F.when(F.col("n") >= 0, F.col("n")).alias("n"), "place", field(F.col("job"), TITLE_FIELDS).alias("title"), field(F.col("job"), URL_FIELDS).alias("url"))


_PAYLOAD = """case o_orderkey % 5
  when 0 then '[{"title":"","name":"' || o_orderpriority || '","link":"/l' || o_orderkey || '"},{"text":"t","title":null}]'
  when 1 then '{"total":1,"records":[{"role":"' || o_orderstatus || '","jobUrl":"/r","url":0}],"hits":[]}'
  when 2 then '{"meta":{"jobs":[1]},"response":{"items":[{"position":7,"href":"' || o_orderkey || '"}]}}'
  when 3 then '{"data":{"jobs":"none"},"results":3}'
  else '[1,{"title":"x"}]' end"""

QUERIES = {"S08_embedded_jobs": q_s08_jobs, "R04_job_arrays": q_r04_jobs}
ORACLES = {
    "S08_embedded_jobs": rf"""with x as (select o_custkey as page_id, '[' || string_agg({_ITEM}, ',' order by o_orderkey) || ']' as a, '[' || string_agg({_POSTING}, ',' order by o_orderkey) || ']' as l from orders group by 1),
p as (select page_id, url, {_STATE} as html from pages join x using (page_id)),
s as (select page_id, url, unnest(regexp_extract_all(html, '<script[^>]*>(?:window\.__NUXT__ = |__APOLLO_STATE__ = )?([\[{{].*?);?</script>', 1, 's')) as j from p where page_id % 5 < 4),
t as (select s.page_id, s.url, t.id, t.parent, t.type, t.value, try_cast(t.key as integer) as k from s, lateral json_tree(s.j) t where json_valid(s.j)),
e as (select a.page_id, a.url, a.id, b.value, b.type, row_number() over (partition by a.page_id, a.id order by b.id) as place,
  case when b.type = 'OBJECT' then array_to_string(list_sort(json_keys(b.value)), '|') end as keys from t a join t b on a.page_id = b.page_id and b.parent = a.id and a.type = 'ARRAY'),
m as (select page_id, id, max(c) as most from (select page_id, id, keys, count(*) as c from e where keys is not null group by all) group by all),
g as (select page_id, id, count(*) as n, count(keys) as o, count(*) filter (regexp_matches(keys, '(?i)title') and regexp_matches(keys, '(?i)url|slug|path')) as j from e group by all),
b as (select page_id, id from g join m using (page_id, id) where o >= 2 and o >= 0.8 * n and most >= 0.8 * o and j >= 0.7 * n qualify row_number() over (partition by page_id order by j desc, id) = 1),
r as (select page_id, case page_id % 5 when 0 then 'next' when 1 then 'nuxt' when 2 then 'apollo' else 'generic' end as source, (place - 1)::int as place,
  nullif(coalesce(json_extract_string(value, '$.title'), json_extract_string(value, '$.jobTitle')), '') as title,
  regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || coalesce(json_extract_string(value, '$.url'), json_extract_string(value, '$.slugPath')) as url, json_extract_string(value, '$.city') as location from e join b using (page_id, id))
select * from r where title is not null
union all select o_custkey, 'linked', (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int, o_orderpriority, 'https://a.example/' || o_orderkey, o_orderstatus from orders join pages on page_id = o_custkey where page_id % 5 = 4""",
    "R04_job_arrays": """select o_orderkey, 2::int as n, 0::int as place, o_orderpriority as title, '/l' || o_orderkey as url from orders where o_orderkey % 5 = 0 union all select o_orderkey, 2, 1, 't', null from orders where o_orderkey % 5 = 0
union all select o_orderkey, 1, 0, o_orderstatus, '/r' from orders where o_orderkey % 5 = 1 union all select o_orderkey, 1, 0, '7', o_orderkey::varchar from orders where o_orderkey % 5 = 2
union all select o_orderkey, null, null, null, null from orders where o_orderkey % 5 > 2""",
}
