"""Clusters of like titles and the verdict on a cohort of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.cohorts import similar_titles
from millrace.operators.rules import ladder
from millrace.plans.bounds import cut, placed
from millrace.plans.projections import table

# Likeness of titles, the share of clusters at which they are a template, samples, words without identity, page furniture in places.
LIKE, TEMPLATE_SHARE, LEAST_SAMPLES, LARGE, SAMPLE = 0.7, 0.4, 2, 10, 8
GENERIC = "and apply career careers com company corp external global group holdings inc internal job jobs llc ltd net org portal recruiting search site the www".split()
CHROME = ("popular job", "trending job", "view all job", "browse job", "related job", "similar job", "recommended job", "more job", "apply now", "see more")


def title_tokens(title: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: t != "")


def _least_partner(edges: DataFrame) -> DataFrame:
    """edges (cohort, u, v) with m, the least of u and all its partners; a hot u's rows can be split at run time."""
    extra = F.xxhash64("cohort", "u", F.lit(17))
    least = edges.groupBy("cohort", "u").agg(F.min("v").alias("m")).select("cohort", "u", F.least("u", "m").alias("m"))
    # The derived key makes both sides exchange: an aggregate that is already dealt out by its keys would rule out splitting its hot ones.
    return edges.withColumn("x", extra).join(least.withColumn("x", extra), ["x", "cohort", "u"]).drop("x")


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("cohort", "u", "v").cast("decimal(38,0)")).alias("sum")
    return cut(edges.observe(seen, *sums)), seen.get


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(cohort, node, least) of every node of the edges (cohort, u, v): the least node that it is connected with.

    Large-star and small-star steps in turn: each node's larger partners are hung on its least one, then all its smaller ones. Rounds end when the
    edges no longer change, after about the logarithm of the longest path; no node's partners are gathered anywhere.
    """
    now, state = _kept(edges.filter("u <> v").select("cohort", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select("cohort", F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_partner(both).filter("v > u").select("cohort", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least_partner(large)
        hung = small.select("cohort", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("cohort", "u", F.col("m").alias("v")))
        before = state
        now, state = _kept(hung.filter("u <> v").distinct())
        if state == before:
            ends = now.select("cohort", F.col("v").alias("node"), F.col("v").alias("least")).distinct()
            return now.select("cohort", F.col("u").alias("node"), F.col("v").alias("least")).unionByName(ends)
    raise RuntimeError("components did not settle")


def title_clusters(rows: DataFrame, least: float = LIKE) -> DataFrame:
    """(cohort, title, cluster) of each distinct title of rows (cohort, title), as its tokens; the cluster is its least title.

    Two titles are in one cluster if a chain of titles joins them, each of whose neighbours share `least` of the longer one's tokens in order.
    Titles without a token are in none; equal titles are one; titles without a cohort stay alone.
    """
    titles = rows.select("cohort", F.array_join(title_tokens(F.col("title")), " ").alias("title")).filter("title <> ''").distinct()
    found = connected(similar_titles(rows, least).select("cohort", F.col("title_a").alias("u"), F.col("title_b").alias("v")))
    found = found.select(F.col("cohort").alias("c"), F.col("node").alias("title"), "least")
    return titles.alias("t").join(found, F.col("t.cohort").eqNullSafe(F.col("c")) & (F.col("t.title") == found["title"]), "left").select("t.cohort", "t.title", F.coalesce("least", "t.title").alias("cluster"))


def identity_tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"))), lambda t: (F.char_length(t) >= 3) & ~t.isin(*GENERIC) & ~t.rlike(r"^(?:wd)?\d+$"))


def affine(name: Column, other: Column) -> Column:
    """A name and another name or slug plausibly mean one company: a shared word, a word of four letters inside one of the other, or one inside the other without its marks."""
    a, b = identity_tokens(name), identity_tokens(other)
    inside = F.exists(a, lambda x: F.exists(b, lambda y: ((F.char_length(x) >= 4) & F.contains(y, x)) | ((F.char_length(y) >= 4) & F.contains(x, y))))
    p, q = (F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]", "") for t in (name, other))
    whole = (F.char_length(p) >= 4) & (F.char_length(q) >= 4) & (F.contains(p, q) | F.contains(q, p))
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.arrays_overlap(a, b) | inside | whole)


def cohort_verdicts(rows: DataFrame) -> DataFrame:
    """C17: (cohort, postings, titles, clusters, largest, reason, positive) of rows (cohort, company, at, title, url, org, place).

    The first that holds: few clusters among the titles with a large one; a portfolio's path, whose most frequent slug isn't the company's; and in
    cohorts of LARGE postings, in a sample spread over their addresses by `at`, several other employers, one other employer time and again, or page furniture in places.
    A cohort without a company isn't judged. Counts are grouped sums; the sample is the rule's own: SAMPLE rows of a cohort.
    """
    per_title = rows.select("cohort", F.array_join(title_tokens(F.col("title")), " ").alias("title")).filter("title <> ''").groupBy("cohort", "title").agg(F.count(F.lit(1)).alias("n"))
    clusters = title_clusters(rows.select("cohort", "title")).select(F.col("cohort").alias("c"), F.col("title").alias("t"), "cluster")
    sized = per_title.join(clusters, F.col("cohort").eqNullSafe(F.col("c")) & (F.col("title") == F.col("t"))).groupBy("cohort", "cluster").agg(F.sum("n").alias("n"))
    by_title = sized.groupBy("cohort").agg(F.sum("n").alias("titles"), F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"))
    company = rows.groupBy("cohort").agg(F.max("company").alias("company"), F.count(F.lit(1)).alias("postings"))
    slugs = rows.withColumn("slug", F.lower(F.regexp_extract("url", r"(?i)/companies/([^/]+)/", 1))).filter("slug <> ''").groupBy("cohort", "slug").agg(F.count(F.lit(1)).alias("n"))
    slug = slugs.groupBy("cohort").agg(F.max_by("slug", F.struct("n", "slug")).alias("slug"), F.max("n").alias("slug_n"))
    numbered = placed(rows.filter("url <> ''").select("cohort", "at", "org", F.col("place").alias("place_text")), ["cohort"], [F.col("at")]).withColumnRenamed("place", "rank")
    return _judged(numbered, company, by_title, slug)


def _judged(numbered: DataFrame, company: DataFrame, by_title: DataFrame, slug: DataFrame) -> DataFrame:
    # Row i * step, cut to whole numbers, for i below SAMPLE; of few rows all.
    nth = F.ceil(F.col("rank") * SAMPLE / F.col("of"))
    drawn = numbered.filter((F.col("of") <= SAMPLE) | ((nth < SAMPLE) & (F.floor(nth * F.col("of") / SAMPLE) == F.col("rank"))))
    other = F.coalesce((F.col("org") != "") & ~affine(F.col("company"), F.col("org")), F.lit(False))
    furniture = F.coalesce(F.exists(F.array(*[F.lit(c) for c in CHROME]), lambda c: F.contains(F.lower("place_text"), c)), F.lit(False))
    sampled = drawn.join(company.select("cohort", "company"), "cohort").groupBy("cohort").agg(F.count_if(other).alias("others"), F.count_distinct(F.when(other, F.lower("org"))).alias("employers"), F.count_if(furniture).alias("furniture"))
    out = company.join(by_title, "cohort", "left").join(slug, "cohort", "left").join(sampled, "cohort", "left").na.fill(0, ["titles", "clusters", "largest", "slug_n", "others", "employers", "furniture"])
    named = F.coalesce(F.col("company") != "", F.lit(False))
    foreign = F.coalesce(~affine(F.col("company"), F.col("slug")), F.lit(False)) & (F.col("slug_n") >= LEAST_SAMPLES)
    template = (F.col("titles") > 0) & (F.col("clusters") <= TEMPLATE_SHARE * F.col("titles")) & (F.col("largest") >= LEAST_SAMPLES)
    large = F.col("postings") >= LARGE
    reason = ladder([
        (~named, None), (template, "title_template"), (foreign, "portfolio_path"), (large & (F.col("others") >= LEAST_SAMPLES) & (F.col("employers") >= LEAST_SAMPLES), "distinct_employers"),
        (large & (F.col("others") >= LEAST_SAMPLES), "other_employer"), (large & (F.col("furniture") >= LEAST_SAMPLES), "place_furniture"),
    ])
    out = out.withColumn("reason", reason)
    positive = ladder([(F.col("reason") == "title_template", F.col("largest")), (F.col("reason") == "portfolio_path", F.col("slug_n")), (F.col("reason") == "distinct_employers", F.col("employers")), (F.col("reason") == "other_employer", F.col("others")), (F.col("reason") == "place_furniture", F.col("furniture"))], 0)
    return out.select("cohort", "postings", "titles", "clusters", "largest", "reason", positive.cast("long").alias("positive"))


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a brand's titles, some with more words than others, some alike but for a word."""
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("cohort"), F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") % 3).cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit("No. 7"))).alias("title"))


def q_j15_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_clusters(part_titles(spark, sf_dir))


def part_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cohorts of postings of all kinds: by brand and size, with a path, an employer and a place by their numbers."""
    k, kind = F.col("p_partkey"), F.col("p_size") % 6
    name = F.concat(F.lit("Acme"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(" Works Inc"))
    # Plain words of the number's digits, so that titles of most cohorts differ and those of one kind don't.
    own = F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(" "), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_brand", kind.cast("string")).alias("cohort"), F.when(kind < 5, name).alias("company"), k.alias("at"), F.when(kind == 0, F.concat("p_type", F.lit(" role at the works"))).otherwise(own).alias("title"),
        F.when(kind == 1, F.concat(F.lit("https://b.example/companies/"), F.when(k % 3 == 0, "acme-x").otherwise("zeta"), F.lit("/jobs/"), k)).when(k % 5 > 0, F.concat(F.lit("https://c.example/jobs/"), k)).alias("url"),
        F.when(kind == 2, F.concat(F.lit("Other "), F.char(F.lit(97) + k % 2), F.lit("xyz"))).when(kind == 3, F.lit("Zeta Ltd")).otherwise(F.lit("acme works")).alias("org"), F.when((kind == 4) & (k % 3 > 0), F.lit("View all jobs")).otherwise(F.lit("Oslo")).alias("place"),
    )


def q_c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort_verdicts(part_cohorts(spark, sf_dir))


def _clusters_sql(titles: str) -> str:
    """SQL of clusters (cohort, title, cluster) over `titles` (cohort, title): every pair's common subsequence, then all that is reachable."""
    return rf"""words as (select distinct cohort, array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') as title from {titles}), toks as (select *, string_split(title, ' ') as t from words where title <> ''),
pairs as (select row_number() over () as id, a.cohort, a.title as u, b.title as v, a.t as a, b.t as b from toks a join toks b on a.cohort = b.cohort and a.title < b.title and least(len(a.t), len(b.t)) >= 0.7 * greatest(len(a.t), len(b.t)) and len(list_intersect(a.t, b.t)) > 0),
steps as (
  select id, a, b, 0 as i, [0 for x in b] as r from pairs
  union all
  select id, a, b, i + 1, [greatest(r[j], coalesce(list_max([case when k > 1 then r[k - 1] else 0 end + 1 for k in range(1, j + 1) if b[k] = a[i + 1]]), 0)) for j in range(1, len(b) + 1)] from steps where i < len(a)
), alike as (select cohort, u, v from pairs join steps using (id) where i = len(steps.a) and r[-1] >= 0.7 * greatest(len(steps.a), len(steps.b))),
both_ways as (select cohort, u, v from alike union all select cohort, v, u from alike), reach as (
  select cohort, title as u, title as v from toks union select r.cohort, r.u, e.v from reach r join both_ways e on e.cohort = r.cohort and e.u = r.v
), clusters as (select cohort, u as title, min(v) as cluster from reach group by 1, 2)"""


_TOKENS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: length(x) >= 3 and x not in ({', '.join(repr(g) for g in GENERIC)}) and not regexp_full_match(x, '(wd)?[0-9]+')))"
_AFFINE = lambda a, b: f"(len(list_filter({_TOKENS(a)}, lambda p: len(list_filter({_TOKENS(b)}, lambda q: p = q or length(p) >= 4 and contains(q, p) or length(q) >= 4 and contains(p, q))) > 0)) > 0)"
QUERIES = {"J15_clusters": q_j15_clusters, "C17_cohorts": q_c17}
ORACLES = {
    "J15_clusters": f"""with recursive titles as (select p_brand as cohort, concat_ws(' ', p_name, p_type, p_size % 3, case when p_size % 2 = 0 then 'No. 7' end) as title from part), {_clusters_sql("titles")} select * from clusters""",
    "C17_cohorts": f"""with recursive rows as (select p_brand || '/' || (p_size % 6) as cohort, case when p_size % 6 < 5 then 'Acme' || regexp_extract(p_brand, '[0-9]+') || ' Works Inc' end as company, p_partkey as k, p_size % 6 as kind,
    case when p_size % 6 = 0 then p_type || ' role at the works' else string_split(p_name, ' ')[1] || ' ' || translate(p_partkey::varchar, '0123456789', 'abcdefghij') end as title from part),
{_clusters_sql("rows")}, sized as (select r.cohort, cluster, count(*) as n from rows r join clusters c on c.cohort = r.cohort and c.title = array_to_string(regexp_extract_all(lower(r.title), '[a-z0-9]+'), ' ') group by 1, 2),
ratio as (select cohort, sum(n)::bigint as titles, count(*) as clusters, max(n) as largest from sized group by 1),
urls as (select *, row_number() over (partition by cohort order by k) - 1 as pos, count(*) over (partition by cohort) as urls from rows where kind = 1 or k % 5 > 0),
picks as (select *, case kind when 2 then 'Other ' || chr((97 + k % 2)::int) || 'xyz' when 3 then 'Zeta Ltd' else 'acme works' end as org from urls where urls <= 8 or list_contains([(i * urls) // 8 for i in range(8)], pos)),
seen as (select cohort, count(*) filter (not {_AFFINE("company", "org")}) as others, count(distinct org) filter (not {_AFFINE("company", "org")}) as employers, count(*) filter (kind = 4 and k % 3 > 0) as furniture from picks group by 1),
slugs as (select cohort, case when k % 3 = 0 then 'acme-x' else 'zeta' end as slug, count(*) as n from rows where kind = 1 group by 1, 2), slug as (select cohort, arg_max(slug, (n, slug)) as slug, max(n) as n from slugs group by 1),
judged as (select r.*, titles, clusters, largest, others, employers, furniture, slug.n as slug_n, case when company is null then null when clusters <= 0.4 * titles and largest >= 2 then 'title_template' when slug = 'zeta' and slug.n >= 2 then 'portfolio_path' when postings < 10 then null
    when others >= 2 and employers >= 2 then 'distinct_employers' when others >= 2 then 'other_employer' when furniture >= 2 then 'place_furniture' end as reason
  from (select cohort, max(company) as company, count(*) as postings from rows group by 1) r left join ratio using (cohort) left join seen using (cohort) left join slug using (cohort))
select cohort, postings, titles, clusters, largest, reason, coalesce(case reason when 'title_template' then largest when 'portfolio_path' then slug_n when 'distinct_employers' then employers when 'other_employer' then others when 'place_furniture' then furniture end, 0) as positive from judged""",
}
