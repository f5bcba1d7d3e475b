"""Content contracts, expiry markers, place fit and content writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import NAMED, mentions_a_stem, named, tokens, tokens_sql
from millrace.functions.phrases import counted, counted_sql, said
from millrace.operators.rules import ladder
from millrace.plans.projections import let, table

# Windows, prefixes, wordings of blocked, listing, missing, expired and placeholder pages.
LEAST_CHARS, HEAD, CROSS_CHARS, CROSS_TOKENS = 200, 400, 300, 2
JUNK_PREFIXES = ("sign in", "loading", "open roles at", "skip to content", "cookie", "privacy policy", "404")
BLOCKED = (
    r"(?i)from wikipedia, the free encyclopedia|request denied|are you a robot|verify you are (?:human|not a robot)|attention required|just a moment|checking your browser|you have been blocked"
    r"|access (?:to this page )?(?:has been )?denied|enable javascript|please enable (?:js|javascript|cookies)|unusual traffic from your|complete the security check|ddos protection"
)
#: Wordings are kept as phrases of plain words; `a|b` are words of which any one stands there, and any white space parts words.
_GONE = "no longer available|no longer active|filled|closed|expired"
NOT_FOUND_SAID = ("404 error|404 not found|404 page", "error 404|http 404", "page not found", "page cannot|page can't|page can’t + be found", "410 gone", "the page you requested", "the page you are looking for")
EXPIRED_SAID = (
    "this job|this position|this posting|this role|this listing|this vacancy|this opening + is|has been + " + _GONE, "this job|this position|this posting + is no longer",
    "no longer accepting applications", "the job you are trying to apply for has been filled", "this job has closed", "position has been filled", "job expired",
)

NOT_FOUND, EXPIRED = said(NOT_FOUND_SAID), said(EXPIRED_SAID)
#: What a list of postings counts at its head, and how many characters its words may take.
JOBS_IN, JOBS_GAP = r"\bjobs\s+in\b", 40
PLACEHOLDER = r"(?i)your engaging (?:footer )?subtitle goes here|widget title goes here|lorem ipsum is simply dummy text"
NO_RESULTS = r"(?i)no jobs? (?:for|match(?:ing)?) your search|no (?:results|positions|openings) (?:found )?for your search"
BRANDS = ("shopify", "atos", "circle", "canva", "lhh", "walmart", "atrium", "adobe", "salesforce", "allstate", "general motors", "centene", "visa", "abbvie")


def is_junk(text: Column) -> Column:
    """Too short, or led by a navigation prefix."""
    t = F.trim(text)
    return (F.char_length(t) < LEAST_CHARS) | F.exists(F.array(*[F.lit(p) for p in JUNK_PREFIXES]), lambda p: F.startswith(F.lower(F.substring(t, 1, 200)), p))


def mismatched(title: Column, text: Column) -> Column:
    """A long text that holds no stem of a title with two significant words or more."""
    return let(tokens(title), lambda t: (F.char_length(text) >= CROSS_CHARS) & (F.size(t) >= CROSS_TOKENS) & ~mentions_a_stem(t, text))


def rejection(title: Column, text: Column) -> Column:
    """Why a text is no posting, in fixed order; null if nothing is found. Only the head is read for page kinds."""
    head = F.substring(text, 1, HEAD)
    return ladder([
        (F.char_length(F.trim(text)) < LEAST_CHARS, "truncated"), (head.rlike(BLOCKED), "head_block"), (counted(head, JOBS_IN, JOBS_GAP), "listing"), (head.rlike(NOT_FOUND), "not_found"), (head.rlike(PLACEHOLDER), "placeholder"),
        (head.rlike(NO_RESULTS), "no_results"), (text.rlike(EXPIRED), "expired"), (F.trim(text).rlike(r"^[\[{]") & F.trim(text).rlike(r"[\]}]\s*\z") & F.try_parse_json(text).isNotNull(), "config_blob"), (mismatched(title, text), "off_title"),
    ])


SAID = ("Just a moment... ", "1,200 engineering jobs in Oslo. ", "Page cannot be found. ", "Lorem ipsum is simply dummy text. ", "No results for your search. ", "", "Sign in to go on. ", "")


def pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under titles, one in two led or ended by the wordings that the contract looks for."""
    said = F.array(*[F.lit(x) for x in SAID])
    tail = F.when(F.col("doc_id") % 9 == 4, " This job has closed").when(F.col("doc_id") % 9 == 5, " The job you are trying to apply for has been filled").otherwise("")
    text = F.when(F.col("doc_id") % 31 == 7, F.lit('{"theme": "dark", "fonts": ["' + "x" * 220 + '"]}')).otherwise(F.concat(F.element_at(said, (F.col("doc_id") % 16 % 8 + 1).cast("int")), "text", tail))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return docs.join(named(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), "title", "company"), "doc_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def place_fit(places: Column, targets: list[str], home: str, arrangement: str) -> Column:
    """Fit of structured places by the first rule that decides; null leaves it open.

    places are structs of city, country and kind (remote, hybrid, onsite); an open remote place has no country.
    """
    wants_remote = "Remote" in targets
    there = [t.lower() for t in targets if t != "Remote"]
    remote = lambda p: p["kind"] == "remote"
    abroad = lambda p: p["country"].isNotNull() & (p["country"] != home)
    hits = lambda p: F.lower(p["city"]).isin(*there) | F.lower(p["country"]).isin(*there)
    present = lambda p: F.coalesce(~remote(p) & hits(p), F.lit(False))
    some = F.size(places) > 0
    return ladder([
        (F.lit(wants_remote) & F.exists(places, lambda p: remote(p) & p["country"].isNull()), 5),
        (F.exists(places, lambda p: remote(p) & p["country"].eqNullSafe(F.lit(home))), 5),
        (some & F.forall(places, lambda p: remote(p) & abroad(p)), 1),
        (F.lit(arrangement == "remote") & F.exists(places, present), 4),
        (F.lit(arrangement == "remote") & some & F.forall(places, lambda p: ~remote(p) & p["country"].isNotNull() & ~present(p)), 1),
        (some & F.forall(places, lambda p: ~remote(p) & abroad(p) & ~present(p)), 1),
        (F.exists(places, present), 5),
    ])


def q_c02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages_read(spark, sf_dir)
    return rows.groupBy(rejection(F.col("title"), F.col("text")).alias("reason"), is_junk(F.col("text")).alias("junk")).agg(F.count(F.lit(1)).alias("n"))


def q_c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live, expired or inconclusive by body markers and status."""
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 200, 404, 403, 200, 410)]), (F.col("doc_id") % 6 + 1).cast("int"))
    verdict = ladder([(status.isin(404, 410), "expired"), (status.isin(401, 403, 429), "inconclusive"), (F.col("text").rlike(EXPIRED), "expired"), (F.char_length(F.trim("text")) < LEAST_CHARS, "inconclusive")], "live")
    return pages_read(spark, sf_dir).select("doc_id", verdict.alias("verdict"))


def q_c09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of customers' nations: every customer has one to three."""
    kinds = F.array(*[F.lit(k) for k in ("onsite", "remote", "hybrid")])
    country = F.array(*[F.lit(k) for k in ("US", "NO", None, "DE")])
    city = F.array(*[F.lit(k) for k in ("Oslo", "Boston", "Bonn", "Lima", "Austin")])
    k = F.col("c_custkey")
    one = lambda i: F.struct(F.element_at(city, ((k + i) % 5 + 1).cast("int")).alias("city"), F.element_at(country, ((F.floor(k / 2) + i) % 4 + 1).cast("int")).alias("country"), F.element_at(kinds, ((F.floor(k / 3) + i) % 3 + 1).cast("int")).alias("kind"))
    places = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), one)
    fit = lambda a: place_fit(places, ["Remote", "Boston", "Austin"], "US", a)
    return table(spark, sf_dir, "customer").groupBy(fit("remote").alias("remote_first"), fit("on-site").alias("on_site")).agg(F.count(F.lit(1)).alias("n"))


def q_x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on the brand list once folded to letters and digits."""
    fold = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    name = F.when(F.col("s_suppkey") % 10 == 3, "  WALMART!").when(F.col("s_suppkey") % 10 == 4, "General-Motors").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fold(name).isin(*BRANDS).alias("blocked"))


def q_x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_read(spark, sf_dir).select("doc_id", mismatched(F.col("title"), F.col("text")).alias("mismatch"))


def q_c24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords shortest first, those that hold a kept one dropped, three kept."""
    words = F.array_sort(F.transform(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))
    kept = F.aggregate(words, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: x["w"].contains(y)), acc).otherwise(F.concat(acc, F.array(x["w"]))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.slice(kept, 1, 3), ",").alias("keywords"))


def q_c28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sign-in pages, and whether the company's words stand in the text."""
    rows = pages_read(spark, sf_dir)
    auth = (F.char_length("text") < 1500) & F.col("text").rlike(r"(?i)\b(?:sign in|log in|create an account)\b")
    return rows.select("doc_id", auth.alias("auth_page"), F.exists(F.filter(F.split(F.lower(F.coalesce("company", F.lit(""))), r"[^a-z0-9#]+"), lambda w: F.char_length(w) > 3), lambda w: F.lower("text").contains(w)).alias("named"))


def q_g03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text write restamps only if the text changed; a rejected text records its reason and leaves the old."""
    rows = pages_read(spark, sf_dir).withColumn("old", F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    why = rejection(F.lit(""), F.col("text"))
    out = rows.withColumn("reason", why).withColumn("changed", ~F.col("text").eqNullSafe(F.col("old")) & F.col("reason").isNull())
    return out.groupBy("changed", F.col("reason").isNotNull().alias("rejected"), (F.when(F.col("changed"), F.col("text")).otherwise(F.col("old"))).isNull().alias("empty")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "C02_rejections": q_c02, "C09_place_fit": q_c09, "C13_expiry": q_c13, "C24_keywords": q_c24, "C28_page_kinds": q_c28, "G03_content_write": q_g03, "X07_brands": q_x07, "X12_mismatch": q_x12,
}
_P = lambda p: p.replace("'", "''")
PAGES = f"""{NAMED}, pages_read as (select doc_id, coalesce(title, '') as title, company,
    case when doc_id % 31 = 7 then '{{"theme": "dark", "fonts": ["' || repeat('x', 220) || '"]}}'
      else [{", ".join(f"'{x}'" for x in SAID)}][(doc_id % 16 % 8 + 1)::int] || text
        || case doc_id % 9 when 4 then ' This job has closed' when 5 then ' The job you are trying to apply for has been filled' else '' end end as text
  from documents left join named on doc_id = p_partkey)"""


def mismatched_sql(title: str, text: str) -> str:
    return f"(length({text}) >= {CROSS_CHARS} and len({tokens_sql(title)}) >= {CROSS_TOKENS} and len(list_filter({tokens_sql(title)}, lambda t: contains(lower({text}), substr(t, 1, 5)))) = 0)"


def rejection_sql(title: str) -> str:
    head = f"substr(text, 1, {HEAD})"
    steps = [(f"regexp_matches({head}, '{_P(p)}')", name) for p, name in ((BLOCKED, "head_block"), (NOT_FOUND, "not_found"), (PLACEHOLDER, "placeholder"), (NO_RESULTS, "no_results"))]
    steps.insert(1, (counted_sql(head, JOBS_IN, JOBS_GAP), "listing"))
    steps = [(f"length(trim(text)) < {LEAST_CHARS}", "truncated"), *steps, (f"regexp_matches(text, '{_P(EXPIRED)}')", "expired"), ("regexp_matches(trim(text), '^[\\[{]') and json_valid(text)", "config_blob"), (mismatched_sql(title, "text"), "off_title")]
    return "case " + " ".join(f"when {c} then '{n}'" for c, n in steps) + " end"


_JUNK_SQL = f"(length(trim(text)) < {LEAST_CHARS} or " + " or ".join(f"starts_with(lower(substr(trim(text), 1, 200)), '{p}')" for p in JUNK_PREFIXES) + ")"


def place_fit_sql(arrangement: str) -> str:
    some = lambda test: f"len(list_filter(places, lambda p: coalesce({test}, false))) > 0"
    every = lambda test: f"(len(places) > 0 and len(list_filter(places, lambda p: coalesce({test}, false))) = len(places))"
    remote, abroad = "p.kind = 'remote'", "(p.country is not null and p.country <> 'US')"
    present = "(p.kind <> 'remote' and (coalesce(lower(p.city) in ('boston', 'austin'), false) or coalesce(lower(p.country) in ('boston', 'austin'), false)))"
    steps = [(some(f"{remote} and p.country is null"), 5), (some(f"{remote} and p.country = 'US'"), 5), (every(f"{remote} and {abroad}"), 1)]
    if arrangement == "remote":
        steps += [(some(present), 4), (every(f"p.kind <> 'remote' and p.country is not null and not {present}"), 1)]
    steps += [(every(f"p.kind <> 'remote' and {abroad} and not {present}"), 1), (some(present), 5)]
    return "case " + " ".join(f"when {c} then {n}" for c, n in steps) + " end"


ORACLES = {
    "C02_rejections": f"with {PAGES} select {rejection_sql('title')} as reason, {_JUNK_SQL} as junk, count(*) as n from pages_read group by 1, 2",
    "C13_expiry": f"""with {PAGES}, s as (select *, [200, 200, 404, 403, 200, 410][(doc_id % 6 + 1)::int] as status from pages_read)
select doc_id, case when status in (404, 410) then 'expired' when status in (401, 403, 429) then 'inconclusive' when regexp_matches(text, '{_P(EXPIRED)}') then 'expired'
  when length(trim(text)) < {LEAST_CHARS} then 'inconclusive' else 'live' end as verdict from s""",
    "C09_place_fit": f"""with c as (select list_transform(range(0, c_custkey % 3 + 1), lambda i: {{'city': ['Oslo', 'Boston', 'Bonn', 'Lima', 'Austin'][((c_custkey + i) % 5 + 1)::int],
    'country': ['US', 'NO', null, 'DE'][((c_custkey // 2 + i) % 4 + 1)::int], 'kind': ['onsite', 'remote', 'hybrid'][((c_custkey // 3 + i) % 3 + 1)::int]}}) as places from customer)
select {place_fit_sql("remote")} as remote_first, {place_fit_sql("on-site")} as on_site, count(*) as n from c group by 1, 2""",
    "C24_keywords": """with w as (select p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) as w from part),
k as (select p_partkey, list_sort(list_transform(list_filter(w, lambda x: len(list_filter(w, lambda y: y <> x and contains(x, y))) = 0), lambda x: {'n': length(x), 'w': x})) as k from w)
select p_partkey, array_to_string(list_transform(k[1:3], lambda x: x.w), ',') as keywords from k""",
    "C28_page_kinds": rf"""with {PAGES} select doc_id, length(text) < 1500 and regexp_matches(text, '(?i)\b(?:sign in|log in|create an account)\b') as auth_page,
  len(list_filter(list_filter(regexp_split_to_array(lower(coalesce(company, '')), '[^a-z0-9#]+'), lambda w: length(w) > 3), lambda w: contains(lower(text), w))) > 0 as named from pages_read""",
    "G03_content_write": f"""with {PAGES}, r as (select text, case when doc_id % 2 = 0 then text end as old, {rejection_sql("''")} as reason from pages_read),
c as (select *, text is distinct from old and reason is null as changed from r)
select changed, reason is not null as rejected, (case when changed then text else old end) is null as empty, count(*) as n from c group by 1, 2, 3""",
    "X12_mismatch": f"with {PAGES} select doc_id, {mismatched_sql('title', 'text')} as mismatch from pages_read",
    "X07_brands": f"select s_suppkey, trim(regexp_replace(lower(case when s_suppkey % 10 = 3 then '  WALMART!' when s_suppkey % 10 = 4 then 'General-Motors' else s_name end), '[^a-z0-9]+', ' ', 'g')) in ({', '.join(repr(b) for b in BRANDS)}) as blocked from supplier",
}
