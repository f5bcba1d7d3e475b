"""Rules on single postings: titles, quality, addresses, payloads, records and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.names import NAMED, named, shingle_hashes
from millrace.functions.pay import merged
from millrace.functions.phrases import said
from millrace.functions.urls import host
from millrace.operators.content import PAGES, pages_read
from millrace.operators.rules import freshness, refuses, refuses_sql, text_quality
from millrace.operators.verdicts import POSTING
from millrace.plans.bounds import sent_whole
from millrace.plans.projections import table

# Nouns of lists, longest title, wordings of metadata.
LIST_NOUNS = "job jobs position positions opening openings role roles opportunities results".split()
LONGEST_TITLE = 140
METADATA = ("posted ", "apply by", "agency", "post level", "job title", "more accessible", "description ", "required:", "responsibilities")
# Short forms of titles, those that only capitals make one, and those in any case.
CAPITALS = {
    "VP": "vice president", "DS": "data scientist", "DA": "data analyst", "DE": "data engineer", "PM": "product manager", "TPM": "technical program manager", "EM": "engineering manager", "MLE": "machine learning engineer", "ML": "machine learning",
    "AI": "artificial intelligence", "SRE": "site reliability engineer", "SWE": "software engineer", "SE": "software engineer", "IC": "individual contributor", "QA": "quality assurance", "UX": "user experience", "UI": "user interface",
}
SHORT = {"sr": "senior", "jr": "junior", "mgr": "manager", "mgmt": "management", "eng": "engineer", "engr": "engineer", "dev": "developer", "arch": "architect", "ops": "operations", "admin": "administrator", "dir": "director"}
# What a title calls a level; the tools of platforms by how postings come from them.
SENIORITY = ("senior", "sr", "staff", "principal", "junior", "jr", "entry level|entry-level|entrylevel", "director", "vp", "vice president", "head of", "chief", "lead", "manager", "associate", "intern", "level + 1|2|3|4|5|6|7|8|9", *(f"level{n}" for n in range(1, 10)))
LEAD_GENERATION = ("lead + gen|generation",)
DIRECT = (
    "lever greenhouse ashby jazzhr pinpoint teamtailor workday smartrecruiters bamboohr personio recruitee breezy workable paylocity rippling oracle_cloud ultipro ibm successfactors adp icims phenom tesla"
).split()
KEYWORD_ONLY, STUBS = ("amazon", "microsoft", "eightfold"), ("jobvite", "google", "taleo", "kronos", "modernloop", "governmentjobs")
# Payload keys by kind of event, closed lists of values, longest text.
PAYLOADS = {
    "posting_impression": ("surface",), "posting_saved": (), "posting_dismissed": (), "posting_watchlist_added": (), "posting_apply_clicked": ("apply_destination",), "posting_apply_undone": (),
    "user_signed_up": ("channel", "wave", "signup_method", "referrer_host"), "user_activated": (), "user_exit_surveyed": ("exit_reason",), "consent_recorded": ("consent_type", "granted", "consent_version", "consented_at"),
}
CLOSED = {("user_exit_surveyed", "exit_reason"): ("hired", "gave-up", "still-searching")}
LONGEST_VALUE = 200
SIBLINGS = 5


def is_listing_tile(title: Column) -> Column:
    """A count first and a noun of lists last: the tile of a list, no posting."""
    words = F.split(F.trim(F.regexp_replace(title, r"\s+", " ")), " ")
    first, last = F.get(words, 0), F.lower(F.regexp_extract(F.element_at(words, -1), r"(\w*)$", 1))
    return F.coalesce((F.size(words) > 1) & F.regexp_replace(first, r"\+$", "").rlike(r"^\d[\d,]*$") & last.isin(*LIST_NOUNS), F.lit(False))


def is_metadata_blob(title: Column) -> Column:
    """A title run together with what stood beside it: too long, a wording of metadata, pay, or a number and a pipe before a name."""
    low = F.lower(title)
    worded = F.exists(F.array(*[F.lit(m) for m in METADATA]), lambda m: F.contains(low, m))
    return F.coalesce((F.char_length(title) > LONGEST_TITLE) | worded | title.rlike(r"\$\s*\d") | title.rlike(r"\d{4}\s*\|\s*[A-Z]"), F.lit(False))


def match_title(title: Column) -> Column:
    """A title's words in lower case with short forms spelt out; marks part words. Those of capitals count only as capitals."""
    known = F.create_map(*[F.lit(x) for pair in {**CAPITALS, **SHORT}.items() for x in pair])
    words = F.filter(F.split(title, r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), F.try_element_at(known, F.when(F.lower(w).isin(*SHORT), F.lower(w))), F.lower(w))), " ")


def matched_titles(titles: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target) where all words of a target (target) stand in a title (id, title), in any order.

    Targets and titles meet by each target's rarest word among the titles, so a common word doesn't pair them all; targets without a word match nothing.
    """
    words = titles.select("id", F.array_distinct(F.split(match_title(F.col("title")), " ")).alias("words"))
    each = words.select("id", "words", F.explode("words").alias("word")).filter("word <> ''")
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    wanted = targets.select("target").distinct().withColumn("want", F.array_distinct(F.split(match_title(F.col("target")), " ")))
    rarest = wanted.withColumn("word", F.explode("want")).filter("word <> ''").join(often, "word").groupBy("target").agg(F.min_by(F.struct("word", "want"), F.struct("n", "word")).alias("w")).select("target", "w.*")
    return each.join(sent_whole(rarest), "word").filter(F.size(F.array_except("want", "words")) == 0).select("id", "target")


def q_x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.col("p_name"), F.concat(F.col("p_size"), F.lit(" "), "p_name", F.lit(" Jobs")), F.concat(F.lit("1,200+ openings "), F.col("p_size")), F.concat(F.col("p_partkey"), F.lit("|Oslo, "), "p_name"), F.concat("p_name", F.lit(" Posted "), F.col("p_size"), F.lit(" days ago")), F.concat("p_name", F.lit(" $"), F.col("p_size"), F.lit(",000")), F.repeat(F.concat("p_type", F.lit(" ")), 6), F.concat(F.lit("12 "), "p_type", F.lit(" results"))]
    title = F.element_at(F.array(*kinds), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", is_listing_tile(title).alias("tile"), is_metadata_blob(title).alias("blob"))


def q_x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """postings' titles against the targets that all parts of size one give."""
    rows = named(spark, sf_dir)
    lead = F.array(*[F.lit(x) for x in ("Sr. ", "EM, ", "em ", "Dir./", "")])
    titles = rows.select(F.col("p_partkey").alias("id"), F.concat(F.element_at(lead, (F.col("p_partkey") % 5 + 1).cast("int")), "title").alias("title"))
    one = table(spark, sf_dir, "part").filter("p_size = 1").select(F.concat_ws(" ", F.element_at(F.split("p_name", " "), 2), F.when(F.col("p_partkey") % 2 == 0, "SENIOR").otherwise("Manager")).alias("target"))
    return matched_titles(titles, one).groupBy("id").agg(F.count(F.lit(1)).alias("targets"), F.min("target").alias("first"))


def with_quality(rows: DataFrame) -> DataFrame:
    """Rows (id, company, seen, text, ...) with `quality`: a band of 200 to 1,200 words, a posting's wordings, and how little a text repeats one of its company's SIBLINGS latest others.

    Likeness is that of the whole texts' sets of five words. A company's texts meet as one array of its latest sets, so no pair of rows is built; empty texts have quality 0, rows without a company no siblings.
    """
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    # The latest are chosen by their keys alone, so only their texts are cut into sets a second time.
    newest = Window.partitionBy("company").orderBy(F.desc("seen"), F.desc("id"))
    first = rows.filter("company is not null and id is not null").select(F.col("company").alias("_c"), F.col("id").alias("_i"), F.row_number().over(newest).alias("_k")).filter(F.col("_k") <= SIBLINGS + 1).select("_c", "_i").distinct()
    few = rows.join(sent_whole(first), (F.col("company") == F.col("_c")) & (F.col("id") == F.col("_i")), "left_semi")
    few = few.select("company", "id", "seen", shingle_hashes(words).alias("_set"))
    rows = rows.withColumn("_w", words).withColumns({"_set": shingle_hashes(F.col("_w")), "_n": F.size("_w")}).drop("_w")
    latest = few.withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= SIBLINGS + 1)
    latest = latest.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("_k", "id", "_set"))).alias("_latest"))
    others = F.slice(F.filter("_latest", lambda s: s["id"] != F.col("id")), 1, SIBLINGS)
    shared = F.transform(F.filter(others, lambda s: F.size(s["_set"]) > 0), lambda s: F.struct(F.size(F.array_intersect("_set", s["_set"])).alias("n"), F.size(s["_set"]).alias("of")))
    alike = F.transform(shared, lambda s: s["n"] / (F.size("_set") + s["of"] - s["n"]))
    overlap = F.when(F.size("_set") > 0, F.coalesce(F.array_max(alike), F.lit(0.0))).otherwise(0.0)
    shaped = F.lower("text").rlike(POSTING)
    return rows.join(latest, "company", "left").withColumn("quality", F.when(F.coalesce("text", F.lit("")) == "", 0.0).otherwise(text_quality(F.col("_n"), shaped, overlap))).drop("_set", "_n", "_latest")


def states_seniority(title: Column) -> Column:
    """C11: a title says its level; lead generation is none."""
    return F.coalesce(F.regexp_replace(title, said(LEAD_GENERATION), " ").rlike(said(SENIORITY)), F.lit(False))


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings of a few companies, with a title, structured pay for some, and the day they were seen."""
    d = F.col("doc_id")
    title = F.concat_ws(" ", F.when(d % 4 == 0, "Sr.").when(d % 4 == 1, "Lead Generation").when(d % 4 == 2, "Level 3"), "title")
    text = F.when(d % 5 == 0, F.concat("text", F.lit("\nWhat you'll do: responsibilities"))).otherwise(F.col("text"))
    return pages_read(spark, sf_dir).select(d.alias("id"), (d % 40).cast("string").alias("company"), (d % 97).alias("seen"), title.alias("title"), text.alias("text"), F.when(d % 3 == 0, d * 10).alias("salary_min"))


def q_m05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(page_postings(spark, sf_dir)).select("id", "quality")


def q_c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: the bundle of a posting's structural axes."""
    rows = with_quality(page_postings(spark, sf_dir))
    now = F.lit("2024-04-01").cast("timestamp_ntz")
    fresh = freshness(F.col("id") % 17 == 0, F.when(F.col("id") % 13 == 0, "expired"), F.when(F.col("id") % 7 > 0, F.date_sub(now, F.col("seen").cast("int")).cast("timestamp_ntz")), now)
    return rows.select("id", states_seniority(F.col("title")).alias("seniority"), F.col("salary_min").isNotNull().alias("pay_stated"), fresh.alias("freshness"), "quality")


def is_direct_platform(platform: Column) -> Column:
    """Postings come from the platform's own list; not from a search by keyword, and not from a stub."""
    return F.coalesce(platform.isin(*DIRECT), F.lit(False))


def q_x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = [*DIRECT, *KEYWORD_ONLY, *STUBS, "unknown", None]
    name = F.element_at(F.array(*[F.lit(x) for x in every]), (F.col("s_suppkey") % len(every) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").groupBy(name.alias("platform"), is_direct_platform(name).alias("direct")).agg(F.count(F.lit(1)).alias("n"))


def apply_url(source_urls: Column, sightings: Column) -> Column:
    """The first address that isn't empty, of the posting's own, else of its sightings; null without one."""
    there = lambda u: u.isNotNull() & (u != "")
    return F.coalesce(F.get(F.filter(source_urls, there), 0), F.get(F.filter(F.transform(sightings, lambda s: s["source_url"]), there), 0))


def apply_destination(url: Column) -> Column:
    """The host of an address, cut at LONGEST_VALUE; null where it has none."""
    return F.when(host(url) != "", F.substring(host(url), 1, LONGEST_VALUE))


def q_x28(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    own = F.when(p % 4 == 0, F.array(F.lit(""), F.col("url"))).when(p % 4 == 1, F.array(F.lit(None).cast("string"))).when(p % 4 == 2, F.array().cast("array<string>"))
    seen = F.when(p % 3 > 0, F.array(F.struct(F.lit("").alias("source_url")), F.struct(F.concat(F.lit("HTTPS://Board.Example:8080/"), p).alias("source_url")))).when(p % 6 == 3, F.array(F.struct(F.lit("no address").alias("source_url"))))
    url = apply_url(own, seen)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("apply_url"), apply_destination(url).alias("destination"))


def due_for_pages(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """companies (probe, platform, homepage, enabled, name) whose pages are read: a miss or an error, or a hit on a stub; with a homepage, enabled, of these names if any are given."""
    reached = F.col("probe").isin("miss", "error") | ((F.col("probe") == "hit") & F.col("platform").isin(*STUBS))
    out = rows.filter(reached & F.col("homepage").isNotNull() & F.col("enabled"))
    return out.filter(F.col("name").isin(*names)) if names else out


def q_f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select(k, F.col("c_name").alias("name"), pick(("hit", "miss", "error", "unprobed", None), k).alias("probe"), pick((*STUBS, *DIRECT[:3], None), F.floor(k / 5)).alias("platform"), F.when(k % 7 > 0, F.concat(F.lit("https://"), "c_name")).alias("homepage"), (F.col("c_acctbal") > 0).alias("enabled"))
    return due_for_pages(rows).select("c_custkey", "probe", "platform")


def payload_fault(kind: Column, payload: Column) -> Column:
    """Why a payload (JSON text) of an event may not be kept: its kind, a key, a value that is no scalar, too long or not in its closed list; null if it may. A null payload is empty."""
    v, keys = F.try_parse_json(F.coalesce(payload, F.lit("{}"))), F.json_object_keys(F.coalesce(payload, F.lit("{}")))
    kinds = F.create_map(*[x for k, allowed in PAYLOADS.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in allowed]).cast("array<string>"))])
    allowed = F.try_element_at(kinds, kind)
    value = lambda key: F.try_variant_get(v, f"$.{key}", "variant")
    all_keys = sorted({key for allowed in PAYLOADS.values() for key in allowed})
    nested = F.array_compact(F.array(*[F.when(F.schema_of_variant(value(key)).rlike("^(?:OBJECT|ARRAY)"), key) for key in all_keys]))
    text = lambda key: F.when(F.schema_of_variant(value(key)) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    long = F.array_compact(F.array(*[F.when(F.char_length(text(key)) > LONGEST_VALUE, key) for key in all_keys]))
    closed = F.lit(None).cast("string")
    for (of, key), values in CLOSED.items():
        closed = F.when((kind == of) & F.array_contains(keys, key) & ~F.coalesce(text(key).isin(*values), F.lit(False)), key).otherwise(closed)
    return F.when(allowed.isNull(), "unknown_kind").when(v.isNull() | keys.isNull(), "no_object").when(F.size(F.array_except(keys, allowed)) > 0, "key").when(F.size(nested) > 0, "no_scalar").when(F.size(long) > 0, "too_long").when(closed.isNotNull(), "not_in_list")


def renamed_payload(kind: Column, payload: Column) -> Column:
    """A sign-up's referrer_url becomes its referrer_host; what else a payload holds, and all other kinds, stay."""
    entries = F.from_json(payload, "map<string,string>")
    turned = F.map_concat(F.map_filter(entries, lambda k, _: ~k.isin("referrer_url", "referrer_host")), F.create_map(F.lit("referrer_host"), F.element_at(entries, "referrer_url")))
    return F.when((kind == "user_signed_up") & F.map_contains_key(entries, "referrer_url"), F.to_json(turned)).otherwise(payload)


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as kinds with payloads, good ones and bad ones."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("signup", "user_signed_up"), ("purchase", "posting_apply_clicked"), ("view", "posting_impression"), ("click", "user_exit_surveyed"), ("error", "crash")) for x in pair]), F.col("event_type"))
    key = F.element_at(F.create_map(*[F.lit(x) for pair in (("signup", "referrer_url"), ("purchase", "apply_destination"), ("view", "surface"), ("click", "exit_reason"), ("error", "surface")) for x in pair]), F.col("event_type"))
    value = F.when(n % 7 == 0, F.concat(F.lit('"'), F.repeat(F.lit("x"), 201), F.lit('"'))).when(n % 7 == 1, F.lit("[1]")).when(n % 7 == 2, F.lit('"hired"')).when(n % 7 == 3, F.lit("null")).otherwise(F.concat(F.lit('"v'), k, F.lit('"')))
    body = F.concat(F.lit('{"'), F.when(n % 11 == 0, "free_text").otherwise(key), F.lit('":'), value, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.when(n % 13 > 0, F.when(n % 17 == 0, F.lit("{bad")).otherwise(body)).alias("payload"))


def q_r08(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_payloads(spark, sf_dir).withColumn("payload", renamed_payload(F.col("kind"), F.col("payload")))
    fault = payload_fault(F.col("kind"), F.col("payload"))
    return rows.groupBy("kind", fault.alias("fault")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("payload").contains("referrer_host")).alias("hosts"))


def primary_records(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A row's record out of the posting that was strictly matched with it, in the shape that the upsert takes.

    rows: key, title, company, company_id, location, source_id, reasons. found: key, location, source_id, platform, label, tag, url, salary_min, salary_max, period, currency,
    raw, description, posted. Title and company are the row's. The posting's own id is kept where the row has it, or has none and no other row of the company holds it; pay becomes one structured
    observation; the day is exact if there is one. Rows without a key or a posting give no record. Holders of an id are counted, so a hot id is one row of the join.
    """
    held = rows.filter("source_id <> '' and company_id is not null").groupBy("company_id", "source_id").agg(F.count_distinct("key").alias("holders")).select(F.col("company_id").alias("h_company"), F.col("source_id").alias("h_id"), "holders")
    r = rows.filter("key <> ''").select(*[F.col(c).alias(f"r_{c}") for c in rows.columns])
    both = r.join(found, r["r_key"] == found["key"]).join(held, (F.col("r_company_id") == F.col("h_company")) & (F.col("source_id") == F.col("h_id")), "left")
    current = F.coalesce("r_source_id", F.lit(""))
    same, free = current == F.col("source_id"), (current == "") & F.col("holders").isNull()
    own = F.when((F.col("platform") != "") & (F.col("source_id") != "") & F.col("r_company_id").isNotNull() & (same | free), F.col("source_id"))
    paid = F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()
    period, currency = F.coalesce(F.nullif("period", F.lit("")), F.lit("unknown")), F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD"))
    one = F.struct(F.col("salary_min").alias("min_value"), F.col("salary_max").alias("max_value"), period.alias("period"), currency.alias("currency"), F.lit("ats_structured").alias("provenance"), F.col("raw").alias("raw_text"))
    filled = lambda *cols: F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))
    return both.select(
        F.col("r_key").alias("key"), F.col("r_title").alias("title"), F.col("r_company").alias("company"), F.col("r_company_id").alias("company_id"), F.coalesce(F.nullif("location", F.lit("")), F.nullif("r_location", F.lit("")), F.lit("")).alias("location"),
        own.alias("source_id"), F.when(own.isNotNull(), F.col("platform")).alias("platform"), filled("label", "tag").alias("sources"), filled("url").alias("source_urls"), "salary_min", "salary_max", period.alias("period"), currency.alias("currency"),
        F.when(paid, "ats_structured").alias("provenance"), F.filter(F.array(F.when(paid, one)), lambda x: x.isNotNull()).alias("observations"), F.nullif("description", F.lit("")).alias("description"), F.col("posted"), F.when(F.col("posted").isNotNull(), "exact").alias("posted_precision"), F.col("r_reasons").alias("reasons"),
    )


def order_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as rows and each one's first line as the posting found for it."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.cast("string").alias("key"), F.col("o_orderpriority").alias("title"), F.concat(F.lit("c"), "o_custkey").alias("company"), F.when(k % 19 > 0, F.col("o_custkey")).alias("company_id"), F.when(k % 3 == 0, "Oslo").alias("location"), F.when(k % 4 == 0, F.concat(F.lit("p"), k % 50)).when(k % 4 == 1, "").alias("source_id"), F.when(k % 6 == 0, F.array(F.lit("jd_short"))).alias("reasons"))
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")).alias("l")).select("l_orderkey", "l.*")
    q, p = F.col("l_quantity"), F.col("l_partkey")
    found = first.select(
        F.col("l_orderkey").cast("string").alias("key"), F.when(p % 2 == 0, F.lit("")).otherwise("Bonn").alias("location"), F.concat(F.lit("p"), F.col("l_orderkey") % 50).alias("source_id"), F.when(p % 5 > 0, "lever").alias("platform"), F.when(p % 7 > 0, "Lever").alias("label"), F.when(p % 3 == 0, "primary_source_llm").alias("tag"),
        F.concat(F.lit("https://x/"), p).alias("url"), F.when(q > 10, q * 1000).alias("salary_min"), F.when(q > 20, q * 1500).alias("salary_max"), F.when(p % 4 == 0, "annual").alias("period"), F.lit("").alias("currency"), F.lit(None).cast("string").alias("raw"), F.when(p % 2 == 0, "text").otherwise("").alias("description"), F.when(p % 3 > 0, F.to_date("l_shipdate")).alias("posted"),
    )
    return rows, found


def q_g08(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = primary_records(*order_rows(spark, sf_dir))
    o = F.get("observations", 0)
    return out.select("key", "title", "company", "location", "source_id", "platform", F.array_join("sources", "+").alias("sources"), F.array_join("source_urls", "+").alias("urls"), "provenance", o["min_value"].alias("low"), o["max_value"].alias("high"), o["period"].alias("period"), "currency", "description", "posted", "posted_precision", F.size(F.coalesce("reasons", F.array().cast("array<string>"))).alias("reasons"))


def enriched(rows: DataFrame) -> DataFrame:
    """Rows after an enrichment's write: tier, reasons, observations, text.

    rows: tier, reasons, observations (of min_value, max_value, period, currency, provenance), and of the write: outcome ok, locked or refused, new_tier, new_text, low, high, provenance, reason, adds. A locked
    write leaves the row as it is, to come again; a refused one moves the tier alone, so that it doesn't. Pay is noted whether it won or not, each observation once; one reason is added or
    taken away, the others stay in order, and a list that can't be read counts as empty.
    """
    ok, moved = F.col("outcome") == "ok", F.col("outcome").isin("ok", "refused")
    kind = "array<struct<min_value:double,max_value:double,period:string,currency:string,provenance:string>>"
    one = F.struct(F.col("low").cast("double").alias("min_value"), F.col("high").cast("double").alias("max_value"), F.lit("unknown").alias("period"), F.lit("USD").alias("currency"), F.col("provenance"))
    old = F.coalesce("observations", F.array().cast(kind)).cast(kind)
    noted = F.when(ok & (F.col("low").isNotNull() | F.col("high").isNotNull()), merged(old, F.array(one).cast(kind))).otherwise(old)
    had = F.coalesce(F.from_json("reasons", "array<string>"), F.array().cast("array<string>"))
    has = F.array_contains(had, F.col("reason"))
    turned = F.when(F.col("adds") & ~has, F.concat(had, F.array("reason"))).when(~F.col("adds") & has, F.filter(had, lambda x: x != F.col("reason"))).otherwise(had)
    return rows.withColumns({"tier": F.when(moved, F.col("new_tier")).otherwise(F.col("tier")), "text": F.when(ok, F.coalesce("new_text", "text")).otherwise(F.col("text")), "observations": noted, "reasons": F.when(ok & F.col("reason").isNotNull(), turned).otherwise(had)})


def q_g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    seen = F.struct(F.lit(100.0).alias("min_value"), F.col("l_quantity").alias("max_value"), F.lit("unknown").alias("period"), F.lit("USD").alias("currency"), F.lit("llm_extract").alias("provenance"))
    rows = table(spark, sf_dir, "lineitem").select(
        pick(("free", None), k).alias("tier"), pick(('["timeout","jd_short"]', "[]", "{bad", None), k).alias("reasons"), F.when(n % 2 == 0, F.array(seen)).alias("observations"), F.lit("old").alias("text"), pick(("ok", "ok", "locked", "refused"), n).alias("outcome"), F.lit("paid").alias("new_tier"),
        F.when(n % 3 > 0, "new").alias("new_text"), F.when(k % 3 > 0, 100.0).alias("low"), F.when(k % 6 > 1, F.when(n % 4 == 0, F.col("l_quantity")).otherwise(7.0)).alias("high"), F.lit("llm_extract").alias("provenance"), F.when(k % 5 > 0, "timeout").alias("reason"), (n % 3 == 0).alias("adds"),
    )
    out = enriched(rows)
    return out.groupBy(F.coalesce("tier", F.lit("")).alias("tier"), "text", F.array_join("reasons", "+").alias("reasons"), F.size("observations").alias("observations")).agg(F.count(F.lit(1)).alias("n"))


def q_c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that refuse or ask back, by role."""
    lead = F.element_at(F.array(*[F.lit(x) for x in ("I cannot reformat this posting. ", "As an AI, ", "No job description text was provided: ", "x" * 396 + " I need ", "Could you please  provide ", "")]), (F.col("turn") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").groupBy("role", (F.col("turn") % 6).alias("kind"), refuses(F.concat(lead, "text")).alias("refuses")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "X10_tiles": q_x10, "X13_match_titles": q_x13, "M05_text_quality": q_m05, "C11_axes": q_c11, "X19_direct": q_x19, "X28_apply_address": q_x28, "F08_due_for_pages": q_f08, "R08_payloads": q_r08, "G08_primary_source": q_g08, "G13_enrichment": q_g13,
    "C22_refusals": q_c22,
}
_LIST = lambda xs: "[" + ", ".join("null" if x is None else f"'{x}'" for x in xs) + "]"
_MAP = lambda d: "map {" + ", ".join(f"'{k}': '{v}'" for k, v in d.items()) + "}"
_WORDS = lambda c: f"string_split(array_to_string(list_transform(list_filter(string_split_regex({c}, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''), lambda w: coalesce({_MAP(CAPITALS)}[w], {_MAP(SHORT)}[lower(w)], lower(w))), ' '), ' ')"
_PAGE_POSTINGS = f"""{PAGES}, p as (select doc_id as id, (doc_id % 40)::varchar as company, doc_id % 97 as seen, concat_ws(' ', case doc_id % 4 when 0 then 'Sr.' when 1 then 'Lead Generation' when 2 then 'Level 3' end, title) as title,
    case when doc_id % 5 = 0 then text || chr(10) || 'What you''ll do: responsibilities' else text end as text from pages_read),
w as (select *, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as w from p),
g as (select *, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as g from w),
near as (select a.id, a.g as a, b.g as b from g a join g b on a.company = b.company and a.id <> b.id qualify row_number() over (partition by a.id order by b.seen desc, b.id desc) <= {SIBLINGS}),
like_ as (select id, max(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))) as o from near where len(a) > 0 and len(b) > 0 group by 1),
q as (select g.*, case when coalesce(text, '') = '' then 0 else round(0.4::double * case when len(w) between 200 and 1200 then 1.0 else 0.5 end::double + 0.4::double * regexp_matches(lower(text), '{POSTING.replace(chr(39), chr(39) * 2)}')::int + 0.2::double * (1 - coalesce(o, 0)), 3) end::double as quality from g left join like_ using (id))"""
ORACLES = {
    "X10_tiles": f"""with t as (select p_partkey, [p_name, p_size || ' ' || p_name || ' Jobs', '1,200+ openings ' || p_size, p_partkey || '|Oslo, ' || p_name, p_name || ' Posted ' || p_size || ' days ago', p_name || ' $' || p_size || ',000', repeat(p_type || ' ', 6), '12 ' || p_type || ' results'][p_partkey % 8 + 1] as title from part),
w as (select *, string_split(trim(title), ' ') as w from t)
select p_partkey, len(w) > 1 and translate(rtrim(w[1], '+'), '0123456789,', '') = '' and w[1] <> '' and contains('0123456789', w[1][1]) and list_contains({_LIST(LIST_NOUNS)}, lower(w[-1])) as tile,
  length(title) > 140 or len(list_filter({_LIST(METADATA)}, lambda m: contains(lower(title), m))) > 0 or p_partkey % 8 = 5 or (p_partkey % 8 = 3 and p_partkey > 999) as blob from w""",
    "X13_match_titles": f"""with {NAMED}, t as (select p_partkey as id, ['Sr. ', 'EM, ', 'em ', 'Dir./', ''][p_partkey % 5 + 1] || title as title from named), w as (select id, {_WORDS("title")} as w from t),
g as (select distinct concat_ws(' ', string_split(p_name, ' ')[2], case when p_partkey % 2 = 0 then 'SENIOR' else 'Manager' end) as target from part where p_size = 1), h as (select target, {_WORDS("target")} as t from g)
select id, count(*) as targets, min(target) as first from w join h on len(t) > 0 and list_has_all(w, t) group by 1""",
    "M05_text_quality": f"with {_PAGE_POSTINGS} select id, quality from q",
    "C11_axes": rf"""with {_PAGE_POSTINGS} select id, regexp_matches(regexp_replace(title, '(?i)\blead generation\b', ' ', 'g'), '(?i)\b(sr|senior|lead|level [1-9]|manager|jr|junior|vp|director|staff|principal|chief|associate|intern)\b') as seniority, id % 3 = 0 as pay_stated,
  case when id % 17 = 0 or id % 13 = 0 then 0.1 when id % 7 = 0 then 0.3 when seen <= 7 then 1.0 when seen <= 30 then 0.7 when seen <= 90 then 0.4 else 0.2 end::double as freshness, quality from q""",
    "X19_direct": f"select platform, coalesce(list_contains({_LIST(DIRECT)}, platform), false) as direct, count(*) as n from (select {_LIST([*DIRECT, *KEYWORD_ONLY, *STUBS, 'unknown', None])}[s_suppkey % {len(DIRECT) + 11} + 1] as platform from supplier) group by 1, 2",
    "X28_apply_address": """with a as (select page_id, case when page_id % 4 = 0 then url when page_id % 3 > 0 then 'HTTPS://Board.Example:8080/' || page_id when page_id % 6 = 3 then 'no address' end as apply_url from pages)
select page_id, apply_url, case when apply_url is null or apply_url = 'no address' then null else lower(regexp_extract(apply_url, '://([^/:?#]+)', 1)) end as destination from a""",
    "F08_due_for_pages": f"""with c as (select c_custkey, ['hit', 'miss', 'error', 'unprobed', null][c_custkey % 5 + 1] as probe, {_LIST([*STUBS, *DIRECT[:3], None])}[c_custkey // 5 % 10 + 1] as platform, c_acctbal > 0 and c_custkey % 7 > 0 as open from customer)
select c_custkey, probe, platform from c where open and (probe in ('miss', 'error') or probe = 'hit' and platform in ('jobvite', 'google', 'taleo', 'kronos', 'modernloop', 'governmentjobs'))""",
    "R08_payloads": """with e as (select event_id as n, event_type, map {'signup': 'user_signed_up', 'purchase': 'posting_apply_clicked', 'view': 'posting_impression', 'click': 'user_exit_surveyed', 'error': 'crash'}[event_type] as kind,
  case when event_id % 13 = 0 then 'none' when event_id % 17 = 0 then 'bad' when event_id % 11 = 0 then 'free' else 'own' end as body, event_id % 7 as v from events)
select kind, case when kind = 'crash' then 'unknown_kind' when body = 'none' then null when body = 'bad' then 'no_object' when body = 'free' then 'key' when v = 1 and event_type <> 'signup' then 'no_scalar' when v = 0 then 'too_long' when event_type = 'click' and v <> 2 then 'not_in_list' end as fault,
  count(*) as n, count(*) filter (event_type = 'signup' and body = 'own') as hosts from e group by 1, 2""",
    "G08_primary_source": """with r as (select *, o_orderkey::varchar as key, case when o_orderkey % 19 > 0 then o_custkey end as company_id, case when o_orderkey % 4 = 0 then 'p' || (o_orderkey % 50) end as sid from orders),
f as (select distinct on (l_orderkey) l_orderkey, l_partkey as p, l_quantity as q, l_shipdate from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate),
j as (select r.*, f.*, 'p' || (o_orderkey % 50) as new_id, exists (select 1 from r h where h.company_id = r.company_id and h.sid = 'p' || (r.o_orderkey % 50)) as held from r join f on l_orderkey = o_orderkey),
k as (select *, case when p % 5 > 0 and company_id is not null and (sid = new_id or sid is null and not held) then new_id end as own from j)
select key, o_orderpriority as title, 'c' || o_custkey as company, case when p % 2 > 0 then 'Bonn' when o_orderkey % 3 = 0 then 'Oslo' else '' end as location, own as source_id, case when own is not null then 'lever' end as platform,
  concat_ws('+', case when p % 7 > 0 then 'Lever' end, case when p % 3 = 0 then 'primary_source_llm' end) as sources, 'https://x/' || p as urls, case when q > 10 then 'ats_structured' end as provenance, case when q > 10 then q * 1000 end as low, case when q > 20 then q * 1500 end as high,
  case when q > 10 then case when p % 4 = 0 then 'annual' else 'unknown' end end as period, 'USD' as currency, case when p % 2 = 0 then 'text' end as description, case when p % 3 > 0 then l_shipdate::date end as posted, case when p % 3 > 0 then 'exact' end as posted_precision, (o_orderkey % 6 = 0)::int as reasons from k""",
    "G13_enrichment": """with a as (select l_orderkey as k, l_linenumber as n, l_quantity as q, ['ok', 'ok', 'locked', 'refused'][l_linenumber % 4 + 1] as outcome from lineitem),
b as (select *, case k % 4 when 0 then ['timeout', 'jd_short'] else [] end as had, case when k % 3 > 0 then 100 end as low, case when k % 6 > 1 then case when n % 4 = 0 then q else 7 end end as high from a)
select case outcome when 'locked' then case when k % 2 = 0 then 'free' else '' end else 'paid' end as tier, case when outcome = 'ok' and n % 3 > 0 then 'new' else 'old' end as text,
  array_to_string(case when outcome <> 'ok' or k % 5 = 0 then had when n % 3 = 0 and k % 4 > 0 then ['timeout'] when n % 3 > 0 then list_filter(had, lambda x: x <> 'timeout') else had end, '+') as reasons,
  ((n % 2 = 0)::int + (outcome = 'ok' and (low is not null or high is not null) and not (n % 2 = 0 and low is not null and high is not distinct from q))::int)::int as observations, count(*) as n from b group by 1, 2, 3, 4""",
    "C22_refusals": f"""select role, turn % 6 as kind, {refuses_sql("t")} as refuses, count(*) as n
from (select role, turn, ['I cannot reformat this posting. ', 'As an AI, ', 'No job description text was provided: ', repeat('x', 396) || ' I need ', 'Could you please provide ', ''][turn % 6 + 1] || text as t from conversations) group by 1, 2, 3""",
}
