"""Single rules that larger queries are built of, each as a query of its own over the given tables (F, J, W, O, U, X, D, M, R, G, T, S ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.names import NAMED, STOPWORDS, named, title_key, title_key_sql
from millrace.functions.urls import ADDRESSES, TWO_LABEL, addresses, direct_address, host, posting_id, registrable
from millrace.plans.projections import LISTINGS, listings, table
from millrace.streaming.events import shared_folder

AS_OF = "2024-01-20 00:00:00"
# Words of company names that tell no company.
COMPANY_STOPWORDS = (
    "corp corporate corporation inc llc ltd company companies group holdings partners office offices enterprise enterprises global international national services service solutions technologies "
    "technology systems digital"
).split()
#: Feed orders by token; each ends with the id, so that pages don't overlap.
ORDERS = {
    "newest": [("o_orderdate", True)], "oldest": [("o_orderdate", False)], "price_desc": [("o_totalprice", True)], "price_asc": [("o_totalprice", False)],
    "priority": [("o_orderpriority", False), ("o_orderdate", True)], "status": [("o_orderstatus", False), ("o_totalprice", True)], "customer": [("o_custkey", False)],
}
DURABLE = ("signup", "purchase")
#: Edges of a word in any script; what \b takes for a letter differs between engines and their versions.
BEFORE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def ordering(token: str) -> list[Column]:
    """The columns of an allowed sort token, nulls last in both directions; an unknown token raises."""
    if token not in ORDERS:
        raise ValueError(f"unknown sort token {token!r}")
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in ORDERS[token]] + [F.col("o_orderkey").asc()]


def like_escaped(term: str) -> str:
    """a term in which LIKE's own characters stand for themselves."""
    for c in ("\\", "%", "_"):
        term = term.replace(c, "\\" + c)
    return f"%{term}%"


def acronym(company: Column) -> Column:
    """The name's letters and digits run together, where a run is short or marks part the name; null where it tells nothing."""
    low = F.lower(company)
    joined = F.regexp_replace(low, "[^a-z0-9]", "")
    short = F.exists(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda r: F.char_length(r) < 3)
    return F.when((F.char_length(joined) >= 2) & (short | low.rlike(r"[^a-z0-9\s]")) & ~joined.isin(*STOPWORDS, *COMPANY_STOPWORDS), joined)


def stems(company: Column) -> Column:
    """Runs of two letters or digits and more that aren't stop words, and the acronym."""
    runs = F.filter(F.regexp_extract_all(F.lower(company), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.char_length(t) >= 2) & ~t.isin(*STOPWORDS, *COMPANY_STOPWORDS))
    return F.array_distinct(F.concat(runs, F.array_compact(F.array(acronym(company)))))


def acronym_in(short: Column, body: Column) -> Column:
    """The acronym stands in the body as a word, with at most one mark between its characters."""
    spread = F.regexp_replace(short, "(?<=.)(?=.)", "[^a-z0-9]?")
    return F.coalesce(F.regexp_like(F.lower(body), F.concat(F.lit(BEFORE), spread, F.lit(AFTER))), F.lit(False))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in an order that ends with an id."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")


def q_f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.element_at(F.array(*[F.lit(x) for x in (" 50%_off", " 50 percent off", " a\\b", "")]), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", name.like(like_escaped("50%_o")).alias("percent"), name.like(like_escaped("\\b")).alias("slash"))


def q_f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates of the expiry cascade, never-checked first, by nation."""
    checked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderdate").alias("checked"))
    rows = table(spark, sf_dir, "customer").join(checked, F.col("c_custkey") == F.col("o_custkey"), "left")
    turn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("checked").asc_nulls_first(), "c_custkey"))
    return rows.select("c_custkey", "checked", turn.alias("turn"))


def q_j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of known companies; the list of statuses is what tells the variants apart."""
    rows = listings(spark, sf_dir).join(table(spark, sf_dir, "supplier"), F.col("company_id") == F.col("s_suppkey"))
    return rows.groupBy("s_nationkey").agg(F.count_if(F.col("stratum").isin("O", "F")).alias("main"), F.count_if(F.col("stratum").isin("O", "F", "P")).alias("with_open"))


def q_j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a name that may be empty or missing, counted with a fallback."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "part").select("p_partkey", name.alias("name")), F.col("doc_id") == F.col("p_partkey"), "left")
    return rows.groupBy(F.coalesce(F.nullif("name", F.lit("")), F.lit("(none)")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def q_j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("l_returnflag", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def q_j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins: suppliers with and without a returned line of full quantity."""
    hits = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    s = table(spark, sf_dir, "supplier")
    return s.join(hits, "s_suppkey", "left_semi").select("s_suppkey", F.lit(True).alias("hit")).unionByName(s.join(hits, "s_suppkey", "left_anti").select("s_suppkey", F.lit(False).alias("hit")))


def q_j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a user's latest event, ties by id, of a kind: by a window, not a theta join."""
    rows = latest(table(spark, sf_dir, "events"), "user_id", F.desc("ts"), F.desc("event_id"))
    return rows.select("user_id", "event_id", (F.col("event_type") == "error").alias("last_failed"))


def q_w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


def q_w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest lines of each part."""
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(w)).filter("k <= 5").select("l_partkey", "k", "l_orderkey", "l_linenumber", "l_shipdate")


def q_w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of total, running share and how many are at risk, over counted values of each segment."""
    rows = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    per, run = Window.partitionBy("c_mktsegment"), Window.partitionBy("c_mktsegment").orderBy("c_nationkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = F.sum("n").over(per) - F.sum("n").over(run) + F.col("n")
    rows = rows.withColumns({"at_risk": at_risk, "share": F.round(F.col("n") / F.sum("n").over(per), 6)})
    return rows.select("c_mktsegment", "c_nationkey", "share", "at_risk", F.round(F.exp(F.sum(F.when(F.col("at_risk") > F.col("n"), F.log(1 - F.col("n") / F.col("at_risk"))).otherwise(0.0)).over(run)), 6).alias("survives"))


def q_o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 25 under every sort token."""
    pages = [table(spark, sf_dir, "orders").orderBy(*ordering(t)).limit(25).select(F.lit(t).alias("token"), "o_orderkey") for t in ORDERS]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out


def q_u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first cohort and, apart from it, a second one behind."""
    c = table(spark, sf_dir, "customer")
    first, second = c.filter("c_acctbal < 0"), c.filter("c_acctbal >= 0 and c_mktsegment = 'MACHINERY'")
    return first.select("c_custkey", F.lit(1).alias("cohort")).unionByName(second.select("c_custkey", F.lit(2).alias("cohort")))


def q_u03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the current window that the one before doesn't hold."""
    rows = table(spark, sf_dir, "events").select("ts", F.concat_ws(":", "event_type", (F.col("user_id") % 500).cast("string")).alias("pattern"))
    now, prior = F.lit(AS_OF).cast("timestamp_ntz"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    current, old = rows.filter(F.col("ts") >= now), rows.filter((F.col("ts") >= prior) & (F.col("ts") < now))
    return current.select("pattern").distinct().join(old.select("pattern"), "pattern", "left_anti")


def q_u05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared words of a part's name and type, and whether the name's are all in the other."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    a, b = words(F.col("p_name")), words(F.concat(F.col("p_type"), F.lit(" ring "), F.element_at(F.split("p_name", " "), 1)))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(a, b)).alias("shared"), (F.size(F.array_except(a, b)) == 0).alias("inside"))


def q_x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms and stems of companies, and whether documents of the same number mention the acronym."""
    start = F.element_at(F.array(*[F.lit(x) for x in ("AT&T ", "C3 ", "", "The Corporate Group", "L'Acme ")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    company = F.when(F.col("p_partkey") % 5 == 3, start).otherwise(F.concat(start, F.element_at(F.split("p_name", " "), 1)))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), company.alias("company"), F.element_at(F.split("p_name", " "), 1).alias("w"))
    docs = table(spark, sf_dir, "documents").join(rows, "doc_id")
    body = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" by A.T&T-"), "w", F.lit(", 3M"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" of c-3 "), "w")).otherwise(F.col("text"))
    return docs.select("doc_id", acronym(F.col("company")).alias("acronym"), F.array_join(stems(F.col("company")), " ").alias("stems"), acronym_in(acronym(F.col("company")), body).alias("mentioned"))


def q_x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).groupBy(registrable(host(F.col("url"))).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def q_x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses(spark, sf_dir).select("page_id", posting_id(F.col("url")).alias("posting_id"), direct_address(F.col("url")).alias("direct"))


def q_d01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text with and without an offset to naive UTC, bad text to null; fractional days to a fixed moment."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.concat(iso, F.lit("+02:00"))).when(F.col("event_id") % 4 == 2, iso).otherwise(F.concat(F.lit("x"), iso))
    moment = F.try_to_timestamp(text)
    return table(spark, sf_dir, "events").select("event_id", ((F.unix_micros(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_micros(moment)) / 86_400_000_000.0).alias("days"))


def q_d02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency to a moment from a day, which counts from its midnight in UTC."""
    rows = listings(spark, sf_dir)
    days = F.timestamp_diff("MICROSECOND", F.to_date("first_seen").cast("timestamp_ntz"), F.col("last_seen")) / 86_400_000_000.0
    return rows.groupBy("stratum").agg(F.round(F.avg(days), 6).alias("mean_days"), F.count_if(days < 0).alias("before"))


def q_m04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's observations the one of the most trusted provenance, then the latest line."""
    kinds = F.array(*[F.lit(x) for x in ("feed_string", "ats_structured", "jd_regex", "llm_extract")])
    rank = F.element_at(F.create_map(*[x for k, r in (("ats_structured", 4), ("jd_regex", 3), ("llm_extract", 2), ("feed_string", 1)) for x in (F.lit(k), F.lit(r))]), F.col("provenance"))
    rows = table(spark, sf_dir, "lineitem").withColumn("provenance", F.element_at(kinds, (F.pmod(F.col("l_partkey"), F.lit(4)) + 1).cast("int")))
    return rows.groupBy("l_orderkey").agg(F.max(F.struct(rank.alias("r"), "l_linenumber", "l_partkey", "provenance")).alias("b")).select("l_orderkey", "b.provenance", "b.l_linenumber")


def q_r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards around JSON text: is it valid, an object, and does a field hold a number."""
    text = F.when(F.col("event_id") % 5 == 0, F.lit("{bad")).when(F.col("event_id") % 5 == 1, F.lit("[1, 2]")).when(F.col("event_id") % 5 == 2, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    v = F.try_parse_json(text)
    rows = table(spark, sf_dir, "events").select(v.isNotNull().alias("valid"), F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)).alias("object"), F.try_variant_get(v, "$.k", "int").alias("k"))
    return rows.groupBy("valid", "object", F.col("k").isNotNull().alias("number")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


def q_r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements filtered with their order kept: an order's lines without returned ones."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("a"))
    return rows.select("l_orderkey", F.array_join(F.transform(F.filter("a", lambda x: x["l_returnflag"] != "R"), lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


def q_r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field under any of its aliases, the first that holds something."""
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"jobTitle": "t'), k, F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"title": "", "name": "n'), k, F.lit('"}'))).otherwise(F.col("props"))
    paths = ("$.title", "$.jobTitle", "$.name")
    rows = table(spark, sf_dir, "events").withColumn("j", text)
    return rows.groupBy(F.coalesce(*[F.nullif(F.get_json_object("j", p), F.lit("")) for p in paths]).alias("title")).agg(F.count(F.lit(1)).alias("n"))


def q_r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings merged by source: each kind's first and last sight and how often, per user."""
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return per


def q_g05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation writes its four place columns together, and only if one of them differs."""
    old = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") < 0).alias("remote"), F.lit("seed").alias("by"))
    seen = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("l")).select(F.col("o_custkey").alias("c_custkey"), (F.col("l.o_orderkey") % 25).cast("int").alias("s_nation"))
    rows = old.join(seen, "c_custkey", "left")
    new = F.when(F.col("s_nation").isNotNull(), F.struct(F.col("s_nation").alias("nation"), "kind", F.lit(False).alias("remote"), F.lit("order").alias("by")))
    differs = new.isNotNull() & ~(new["nation"].eqNullSafe(F.col("nation")) & (new["remote"] == F.col("remote")))
    kept = F.when(differs, new).otherwise(F.struct("nation", "kind", "remote", "by"))
    return rows.select("c_custkey", kept.alias("k"), F.coalesce(differs, F.lit(False)).alias("written")).select("c_custkey", "k.*", "written")


def q_g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamp is set once per version: rows of an older version, or without one, are stamped anew."""
    version = F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 4).cast("int"))
    stamped = ~version.eqNullSafe(F.lit(2))
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(version, F.lit(-1)).alias("before")).agg(F.count_if(stamped).alias("stamped"), F.count(F.lit(1)).alias("n"))


def q_t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events older than ten days go, but for durable kinds."""
    keep = F.col("event_type").isin(*DURABLE) | (F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 10 days"))
    return table(spark, sf_dir, "events").filter(keep).select("event_id", "event_type")


def q_s09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies taken in by lower-cased name: empty, wordless and overlong names rejected, status only rising, gaps filled."""
    shape = F.element_at(F.array(F.col("p_brand"), F.concat(F.lit("  "), F.upper("p_brand")), F.lit("--"), F.repeat(F.lit("x"), F.lit(300)), F.lit(""), F.concat("p_brand", F.lit(" "))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.trim(shape).alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("platform"), (F.col("p_size") % 4).alias("status"))
    fine = rows.filter((F.col("name") != "") & F.col("name").rlike("[A-Za-z0-9]") & (F.char_length("name") <= 200))
    first = F.min(F.struct("p_partkey", "name"))
    return fine.groupBy(F.lower("name").alias("key")).agg(first.getField("name").alias("name"), F.max("status").alias("status"), F.min(F.when(F.col("platform").isNotNull(), F.struct("p_partkey", "platform"))).getField("platform").alias("platform"), F.count(F.lit(1)).alias("n"))


def q_s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate written as CSV with a header into the shared folder, and read back."""
    rows = listings(spark, sf_dir).groupBy("stratum", "flag").agg(F.count(F.lit(1)).alias("n"), F.count_if("gone").alias("gone"))
    path = shared_folder(spark, "aggregates")
    rows.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("stratum string, flag string, n long, gone long").csv(path)


QUERIES = {
    "F02_like_escape": q_f02, "F17_cascade": q_f17, "J02_companies": q_j02, "J04_fallback_name": q_j04, "J05_pipeline": q_j05, "J06_semi_anti": q_j06, "J07_latest_kind": q_j07, "W01_latest_row": q_w01,
    "W02_top_five": q_w02, "W05_shares": q_w05, "O01_sort_tokens": q_o01, "U02_two_cohorts": q_u02, "U03_new_patterns": q_u03, "U05_shared_words": q_u05, 
    "X14_acronyms": q_x14, "X17_domains": q_x17, "X19_posting_ids": q_x19, "D01_iso_times": q_d01, "D02_day_latency": q_d02, "M04_trust": q_m04, 
    "R02_json_guards": q_r02, "R03_kept_order": q_r03, "R04_aliases": q_r04, "R06_sightings": q_r06, "G05_place_writes": q_g05, 
    "G12_stamps": q_g12, "T10_retention": q_t10, "S09_companies": q_s09, "S10_csv_sink": q_s10,
}
_STOP = ", ".join(f"'{w}'" for w in (*STOPWORDS, *COMPANY_STOPWORDS))
_P = lambda p: p.replace("'", "''")
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
_LABELS = f"string_split({_HOST}, '.')"
_JOBID = r"nullif(regexp_extract(url, '[?&]gh_jid=(\d+)', 1), '')"
_ORDER_SQL = lambda t: ", ".join(f"{c} {'desc' if down else 'asc'} nulls last" for c, down in ORDERS[t]) + ", o_orderkey"
ORACLES = {
    "F02_like_escape": r"""with n as (select p_partkey, p_name || [' 50%_off', ' 50 percent off', ' a\b', ''][(p_partkey % 4 + 1)::int] as name from part) select p_partkey, contains(name, '50%_o') as percent, contains(name, '\b') as slash from n""",
    "F17_cascade": "with c as (select o_custkey, max(o_orderdate) as checked from orders where o_orderstatus = 'F' group by 1) select c_custkey, checked, row_number() over (partition by c_nationkey order by checked nulls first, c_custkey)::int as turn from customer left join c on c_custkey = o_custkey",
    "J02_companies": f"with {LISTINGS} select s_nationkey, count(*) filter (stratum in ('O', 'F')) as main, count(*) filter (stratum in ('O', 'F', 'P')) as with_open from listings join supplier on company_id = s_suppkey group by 1",
    "J04_fallback_name": "select coalesce(nullif(case when p_partkey % 5 = 0 then '' else p_brand end, ''), '(none)') as name, count(*) as n from documents left join part on doc_id = p_partkey group by 1",
    "J05_pipeline": "select l_returnflag, o_orderpriority, count(*) as n from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus = 'P' group by 1, 2",
    "J06_semi_anti": "select s_suppkey, exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity >= 49) as hit from supplier",
    "J07_latest_kind": "select user_id, event_id, event_type = 'error' as last_failed from events e where not exists (select 1 from events f where f.user_id = e.user_id and (f.ts > e.ts or f.ts = e.ts and f.event_id > e.event_id))",
    "W01_latest_row": "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1",
    "W02_top_five": "select l_partkey, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)::int as k, l_orderkey, l_linenumber, l_shipdate from lineitem qualify k <= 5",
    "W05_shares": """with c as (select c_mktsegment, c_nationkey, count(*) as n from customer group by 1, 2),
r as (select *, n / sum(n) over (partition by c_mktsegment) as share, sum(n) over (partition by c_mktsegment order by c_nationkey desc)::bigint as at_risk from c)
select c_mktsegment, c_nationkey, round(share, 6) as share, at_risk, round(exp(sum(case when at_risk > n then ln(1 - n / at_risk) else 0 end) over (partition by c_mktsegment order by c_nationkey)), 6) as survives from r""",
    "O01_sort_tokens": " union all ".join(f"(select '{t}' as token, o_orderkey from orders order by {_ORDER_SQL(t)} limit 25)" for t in ORDERS),
    "U02_two_cohorts": "select c_custkey, case when c_acctbal < 0 then 1 else 2 end as cohort from customer where c_acctbal < 0 or c_mktsegment = 'MACHINERY'",
    "U03_new_patterns": f"with p as (select ts, event_type || ':' || (user_id % 500) as pattern from events) select pattern from p where ts >= timestamp '{AS_OF}' except select pattern from p where ts >= timestamp '2024-01-10' and ts < timestamp '{AS_OF}'",
    "U05_shared_words": """with w as (select p_partkey, list_distinct(string_split(lower(p_name), ' ')) as a, list_distinct(string_split(lower(p_type || ' ring ' || string_split(p_name, ' ')[1]), ' ')) as b from part)
select p_partkey, len(list_intersect(a, b))::int as shared, len(list_filter(a, lambda x: not list_contains(b, x))) = 0 as inside from w""",
    "X14_acronyms": rf"""with c as (select doc_id, string_split(p_name, ' ')[1] as w, case when p_partkey % 5 = 3 then 'The Corporate Group' else ['AT&T ', 'C3 ', '', '', 'L''Acme '][(p_partkey % 5 + 1)::int] || string_split(p_name, ' ')[1] end as company, text from documents join part on doc_id = p_partkey),
b as (select doc_id, lower(company) as low, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') as joined, lower(case doc_id % 3 when 0 then text || ' by A.T&T-' || w || ', 3M' when 1 then text || ' of c-3 ' || w else text end) as body from c),
a as (select *, case when length(joined) >= 2 and (len(list_filter(regexp_extract_all(low, '[a-z0-9]+'), lambda r: length(r) < 3)) > 0 or regexp_matches(low, '[^a-z0-9\s]')) and joined not in ({_STOP}) then joined end as acronym,
  list_filter(regexp_extract_all(low, '[a-z0-9]+'), lambda t: length(t) >= 2 and t not in ({_STOP})) as runs from b)
select doc_id, acronym, array_to_string(case when acronym is null or list_contains(runs, acronym) then runs else list_append(runs, acronym) end, ' ') as stems,
  coalesce(regexp_matches(body, '{BEFORE}' || array_to_string(regexp_extract_all(acronym, '.'), '[^a-z0-9]?') || '{AFTER}'), false) as mentioned from a""",
    "X17_domains": f"with {ADDRESSES} select case when array_to_string({_LABELS}[-2:], '.') in ({', '.join(repr(x) for x in TWO_LABEL)}) then array_to_string({_LABELS}[-3:], '.') else array_to_string({_LABELS}[-2:], '.') end as domain, count(*) as n from addresses group by 1",
    "X19_posting_ids": rf"with {ADDRESSES} select page_id, coalesce({_JOBID}, nullif(regexp_extract(url, '/jobs?/(\d+)', 1), '')) as posting_id, regexp_matches(url, '(?i)://(?:boards\.greenhouse\.io|(?:api|jobs)\.lever\.co|jobs\.ashbyhq\.com)/') as direct from addresses",
    "D01_iso_times": """with s as (select event_id, date_trunc('second', ts)::timestamp as s from events)
select event_id, case event_id % 4 when 3 then null else date_diff('microsecond', s - case event_id % 4 when 1 then interval 2 hours else interval 0 hours end, timestamp '2024-02-01')::double / 86400000000::double end as days from s""",
    "D02_day_latency": f"with {LISTINGS} select stratum, round(avg(date_diff('microsecond', first_seen::date::timestamp, last_seen) / 86400000000.0), 6) as mean_days, count(*) filter (last_seen < first_seen::date::timestamp) as before from listings group by 1",
    "M04_trust": """with p as (select *, ['feed_string', 'ats_structured', 'jd_regex', 'llm_extract'][(l_partkey % 4 + 1)::int] as provenance, [1, 4, 3, 2][(l_partkey % 4 + 1)::int] as r from lineitem)
select l_orderkey, provenance, l_linenumber from p qualify row_number() over (partition by l_orderkey order by r desc, l_linenumber desc, l_partkey desc) = 1""",
    "R02_json_guards": """with t as (select case event_id % 5 when 0 then '{bad' when 1 then '[1, 2]' when 2 then '{"k": "x"}' else props end as t from events),
v as (select json_valid(t) as valid, case when json_valid(t) then json_type(t) = 'OBJECT' else false end as object, case when json_valid(t) then try_cast(json_extract_string(t, '$.k') as int) end as k from t)
select valid, object, k is not null as number, count(*) as n, sum(k)::bigint as k from v group by 1, 2, 3""",
    "R03_kept_order": "select l_orderkey, coalesce(string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey, l_returnflag) filter (l_returnflag <> 'R'), '') as parts from lineitem group by 1",
    "R04_aliases": """with k as (select event_id, json_extract_string(props, '$.k') as k from events) select case event_id % 3 when 0 then 't' || k when 1 then 'n' || k end as title, count(*) as n from k group by 1""",
    "R06_sightings": "select user_id, event_type, min(ts) as first_seen, max(ts) as last_seen, count(*) as n from events group by 1, 2",
    "G05_place_writes": """with o as (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) % 25 as s from orders group by 1),
r as (select c_custkey, case when c_custkey % 3 > 0 then c_nationkey end as nation, c_mktsegment as kind, c_acctbal < 0 as remote, s::int as s from customer left join o on o_custkey = c_custkey),
d as (select *, s is not null and (s is distinct from nation or remote) as w from r)
select c_custkey, case when w then s else nation end as nation, kind, case when w then false else remote end as remote, case when w then 'order' else 'seed' end as "by", w as written from d""",
    "G12_stamps": "with v as (select case when o_orderkey % 3 > 0 then (o_orderkey % 4)::int end as v from orders) select coalesce(v, -1) as before, count(*) filter (v is distinct from 2) as stamped, count(*) as n from v group by 1",
    "T10_retention": f"select event_id, event_type from events where event_type in ('signup', 'purchase') or ts >= timestamp '{AS_OF}' - interval 10 days",
    "S09_companies": """with n as (select p_partkey, trim([p_brand, '  ' || upper(p_brand), '--', repeat('x', 300), '', p_brand || ' '][(p_partkey % 6 + 1)::int]) as name, case when p_size > 25 then p_type end as platform, p_size % 4 as status from part)
select lower(name) as key, arg_min(name, p_partkey) as name, max(status) as status, arg_min(platform, p_partkey) filter (platform is not null) as platform, count(*) as n from n where name <> '' and regexp_matches(name, '[A-Za-z0-9]') and length(name) <= 200 group by 1""",
    "S10_csv_sink": f"with {LISTINGS} select stratum, flag, count(*) as n, count(*) filter (gone) as gone from listings group by 1, 2",
}
