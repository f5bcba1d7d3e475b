"""Rule ladders as ordered conditions: text scrubbing, freshness, classification, staleness, scoring."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import jaccard, shingles
from millrace.functions.phrases import said
from millrace.plans.projections import AXES, LISTINGS, SCORES, days_between, let, listings, rounded, scores, table

AS_OF = "1996-01-01"
# Scam phrases, refusal wordings, terminal tiers, thresholds in days.
PHRASES = ("unlimited income potential", "be your own boss", "work from home opportunity", "join our team of leaders", "financial freedom", "residual income", "recruit your downline", "earnings depend on", "crypto trading opportunity")
TERMINAL = ("exhausted", "agentic", "agentic_exhausted", "expired")
STALE, UNVERIFIED, ARCHIVE, GRACE, CEILING = 14, 5, 30, 14, 60
BACKOFF_HOURS, RETRY_LIMIT = (1, 4, 24), 3
LOW_SIGNAL_CHARS, APPLY_MEAN, STRONG_AXES, STRONG = 1500, 3.5, 3, 4
#: What a model says instead of an answer, and how many characters of one are looked at.
REFUSAL_SAID = (
    "i'd|id + be happy to", "i'm|im + ready|not able", "i + need|notice|cannot|can't|don't have|only have", "unable to + complete|reformat|draft|answer", "you've|you have + provided|shared", "please + provide|share|give + the",
    "could you provide", "could you please provide", "was not provided", "no job description + content|text + was provided", "insufficient + information|context|detail",
    "more + information|informations|context|contexts|detail|details + is|are + needed",
)
REFUSAL_HEAD = 400


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def ladder(rungs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds; order is meaning."""
    out = F.lit(otherwise)
    for test, value in reversed(rungs):
        out = F.when(test, value).otherwise(out)
    return out


def scrubbed(text: Column) -> Column:
    """Recipient header lines dropped, e-mail addresses redacted."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"(?i)^\s*(?:to|cc|bcc|delivered-to|x-original-to)\s*:"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+", "[redacted]")


def shadow_hash(text: Column) -> Column:
    """Digest of the text without lines of nothing but counters and dates, white space collapsed."""
    chrome = r"(?i)\b(?:over )?\d+ (?:applicants|views|days? ago|hours? ago)\b|\bposted\b|[·•|]"
    kept = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, chrome, " "), r"\s+", "") != "")
    return F.sha2(F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " ")), 256)


def refuses(text: Column) -> Column:
    """An answer that refuses or asks back instead, told by its head."""
    return F.substring(text, 1, REFUSAL_HEAD).rlike(said(REFUSAL_SAID))


def refuses_sql(text: str) -> str:
    """The same in SQL: the phrases one by one."""
    spelt = [" ".join(words) for phrase in REFUSAL_SAID for words in product(*[slot.split("|") for slot in phrase.split(" + ")])]
    return f"(len(list_filter([{', '.join(repr(x) if chr(39) not in x else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in spelt)}], lambda p: regexp_matches(lower(substr({text}, 1, {REFUSAL_HEAD})), '(^|[^a-z0-9_])' || p || '($|[^a-z0-9_])'))) > 0)"


def legitimacy(text: Column) -> Column:
    """The first scam phrase, then the earnings pattern; null for clean text."""
    low = F.lower(text)
    return ladder([(low.contains(p), F.lit(p)) for p in PHRASES] + [(text.rlike(r"(?i)earn\s+\$\d{3,}/day"), F.lit("high-daily-earnings claim"))])


def freshness(stale: Column, expiry: Column, anchor: Column, now: Column) -> Column:
    """Stale or expired 0.1, by age 1.0 / 0.7 / 0.4 / 0.2, without a date 0.3."""
    age = days_between(anchor, now)
    return ladder([(stale | expiry.eqNullSafe("expired"), 0.1), (anchor.isNull(), 0.3), (age <= 7, 1.0), (age <= 30, 0.7), (age <= 90, 0.4)], 0.2)


def text_quality(words: Column, shaped: Column, overlap: Column) -> Column:
    """Word band, shape and boilerplate, rounded to three places."""
    return F.round(0.4 * F.when(words.between(200, 1200), 1.0).otherwise(0.5) + 0.4 * shaped.cast("int") + 0.2 * (1 - overlap), 3)


def classification(excluded: tuple[str, ...] = ()) -> Column:
    """Five classes of a score row by the first rule that holds; a malformed row is quarantined, not an error.

    An excluded axis counts as neutral for the reject rule and not at all for mean and strength; the flat-neutral
    test reads the row as scored.
    """
    used = [F.col(a) for a in AXES if a not in excluded]
    every = lambda test, cols: [test(c) for c in cols]
    all_of = lambda tests: F.forall(F.array(*tests), lambda t: t)
    valid = all_of(every(lambda c: c.isNotNull() & c.between(1, 5), [F.col(a) for a in AXES]))
    strong = sum((F.when(c >= STRONG, 1).otherwise(0) for c in used[1:]), F.when(used[0] >= STRONG, 1).otherwise(0))
    mean = sum(used[1:], used[0]) / len(used)
    return ladder(
        [
            (F.col("flagged"), "reject"),
            (F.coalesce(F.col("tier").isin(*TERMINAL), F.lit(False)) & (F.col("text_length") < LOW_SIGNAL_CHARS), "low_signal"),
            (~F.coalesce(valid, F.lit(False)), "quarantined"),
            (all_of(every(lambda c: c == 3, [F.col(a) for a in AXES])), "low_signal"),
            (F.exists(F.array(*used), lambda c: c == 1), "reject"),
            (all_of(every(lambda c: c >= 3, used)) & (strong >= STRONG_AXES) & (mean >= APPLY_MEAN), "apply"),
            (all_of(every(lambda c: c >= 2, used)), "consider"),
        ],
        "skip",
    )


def staleness(rows: DataFrame, now: Column) -> DataFrame:
    """Mark, gated mark and clear in turn, each seeing the one before, then archive; one pass of derived columns.

    Needs is_stale, status, expiry, first_seen, last_seen, checked_at, gated, unverifiable, company_id, enabled, probe, attempts.
    """
    passive = F.col("status").isin("discovered", "reviewing")
    before = lambda days: now - F.expr(f"interval {days} days")
    cutoff = F.when(F.col("expiry").eqNullSafe("inconclusive"), before(UNVERIFIED)).otherwise(before(STALE))
    marked = F.col("is_stale") | (passive & (F.col("last_seen") < cutoff))
    rows = rows.withColumn("m1", marked)
    gated = ~F.col("m1") & passive & F.col("expiry").eqNullSafe("inconclusive") & F.coalesce(F.col("checked_at") < before(UNVERIFIED), F.lit(False)) & F.col("gated")
    rows = rows.withColumn("m2", F.col("m1") | gated)
    seen_again = (F.col("last_seen") >= cutoff) & ~(passive & F.col("gated") & ~F.col("expiry").eqNullSafe("live"))
    rows = rows.withColumn("stale_now", F.col("m2") & ~(seen_again | ~passive))
    unseen = passive & (F.col("last_seen") < before(ARCHIVE))
    branch = F.col("company_id").isNull() | ~F.col("enabled") | ((F.col("probe") == "miss") & F.col("checked_at").isNotNull()) | ((F.col("probe") == "hit") & (F.col("attempts") >= 3) & F.col("checked_at").isNotNull())
    candidate = passive & F.col("unverifiable") & (F.col("first_seen") < before(GRACE))
    why = ladder([(unseen, f"not_seen_{ARCHIVE}_days"), (candidate & (F.col("first_seen") < before(CEILING)), "unverifiable_ceiling"), (candidate & F.coalesce(branch, F.lit(False)), "unverifiable_confirmed")])
    return rows.withColumn("evidence", why).withColumn("status_now", F.when(F.col("evidence").isNotNull(), "archived").otherwise(F.col("status"))).drop("m1", "m2")


def staleness_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("listing_id")
    return listings(spark, sf_dir).filter((F.col("last_seen") >= as_of() - F.expr("interval 90 days")) & (F.col("last_seen") < as_of())).select(
        "listing_id", "company_id", "first_seen", "last_seen", (n % 3 == 0).alias("is_stale"), F.when(n % 5 < 3, "discovered").when(n % 5 == 3, "reviewing").otherwise("applied").alias("status"),
        F.when(n % 4 == 0, "inconclusive").when(n % 4 == 1, "live").alias("expiry"), F.when(n % 7 > 1, F.col("last_seen") - F.expr("interval 4 days")).alias("checked_at"), (n % 6 == 0).alias("gated"), (n % 11 == 0).alias("unverifiable"),
        (n % 2 == 0).alias("enabled"), F.when(n % 13 < 6, "hit").otherwise("miss").alias("probe"), (n % 5).alias("attempts"),
    )


def scan_error(attempts: Column, transient: Column, at: Column) -> Column:
    """Transient errors back off by a fixed schedule and turn into a miss at the limit."""
    hours = F.element_at(F.array(*[F.lit(h) for h in BACKOFF_HOURS]), F.least(attempts, F.lit(len(BACKOFF_HOURS))).cast("int"))
    state = ladder([(~transient, "miss"), (attempts >= RETRY_LIMIT, "miss")], "error")
    return let(state, lambda s: F.struct(s.alias("state"), F.when(s == "error", at + F.make_dt_interval(F.lit(0), hours)).alias("retry_at")))


def q_x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(scrubbed(F.col("text")), 256).alias("scrubbed_sha256"))


def q_x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", shadow_hash(F.col("text")).alias("shadow"))


def q_x24(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("conv_id") % 10 == 0, " Financial Freedom awaits").when(F.col("conv_id") % 10 == 1, " earn $500/day").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", legitimacy(text).alias("note"), refuses(text).alias("refusal"))
    return rows.groupBy("note", "refusal").agg(F.count(F.lit(1)).alias("n"))


def q_d05(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("listing_id")
    value = freshness(n % 17 == 0, F.when(n % 5 == 0, "expired").when(n % 5 == 1, "live"), F.when(n % 9 > 0, F.col("last_seen")), as_of())
    return listings(spark, sf_dir).filter(F.col("last_seen") < as_of()).groupBy(value.alias("freshness")).agg(F.count(F.lit(1)).alias("n"))


def q_d03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations with a unit ladder, local-day windows in UTC."""
    s = F.timestamp_diff("SECOND", F.col("o_orderdate"), as_of())
    label = F.when(F.abs(s) < 3600, F.format_string("%dm", (s / 60).cast("int"))).when(F.abs(s) < 86_400 * 2, F.format_string("%dh", (s / 3600).cast("int"))).otherwise(F.format_string("%dd", (s / 86_400).cast("int")))
    return table(spark, sf_dir, "orders").groupBy(label.alias("age")).agg(F.count(F.lit(1)).alias("n"))


def q_d04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A date of better precision wins, never an equal one."""
    rank = lambda c: F.when(c == "exact", 3).when(c == "approximate", 2).when(c == "proxy", 1).otherwise(0)
    kind = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("exact", "approximate", "proxy", "none")]), (c % 4 + 1).cast("int"))
    rows = listings(spark, sf_dir).select("listing_id", "first_seen", "last_seen", kind(F.col("part_id")).alias("old"), kind(F.col("company_id")).alias("new"))
    wins = rank(F.col("new")) > rank(F.col("old"))
    return rows.select("listing_id", F.when(wins, F.col("last_seen")).otherwise(F.col("first_seen")).alias("posted"), F.when(wins, F.col("new")).otherwise(F.col("old")).alias("precision"))


def q_c05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir)
    return rows.groupBy(classification().alias("class"), classification(("location_fit",)).alias("without_location")).agg(F.count(F.lit(1)).alias("n"))


def q_c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = staleness(staleness_rows(spark, sf_dir), as_of())
    return out.select("listing_id", F.col("stale_now").alias("is_stale"), F.col("status_now").alias("status"), "evidence")


def q_c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment tiers: two updates that exclude each other, requeue and expire."""
    rows = scores(spark, sf_dir)
    again = F.col("tier").eqNullSafe("exhausted") & (F.col("text_length") >= 600) & ~F.col("flagged")
    gone = F.col("tier").eqNullSafe("exhausted") & (F.col("text_length") < 600)
    return rows.groupBy(ladder([(again, "agentic"), (gone, "expired"), (F.col("tier").isNull(), "free")], "kept").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def q_c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", scan_error((n % 5 + 1), n % 3 > 0, F.col("ts")).alias("s"))
    return rows.select("event_id", "s.state", "s.retry_at")


def q_c25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's verdict by precedence."""
    per = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))
    return per.select("day", ladder([(F.col("n") == 0, "no_data"), (F.col("n") < 330, "incomplete"), (F.col("errors") > F.col("n") / 5, "alarm"), (F.col("users") < 100, "reviewed")], "pass").alias("verdict"))


def q_c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected days without a report, each once."""
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-02-05', interval 1 day)) as day")
    reports = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.to_date("ts").alias("day")).distinct()
    return days.join(reports, "day", "left_anti")


def q_c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: a weighted score of factors from 0 to 100, rounded to one place, over a threshold."""
    pay = F.least(F.lit(100.0), F.col("price") / 600)
    age = days_between(F.col("last_seen"), as_of())
    recency = ladder([(age <= 7, 100.0), (age <= 30, 70.0), (age <= 90, 40.0)], 10.0)
    rows = listings(spark, sf_dir).filter(F.col("last_seen") < as_of())
    total = rounded(0.4 * pay + 0.3 * recency + 0.2 * (F.col("quantity") * 2) + 0.1 * F.when(F.col("stratum") == "P", 100.0).otherwise(20.0), 1)
    return rows.select("listing_id", total.alias("score")).filter("score >= 60")


def q_c27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of a row as an ordered array, empty when it is fine."""
    w = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "negative_balance"), F.when(F.trim("c_name") == "", "no_name"), F.when(F.col("c_nationkey") > 20, "unusual_nation"), F.when(F.col("c_mktsegment").isNull(), "no_segment")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(w, ",").alias("warnings"))


_AXES_SQL = lambda op: " and ".join(f"{a} {op}" for a in AXES)


def _class_sql(excluded: str = "") -> str:
    used = [a for a in AXES if a != excluded]
    strong = " + ".join(f"({a} >= 4)::int" for a in used)
    return f"""case when flagged then 'reject' when tier = 'exhausted' and text_length < 1500 then 'low_signal' when {_AXES_SQL('= 3')} then 'low_signal'
    when {" or ".join(f"{a} = 1" for a in used)} then 'reject' when {" and ".join(f"{a} >= 3" for a in used)} and {strong} >= 3 and ({" + ".join(used)}) / {len(used)}.0 >= 3.5 then 'apply'
    when {" and ".join(f"{a} >= 2" for a in used)} then 'consider' else 'skip' end"""


_STALE = f"""{LISTINGS}, s as (select listing_id as n, listing_id, company_id, first_seen, last_seen, listing_id % 3 = 0 as is_stale,
    case when listing_id % 5 < 3 then 'discovered' when listing_id % 5 = 3 then 'reviewing' else 'applied' end as status,
    case listing_id % 4 when 0 then 'inconclusive' when 1 then 'live' end as expiry, case when listing_id % 7 > 1 then last_seen - interval 4 days end as checked_at,
    listing_id % 6 = 0 as gated, listing_id % 11 = 0 as unverifiable, listing_id % 2 = 0 as enabled, case when listing_id % 13 < 6 then 'hit' else 'miss' end as probe, listing_id % 5 as attempts, timestamp '{AS_OF}' as now
  from listings where last_seen >= timestamp '{AS_OF}' - interval 90 days and last_seen < timestamp '{AS_OF}'),
p as (select *, status in ('discovered', 'reviewing') as passive, now - case when expiry is not distinct from 'inconclusive' then interval 5 days else interval 14 days end as cutoff from s),
m as (select *, is_stale or (passive and last_seen < cutoff) as m1 from p),
g as (select *, m1 or (not m1 and passive and expiry is not distinct from 'inconclusive' and coalesce(checked_at < now - interval 5 days, false) and gated) as m2 from m)"""
QUERIES = {
    "X21_scrub": q_x21, "X23_shadow_hash": q_x23, "X24_legitimacy": q_x24, "D03_durations": q_d03, "D04_precision": q_d04, "D05_freshness": q_d05, "C05_classification": q_c05, "C12_staleness": q_c12,
    "C18_tiers": q_c18, "C19_deadman": q_c19, "C20_weighted_score": q_c20, "C23_scan_errors": q_c23, "C25_report_verdict": q_c25, "C27_warnings": q_c27,
}
ORACLES = {
    "X21_scrub": r"""select doc_id, sha256(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?i)^\s*(?:to|cc|bcc|delivered-to|x-original-to)\s*:')), chr(10)),
  '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+', '[redacted]', 'g')) as scrubbed_sha256 from documents""",
    "X23_shadow_hash": r"""select doc_id, sha256(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x:
  regexp_replace(regexp_replace(x, '(?i)\b(?:over )?\d+ (?:applicants|views|days? ago|hours? ago)\b|\bposted\b|[·•|]', ' ', 'g'), '[ \t\n\x0b\f\r]+', '', 'g') <> ''), ' '), '[ \t\n\x0b\f\r]+', ' ', 'g'))) as shadow from documents""",
    "X24_legitimacy": f"""with s as (select text || case when conv_id % 10 = 0 then ' Financial Freedom awaits' when conv_id % 10 = 1 then ' earn $500/day' else '' end as t from conversations)
select case {" ".join(f"when contains(lower(t), '{p}') then '{p}'" for p in PHRASES)} when regexp_matches(t, '(?i)earn\\s+\\$\\d{{3,}}/day') then 'high-daily-earnings claim' end as note,
  {refuses_sql("t")} as refusal, count(*) as n from s group by all""",
    "D03_durations": f"""with s as (select (epoch_us(timestamp '{AS_OF}') - epoch_us(o_orderdate)) / 1000000 as x from orders), t as (select trunc(x)::bigint as s from s)
select case when abs(s) < 3600 then trunc(s / 60)::int || 'm' when abs(s) < 172800 then trunc(s / 3600)::int || 'h' else trunc(s / 86400)::int || 'd' end as age, count(*) as n from t group by 1""",
    "D04_precision": f"""with {LISTINGS}, k as (select listing_id, first_seen, last_seen, ['exact', 'approximate', 'proxy', 'none'][(part_id % 4 + 1)::int] as o, ['exact', 'approximate', 'proxy', 'none'][(company_id % 4 + 1)::int] as w,
  3 - part_id % 4 as ro, 3 - company_id % 4 as rw from listings)
select listing_id, case when rw > ro then last_seen else first_seen end as posted, case when rw > ro then w else o end as precision from k""",
    "D05_freshness": f"""with {LISTINGS}, a as (select listing_id % 17 = 0 or listing_id % 5 = 0 as bad, case when listing_id % 9 > 0 then last_seen end as d, (epoch_us(timestamp '{AS_OF}') - epoch_us(last_seen)) / 86400000000.0::double as age from listings where last_seen < timestamp '{AS_OF}')
select (case when bad then 0.1 when d is null then 0.3 when age <= 7 then 1.0 when age <= 30 then 0.7 when age <= 90 then 0.4 else 0.2 end)::double as freshness, count(*) as n from a group by 1""",
    "C05_classification": f"with {SCORES} select {_class_sql()} as class, {_class_sql('location_fit')} as without_location, count(*) as n from scores group by all",
    "C12_staleness": f"""with {_STALE}, c as (select *, m2 and not ((last_seen >= cutoff and not (passive and gated and expiry is distinct from 'live')) or not passive) as stale_now,
  passive and unverifiable and first_seen < now - interval 14 days as cand from g),
e as (select *, case when passive and last_seen < now - interval 30 days then 'not_seen_30_days' when cand and first_seen < now - interval 60 days then 'unverifiable_ceiling'
  when cand and coalesce(company_id is null or not enabled or (probe = 'miss' and checked_at is not null) or (probe = 'hit' and attempts >= 3 and checked_at is not null), false) then 'unverifiable_confirmed' end as evidence from c)
select listing_id, stale_now as is_stale, case when evidence is not null then 'archived' else status end as status, evidence from e""",
    "C18_tiers": f"with {SCORES} select case when tier = 'exhausted' and text_length >= 600 and not flagged then 'agentic' when tier = 'exhausted' and text_length < 600 then 'expired' when tier is null then 'free' else 'kept' end as tier, count(*) as n from scores group by 1",
    "C19_deadman": "select d::date as day from range(date '2024-01-01', date '2024-02-06', interval 1 day) t(d) where d::date not in (select ts::date from events where event_type = 'signup')",
    "C20_weighted_score": f"""with {LISTINGS}, a as (select *, (epoch_us(timestamp '{AS_OF}') - epoch_us(last_seen)) / 86400000000.0::double as age from listings where last_seen < timestamp '{AS_OF}'),
t as (select listing_id, round(0.4::double * least(100.0, price / 600) + 0.3::double * case when age <= 7 then 100.0 when age <= 30 then 70.0 when age <= 90 then 40.0 else 10.0 end + 0.2::double * (quantity * 2) + 0.1::double * case stratum when 'P' then 100.0 else 20.0 end, 1) as score from a)
select * from t where score >= 60""",
    "C23_scan_errors": """with e as (select event_id, event_id % 5 + 1 as a, event_id % 3 > 0 as transient, ts from events where event_type = 'error'), s as (select *, case when not transient or a >= 3 then 'miss' else 'error' end as state from e)
select event_id, state, case when state = 'error' then ts + to_hours([1, 4, 24][least(a, 3)::int]) end as retry_at from s""",
    "C25_report_verdict": """with p as (select ts::date as day, count(*) as n, count(*) filter (event_type = 'error') as errors, count(distinct user_id) as users from events group by 1)
select day, case when n = 0 then 'no_data' when n < 330 then 'incomplete' when errors > n / 5 then 'alarm' when users < 100 then 'reviewed' else 'pass' end as verdict from p""",
    "C27_warnings": """select c_custkey, array_to_string(list_filter([case when c_acctbal < 0 then 'negative_balance' end, case when trim(c_name) = '' then 'no_name' end, case when c_nationkey > 20 then 'unusual_nation' end, case when c_mktsegment is null then 'no_segment' end], lambda x: x is not null), ',') as warnings from customer""",
}
