"""The three-way content verdict (C03) and the junk gate (C04) over documents read as pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import STEM, STOPWORDS, mentions_a_stem, tokens, tokens_sql
from millrace.functions.phrases import counted, counted_sql, said
from millrace.operators.content import _JUNK_SQL, JOBS_GAP, JOBS_IN, PAGES, is_junk, pages_read, rejection, rejection_sql
from millrace.operators.parts import AFTER, BEFORE, COMPANY_STOPWORDS, acronym, acronym_in, stems
from millrace.operators.rules import ladder

LEAST_CLEAN, LEAST_PROSE = 600, 40
# What a posting says of itself, headers of its demands, topics of career pages and their figures.
POSTING_WORDS = ("responsibilities", "qualifications", "requirements")
POSTING_SAID = (
    "what + you'll|you’ll|youll|you will|you'will + do|bring", "what we're|what we’re|what were|what we are|we're|we’re|we are + looking for", "about + the|this + role", "minimum|preferred + qualifications", "who you are",
    "your + impact|role|responsibilities", "in this role", "the ideal candidate", "you will be responsible", "key + responsibilities|duties", "essential + functions|duties", "job + description|summary|duties",
    "role + overview|summary", "day to day|day-to-day", "duties include",
)
DEMANDS = ("responsibility|responsibilities", "qualification|qualifications", "requirement|requirements", "skill|skills", "duties", "essential functions")
EXPLAINER_SAID = ("what is + a|an", "salary of + a|an", "profile page", "career path", "how to become + a|an")
AVERAGES_SAID = ("national average", "bls", "median salary in the")

DEMAND, EXPLAINER, AVERAGES = said(DEMANDS), said(EXPLAINER_SAID), said(AVERAGES_SAID)
POSTING = rf"{said(POSTING_WORDS)}|{said(POSTING_SAID).replace(chr(92) + 'b', '')}"
RESULTS = r"\bresults\b"
PROSE = rf'(?i)"(?:job[_\-\s]?)?(?:description|content)"\s*:[^"]*"[^"]{{{LEAST_PROSE},}}'
#: A header of demands is empty where the next line with anything in it is a header as deep or less deep, or where none follows.
EMPTY_DEMANDS = "(?mi)" + "|".join(rf"^#{{{d}}}[ \t]+[^\n]*{DEMAND.removeprefix('(?i)')}[^\n]*(?:\s*\z|\s*\n#{{1,{d}}}[ \t]+\S)" for d in range(1, 7))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def wrapped_blob(text: Column) -> Column:
    """A JSON value without a description that is four fifths of the text and ends it, behind a short heading."""
    start = F.char_length(F.regexp_extract(text, r"^[^\[{]*", 0))
    rest = F.substring(text, start + 1, F.char_length(text))
    return F.coalesce(text.rlike(r"[\[{]") & (start * 5 <= F.char_length(text)) & F.try_parse_json(rest).isNotNull() & rest.rlike(r"[\]}]\z") & ~rest.rlike(PROSE), F.lit(False))


def widening(title: Column, text: Column) -> Column:
    """What makes a text that isn't rejected doubtful; null if nothing does."""
    explains = F.coalesce(title, F.lit("")).rlike(EXPLAINER) | text.rlike(EXPLAINER)
    return ladder([
        (text.rlike(EMPTY_DEMANDS), "empty_requirements_header"), (wrapped_blob(text), "json_config_blob_unanchored"), (counted(text, JOBS_IN, JOBS_GAP) | counted(text, RESULTS, 0), "listing_index"),
        (explains & text.rlike(AVERAGES), "career_explainer_seo"),
    ])


def mentions_company(company: Column, text: Column) -> Column:
    """A stem of the company stands in the text: short ones as words, longer ones by their first letters, acronyms with marks between."""
    low, short = F.lower(text), acronym(company)
    told = F.filter(stems(company), lambda s: ~s.eqNullSafe(short))
    stem = lambda s: F.when(F.char_length(s) < STEM, F.regexp_like(low, F.concat(F.lit(BEFORE), s, F.lit(AFTER)))).otherwise(low.contains(F.substring(s, 1, STEM)))
    return F.coalesce(F.exists(told, stem), F.lit(False)) | acronym_in(short, text)


def with_verdict(rows: DataFrame) -> DataFrame:
    """Rows (title, company, text, ...) with verdict and why: REJECT for C02's reasons, AMBIGUOUS for a doubt, CLEAN for a long
    text with a posting's wordings that mentions its title, or its company where it has no title.

    A null or empty text is AMBIGUOUS (empty); a clean text that never mentions its company is AMBIGUOUS (company_absent),
    where the company's name has anything to mention. Each step is a column of its own, so that no pattern is searched twice.
    """
    none = F.lit("")
    out = rows.withColumn("_body", stripped(F.coalesce("text", none)))
    out = out.withColumn("_reason", F.when(F.coalesce("text", none) != "", rejection(F.coalesce("title", none), F.col("text"))))
    out = out.withColumn("_doubt", F.when(F.col("_reason").isNull(), F.when(F.col("_body") == "", "empty").otherwise(widening(F.col("title"), F.col("_body")))))
    words = F.when(F.coalesce("title", none) != "", tokens(F.col("title"))).otherwise(tokens(F.coalesce("company", none)))
    clean = (F.char_length("_body") >= LEAST_CLEAN) & F.col("_body").rlike(POSTING) & mentions_a_stem(words, F.col("_body"))
    absent = F.coalesce(F.size(stems(F.col("company"))) > 0, F.lit(False)) & ~mentions_company(F.col("company"), F.col("_body"))
    last = F.when(clean, F.when(absent, "company_absent").otherwise("shape+grounded")).otherwise("needs_adjudication")
    out = out.withColumn("why", F.coalesce("_reason", "_doubt", last))
    verdict = ladder([(F.col("_reason").isNotNull(), "REJECT"), (F.col("why") == "shape+grounded", "CLEAN")], "AMBIGUOUS")
    return out.withColumn("verdict", verdict).drop("_body", "_reason", "_doubt")


_SAYS = (
    "'\n## Requirements\n\n### \n## Benefits\nPaid leave'", "'\n## Requirements\n### Minimum\nFive years. Key duties of ' || title || ' for ' || company", "'\nAbout the role of ' || title || ' at ' || company",
    "'\nAbout this role of ' || title", "' What is a ' || title || '? The national average is high.'", "' ' || title || ': 1,234 results for you'", "'\nIn this role as ' || title || ' of ' || company || '\n# Skills\n\n'",
)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a posting's sections behind their texts, one in nine a settings blob under a heading."""
    says = "case doc_id div 9 % 9 " + " ".join(f"when {k} then {s}" for k, s in enumerate(_SAYS)) + " end"
    blob = "'# ' || title || '\n{\"theme\": \"' || repeat('y', 300) || '\"}'"
    return pages_read(spark, sf_dir).select("doc_id", "title", "company", F.expr(f"case when doc_id div 9 % 9 = 8 then {blob} else concat(text, coalesce({says}, '')) end").alias("text"))


def q_c03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdict(postings(spark, sf_dir)).select("doc_id", "verdict", "why")


def q_c04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts too short or led by a page's own navigation, with their words per line."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    words = F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)))
    return pages_read(spark, sf_dir).filter("text is not null").select("doc_id", is_junk(F.col("text")).alias("junk"), F.round(words / F.greatest(lines, F.lit(1)), 6).alias("density"))


QUERIES = {"C03_content_verdict": q_c03, "C04_junk": q_c04}
_STOP = ", ".join(f"'{w}'" for w in (*STOPWORDS, *COMPANY_STOPWORDS))
_Q = lambda p: p.replace("'", "''")
_SAID_SQL = "case doc_id // 9 % 9 " + " ".join(f"when {k} then {s}" for k, s in enumerate(_SAYS)) + " end"
ORACLES = {
    "C04_junk": f"""with {PAGES} select doc_id, {_JUNK_SQL} as junk,
  round(len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) / greatest(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), 1), 6) as density from pages_read where text is not null""",
    "C03_content_verdict": rf"""with {PAGES},
q as (select doc_id, title, company, case when doc_id // 9 % 9 = 8 then '# ' || title || chr(10) || '{{"theme": "' || repeat('y', 300) || '"}}' else text || coalesce({_SAID_SQL}, '') end as text from pages_read),
s as (select *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as body, lower(coalesce(company, '')) as name, {rejection_sql("title")} as reason from q),
n as (select doc_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as i from s),
d as (select *, length(regexp_extract(line, '^(#{{1,6}})\s+\S', 1)) as depth from n where trim(line, ' ' || chr(9) || chr(13)) <> ''),
e as (select *, lead(depth) over (partition by doc_id order by i) as following from d),
h as (select doc_id, bool_or(depth > 0 and regexp_matches(line, '{_Q(DEMAND)}') and coalesce(following between 1 and depth, true)) as hollow from e group by 1),
m as (select *, regexp_replace(name, '[^a-z0-9]', '', 'g') as joined, regexp_extract_all(name, '[a-z0-9]+') as runs, strpos(translate(body, '[', '{{'), '{{') as k from s left join h using (doc_id)),
a as (select *, list_filter(runs, lambda t: length(t) >= 2 and t not in ({_STOP})) as told,
  case when length(joined) >= 2 and (len(list_filter(runs, lambda r: length(r) < 3)) > 0 or regexp_matches(name, '[^a-z0-9\s]')) and joined not in ({_STOP}) then joined end as short from m),
f as (select *, case when reason is not null then null when body = '' then 'empty' when hollow then 'empty_requirements_header'
    when k > 0 and (k - 1) * 5 <= length(body) and json_valid(substr(body, k::bigint)) and not regexp_matches(body, '{_Q(PROSE)}') then 'json_config_blob_unanchored'
    when {counted_sql("body", JOBS_IN, JOBS_GAP)} or {counted_sql("body", RESULTS, 0)} then 'listing_index'
    when (regexp_matches(title, '{_Q(EXPLAINER)}') or regexp_matches(body, '{_Q(EXPLAINER)}')) and regexp_matches(body, '{_Q(AVERAGES)}') then 'career_explainer_seo' end as doubt,
  regexp_matches(body, '{_Q(POSTING)}') and length(body) >= {LEAST_CLEAN}
    and len(list_filter(case when title <> '' then {tokens_sql("title")} else {tokens_sql("coalesce(company, '')")} end, lambda t: contains(lower(body), substr(t, 1, {STEM})))) > 0 as clean,
  (len(told) > 0 or short is not null) and not (len(list_filter(told, lambda t: t is distinct from short and case when length(t) < {STEM} then regexp_matches(lower(body), '{BEFORE}' || t || '{AFTER}') else contains(lower(body), substr(t, 1, {STEM})) end)) > 0
    or coalesce(regexp_matches(lower(body), '{BEFORE}' || array_to_string(regexp_extract_all(short, '.'), '[^a-z0-9]?') || '{AFTER}'), false)) as absent from a)
select doc_id, case when reason is not null then 'REJECT' when doubt is null and clean and not absent then 'CLEAN' else 'AMBIGUOUS' end as verdict,
  coalesce(reason, doubt, case when clean and absent then 'company_absent' when clean then 'shape+grounded' else 'needs_adjudication' end) as why from f""",
}
