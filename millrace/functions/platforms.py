"""Which hiring platform an address belongs to, and the name of its board there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.projections import let, table

# Hosts of the platforms, the places of board names in their addresses, and how much an address tells.
API, BOARD = 10, 5
_GUID = "[0-9a-f-]{36}"
DEMOS = ("sapsfdemojobs.com", "jobs.hr.cloud.sap.com")


@dataclass(frozen=True)
class Rule:
    """One kind of address. name says how the board's name is put together: `1` is a group of the pattern as written, `1l` in
    lower case, `site` and `netloc` are read from the whole address, anything else stands for itself. A rule without a name
    ends the search with no platform; shape_only marks a name that any careers host has."""

    platform: str
    pattern: str
    name: tuple[str, ...] = ("1",)
    specificity: int = BOARD
    unless: str | None = None
    shape_only: bool = False
    any_case: bool = True

    @property
    def regexp(self) -> str:
        return ("(?i)" if self.any_case else "") + "https?://" + self.pattern


def _behind(host: str, *folders: str) -> str:
    """The segment behind a host and its folders."""
    return "/".join([host.replace(".", r"\."), *folders, "([^/?#]+)"])


def _label(domain: str) -> str:
    """The one label in front of a domain."""
    return r"([a-z0-9-]+)\." + domain.replace(".", r"\.")


_TENANTS = {"recruitee": "recruitee.com", "breezy": "breezy.hr", "jazzhr": "applytojob.com", "pinpoint": "pinpointhq.com", "personio": "jobs.personio.(?:de|com)", "bamboohr": "bamboohr.com", "teamtailor": "teamtailor.com"}
_WORKDAY = r"([^/]+)\.myworkdayjobs\.com/"
#: In order: the first rule that matches decides, however little it tells.
RULES = (
    Rule("lever", _behind("api.lever.co", "v0", "postings"), specificity=API),
    Rule("greenhouse", _behind("boards-api.greenhouse.io", "v1", "boards"), specificity=API),
    Rule("workday", _WORKDAY + "wday/cxs/[^/]+/([^/?#]+)", ("1", "/", "2"), specificity=API),
    Rule("smartrecruiters", _behind("api.smartrecruiters.com", "v1", "companies"), specificity=API),
    Rule("lever", _behind("jobs.lever.co")),
    Rule("greenhouse", "(?:job-)?" + _behind("boards.greenhouse.io")),
    Rule("ashby", _behind("jobs.ashbyhq.com"), any_case=False),
    Rule("workday", _WORKDAY + "(?:en-US/)?([^/?#]+)", ("1", "/", "2"), unless="/wday/"),
    Rule("smartrecruiters", "(?:jobs|careers)" + _behind(".smartrecruiters.com")),
    *[Rule(name, _label(domain), ("1l",)) for name, domain in _TENANTS.items()],
    Rule("workable", _behind("apply.workable.com"), ("1l",)),
    Rule("jobvite", _behind("jobs.jobvite.com"), ("1l",)),
    Rule("paylocity", rf"[^/]*recruiting\.paylocity\.com/recruiting/jobs/all/({_GUID})"),
    Rule("rippling", _behind("ats.rippling.com"), ("1l",)),
    Rule("ultipro", rf"(recruiting\d*\.ultipro\.com)/([a-z0-9]+)/jobboard/({_GUID})", ("1l", "/", "2", "/", "3l")),
    Rule("oracle_cloud", r"([a-z0-9][a-z0-9-]*\.fa\.[a-z0-9-]+\.oraclecloud\.com)", ("1l", "|", "site")),
    Rule("icims", r"(?:careers|jobs)-([a-z0-9][a-z0-9-]*)\.icims\.com", ("1l",)),
    Rule("successfactors", "(?:" + "|".join(h.replace(".", r"\.") for h in DEMOS) + ")", ()),
    Rule("phenom", r"(?:careers|jobs)\.([a-z0-9.-]+)", ("netloc",), shape_only=True),
    Rule("successfactors", r"(career\d*\.successfactors\.(?:com|eu))\b.*company=([^&]+)", ("1l", "|", "2")),
    Rule("adp", rf"workforcenow\.adp\.com/.*[?&]cid=({_GUID})", ("1l",)),
)
_SITE, _NETLOC = "(?i)(?:/sites/|siteNumber=)([a-z0-9_]+)", r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _part(url: Column, rule: Rule, part: str) -> Column:
    if part.rstrip("l").isdigit():
        group = F.regexp_extract(url, rule.regexp, int(part.rstrip("l")))
        return F.lower(group) if part.endswith("l") else group
    if part == "site":
        return let(F.regexp_extract(url, _SITE, 1), lambda s: F.when(s == "", "CX_1").otherwise(s))
    return F.lower(F.regexp_extract(url, _NETLOC, 1)) if part == "netloc" else F.lit(part)


def platform(url: Column) -> Column:
    """(platform, slug, specificity, shape_only) by the first rule that an address meets, also one inside another's
    parameters; null for none, for a null or empty address and for a vendor's demonstration hosts."""
    out = F.lit(None)
    for rule in reversed(RULES):
        meets = url.rlike(rule.regexp)
        if rule.unless:
            meets = meets & ~F.contains(F.lower(url), F.lit(rule.unless))
        found = F.struct(F.lit(rule.platform).alias("platform"), F.concat(*[_part(url, rule, p) for p in rule.name]).alias("slug"), F.lit(rule.specificity).alias("specificity"), F.lit(rule.shape_only).alias("shape_only"))
        out = F.when(meets, found if rule.name else F.lit(None)).otherwise(out)
    return out


_TAIL = "0a1B-4c2d-8e3F-0123456789ab"
#: Addresses as pages link to them; {u} is the page's own, {n} its number, {z} the same as eight digits.
SHAPES = (
    "{u}", "https://api.lever.co/v0/postings/Co-{n}?mode=json", "HTTPS://Boards-API.greenhouse.io/v1/boards/Acme{n}/jobs", "https://co{n}.wd5.myworkdayjobs.com/wday/cxs/co{n}/Careers/jobs",
    "https://api.smartrecruiters.com/v1/companies/Co{n}/postings", "https://jobs.lever.co/Co-{n}/apply", "https://job-boards.greenhouse.io/co{n}#jobs", "https://jobs.ashbyhq.com/Co%20{n}/1", "https://Jobs.AshbyHQ.com/Co{n}",
    "https://Co{n}.wd1.myworkdayjobs.com/en-US/External", "https://co{n}.wd1.myworkdayjobs.com/wday/other", "https://careers.smartrecruiters.com/Co{n}", "https://Co{n}.recruitee.com/o/x", "https://co-{n}.breezy.hr", "https://co{n}.applytojob.com/apply",
    "https://co{n}.pinpointhq.com/", "https://co{n}.jobs.personio.de/job/1", "https://co{n}.bamboohr.com/jobs", "https://a.co{n}.teamtailor.com/", "https://apply.workable.com/Co{n}/j/1", "https://jobs.jobvite.com/Co{n}/job",
    "https://recruiting.paylocity.com/Recruiting/Jobs/All/{z}-" + _TAIL + "/Acme", "https://ats.rippling.com/Co{n}/jobs", "https://recruiting2.ultipro.com/ABC{n}/JobBoard/{z}-" + _TAIL + "/",
    "https://co{n}.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_{n}/jobs", "https://co{n}.fa.em3.oraclecloud.com/hcmUI", "https://careers-co{n}.icims.com/jobs/1", "https://sapsfdemojobs.com/career?company={n}",
    "https://Careers.co{n}.com:8080/job/1", "https://career4.successfactors.com/career?company=Co{n}&lang=en", "https://workforcenow.adp.com/mascsr/default/mdf/recruitment.html?cid={z}-" + _TAIL, "https://mail.example/r?to=https://jobs.lever.co/Co{n}",
    "https://www.co{n}.com/careers", "jobs.lever.co/Co{n}",
)


def board_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    said = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (n % len(SHAPES) + 1).cast("int"))
    for mark, value in (("{u}", F.coalesce("url", F.lit(""))), ("{n}", n.cast("string")), ("{z}", F.lpad(n.cast("string"), 8, "0"))):
        said = F.replace(said, F.lit(mark), value)
    return table(spark, sf_dir, "pages").select("page_id", said.alias("url"))


def q_x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = board_addresses(spark, sf_dir).select("page_id", platform(F.col("url")).alias("p")).filter("p is not null")
    return found.select("page_id", "p.platform", "p.slug", "p.specificity", "p.shape_only")


QUERIES = {"X18_platforms": q_x18}
_QUOTED = ", ".join(f"'{s}'" for s in SHAPES)
ORACLES = {
    # Not by the patterns: the last address in each text is cut into host, folders and parameters, which are compared one by one.
    "X18_platforms": rf"""with a as (select page_id, replace(replace(replace([{_QUOTED}][(page_id % {len(SHAPES)} + 1)::int], '{{u}}', coalesce(url, '')), '{{n}}', page_id::varchar), '{{z}}', lpad(page_id::varchar, 8, '0')) as url from pages),
b as (select *, regexp_extract(url, '^(?:.*[^a-z])?(https?://.*)$', 1, 'i') as u from a),
c as (select *, regexp_extract(u, '^[a-zA-Z]+://([^/?#]*)', 1) as raw, string_split(regexp_extract(u, '^[a-zA-Z]+://[^/?#]*/?([^?#]*)', 1), '/') as s, regexp_extract(u, '[?]([^#]*)', 1) as q from b),
d as (select *, lower(raw) as h, string_split(lower(raw), '.') as l, map_from_entries([(split_part(x, '=', 1), split_part(x, '=', 2)) for x in string_split(q, '&')]) as m from c),
e as (select page_id, case
  when h = 'api.lever.co' and s[1] = 'v0' and s[2] = 'postings' then {{'p': 'lever', 's': s[3], 'k': 10}}
  when h = 'boards-api.greenhouse.io' then {{'p': 'greenhouse', 's': s[3], 'k': 10}}
  when h = 'api.smartrecruiters.com' then {{'p': 'smartrecruiters', 's': s[3], 'k': 10}}
  when l[-2] = 'myworkdayjobs' and s[1] = 'wday' then if(s[2] = 'cxs', {{'p': 'workday', 's': array_to_string(string_split(raw, '.')[:-3], '.') || '/' || s[4], 'k': 10}}, null)
  when l[-2] = 'myworkdayjobs' then {{'p': 'workday', 's': array_to_string(string_split(raw, '.')[:-3], '.') || '/' || if(s[1] = 'en-US', s[2], s[1]), 'k': 5}}
  when h = 'jobs.lever.co' then {{'p': 'lever', 's': s[1], 'k': 5}}
  when h in ('boards.greenhouse.io', 'job-boards.greenhouse.io') then {{'p': 'greenhouse', 's': s[1], 'k': 5}}
  when raw = 'jobs.ashbyhq.com' then {{'p': 'ashby', 's': s[1], 'k': 5}}
  when h in ('jobs.smartrecruiters.com', 'careers.smartrecruiters.com') then {{'p': 'smartrecruiters', 's': s[1], 'k': 5}}
  when len(l) = 3 and l[2] in ('recruitee', 'pinpointhq', 'bamboohr', 'teamtailor') and l[3] = 'com' then {{'p': replace(l[2], 'pinpointhq', 'pinpoint'), 's': l[1], 'k': 5}}
  when len(l) = 3 and l[2] = 'applytojob' then {{'p': 'jazzhr', 's': l[1], 'k': 5}}
  when len(l) = 3 and l[2] = 'breezy' and l[3] = 'hr' then {{'p': 'breezy', 's': l[1], 'k': 5}}
  when len(l) = 4 and l[2] = 'jobs' and l[3] = 'personio' then {{'p': 'personio', 's': l[1], 'k': 5}}
  when h = 'apply.workable.com' then {{'p': 'workable', 's': lower(s[1]), 'k': 5}}
  when h = 'jobs.jobvite.com' then {{'p': 'jobvite', 's': lower(s[1]), 'k': 5}}
  when ends_with(h, 'recruiting.paylocity.com') and lower(s[3]) = 'all' then {{'p': 'paylocity', 's': s[4], 'k': 5}}
  when h = 'ats.rippling.com' then {{'p': 'rippling', 's': lower(s[1]), 'k': 5}}
  when starts_with(h, 'recruiting') and l[-2] = 'ultipro' then {{'p': 'ultipro', 's': h || '/' || s[1] || '/' || lower(s[3]), 'k': 5}}
  when l[2] = 'fa' and l[-2] = 'oraclecloud' then {{'p': 'oracle_cloud', 's': h || '|' || coalesce(s[list_position(s, 'sites') + 1], 'CX_1'), 'k': 5}}
  when l[-2] = 'icims' then {{'p': 'icims', 's': regexp_extract(l[1], '^(?:careers|jobs)-(.*)$', 1), 'k': 5}}
  when h in ('sapsfdemojobs.com', 'jobs.hr.cloud.sap.com') then null
  when l[1] in ('careers', 'jobs') then {{'p': 'phenom', 's': h, 'k': 5}}
  when l[-2] = 'successfactors' then {{'p': 'successfactors', 's': h || '|' || m['company'], 'k': 5}}
  when h = 'workforcenow.adp.com' then {{'p': 'adp', 's': lower(m['cid']), 'k': 5}} end as e from d where u <> '')
select page_id, e.p as platform, e.s as slug, e.k as specificity, e.p = 'phenom' as shape_only from e where e is not null""",
}
