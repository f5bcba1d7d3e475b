"""Alert messages: raw mail to senders, bodies and dates, then to postings by the lines around their addresses."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rules import ladder
from millrace.plans.projections import table
from millrace.session import ship

# Senders and their labels; the first that a From address holds decides.
SENDERS = (
    ("jobalerts-noreply@linkedin.com", "linkedin"), ("jobs-noreply@linkedin.com", "linkedin"), ("noreply@glassdoor.com", "glassdoor"), ("alert@indeed.com", "indeed"), ("donotreply@match.indeed.com", "indeed_match"),
    ("no-reply@ziprecruiter.com", "ziprecruiter"), ("no-reply@us.greenhouse-jobs.com", "greenhouse"), ("hello@trueup.io", "trueup"), ("monster@notifications.monster.com", "monster"), ("noreply@jobright.ai", "jobright"),
)
# Addresses of single postings, by hosts that may stand below others and by whole hosts; words of lines that are neither titles nor companies.
BELOW = ("linkedin.com/jobs/view/", "ziprecruiter.com/jobs/", "ziprecruiter.com/apply/", "ziprecruiter.com/job/", "glassdoor.com/partner/jobListing")
WHOLE = ("job-boards.greenhouse.io/", "jobs.lever.co/", "jobs.ashbyhq.com/")
SKIPPED = (
    "here's your", "weekly update", "new roles", "good fit", "apply early", "stand out", "unsubscribe", "view in browser", "copyright", "privacy policy", "terms of service", "email preferences", "manage your", "you received",
    "you're receiving", "click here",
)
PLACEHOLDERS = ("title", "body", "unknown", "name", "company", "location", "n/a", "none")
SHORTEST, LONGEST, WINDOW = 3, 150, 10
_ADDRESS = "(?iU)https?://(?:" + "|".join(
    [r"\S*" + re.escape(x) + r"\S*" for x in BELOW] + [re.escape(x) + r"\S+" for x in WHOLE] + [r"\S*indeed\.com/\S*[?&]jk=\S*", r"\S*ziprecruiter\.com/c/[^/\s]+/Job/\S*", r"\S*myworkdayjobs\.com/\S+"]
) + ")"
_BLANKS = " \t\r\f\x0b\xa0"
_READ = pa.schema([("sender", pa.string()), ("body", pa.string()), ("sent", pa.timestamp("us")), ("error", pa.string())])


def _read(raw: bytes | None) -> dict:
    """One message: the address in From, the first text or HTML part that isn't attached, and the date in UTC."""
    try:
        message = email.message_from_bytes(raw or b"", policy=email.policy.default)
        said, body = str(message.get("From", "")), None
        bracketed = re.search(r"<([^>]*)>", said)
        for part in message.walk():
            if body or part.get_content_type() not in ("text/plain", "text/html") or "attachment" in str(part.get("Content-Disposition", "")):
                continue
            payload = part.get_payload(decode=True)
            try:
                body = payload.decode(part.get_content_charset() or "utf-8", errors="ignore") if payload else None
            except LookupError:
                continue
        return {"sender": (bracketed[1] if bracketed else said).strip(), "body": body, "sent": _sent(message), "error": None}
    except Exception as e:  # noqa: BLE001  a message that can't be read is told apart, its batch goes on
        return {"sender": None, "body": None, "sent": None, "error": type(e).__name__}


def _sent(message) -> datetime | None:
    try:
        return parsedate_to_datetime(str(message["Date"])).astimezone(UTC).replace(tzinfo=None)
    except (TypeError, ValueError, OverflowError):
        return None


def read_messages(messages: DataFrame, raw: str = "raw") -> DataFrame:
    """Messages with sender, body, sent and error for their raw bytes; other columns stay. MIME is read in Arrow batches, one
    message at a time. Null or empty bytes give an empty sender and no body; an unreadable message gives its error."""
    ship(messages.sparkSession)
    kept = [c for c in messages.columns if c != raw]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = pa.RecordBatch.from_pylist([_read(x.as_py()) for x in batch.column(raw)], schema=_READ)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *read.columns], [*kept, *_READ.names])

    types = {f.name: f.dataType for f in messages.schema.fields}
    return messages.select(*kept, raw).mapInArrow(run, ", ".join([*(f"`{c}` {types[c].simpleString()}" for c in kept), "sender string, body string, sent timestamp_ntz, error string"]))


def label_of(sender: Column) -> Column:
    """The label of the first known address in a sender; null for others."""
    return ladder([(F.contains(F.lower(sender), F.lit(address)), label) for address, label in SENDERS])


def _says_something(line: Column) -> Column:
    """Whether a trimmed line may be a title or a company."""
    low = F.lower(line)
    wrapped = line.startswith("http") | (line.startswith("(") & F.contains(line, F.lit("http")))
    return F.char_length(line).between(SHORTEST, LONGEST) & ~wrapped & ~low.rlike("|".join(re.escape(w) for w in SKIPPED)) & ~low.isin(*PLACEHOLDERS)


def postings(read: DataFrame, key: list[str]) -> DataFrame:
    """Postings of read messages: for each address of a posting the nearest line before it that may be a title and the nearest
    after it that may be a company, within ten lines of text; the first place of an address in a message counts, and one without
    title or company gives nothing. Columns: key, label, sent, url, title, company.

    Each address takes its own few lines along, so a long body is never repeated.
    """
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    rows = read.withColumn("label", label_of(F.col("sender"))).filter("label is not null and body is not null").withColumn("lines", lines)

    def around(line: Column, i: Column) -> Column:
        before = F.when(i > 0, F.slice("lines", F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i, F.lit(WINDOW)))).otherwise(F.array().cast("array<string>"))
        return F.struct(i.alias("i"), F.regexp_extract_all(line, F.lit(_ADDRESS), F.lit(0)).alias("urls"), F.split(line, _ADDRESS).alias("gaps"), before.alias("before"), F.slice("lines", i + 2, WINDOW).alias("after"))

    near = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(_ADDRESS), around(line, i))), lambda x: x.isNotNull())
    places = rows.select(*key, "label", "sent", F.explode(near).alias("x")).select(*key, "label", "sent", "x.*")
    one = places.select(*key, "label", "sent", "i", "gaps", "urls", "before", "after", F.posexplode("urls").alias("j", "found"))

    j, n = F.col("j"), F.size("urls")
    woven = lambda lead, follow: F.array_join(F.flatten(F.transform(F.arrays_zip(lead.alias("a"), follow.alias("b")), lambda z: F.array(F.coalesce(z["a"], F.lit("")), F.coalesce(z["b"], F.lit(""))))), "")
    left = woven(F.slice("gaps", F.lit(1), j + 1), F.slice("urls", F.lit(1), j))
    right = woven(F.slice("gaps", j + 2, n - j), F.slice("urls", j + 2, n - j))
    own = lambda c: F.filter(F.array(F.btrim(c, F.lit(_BLANKS))), lambda x: x != "")
    last = lambda a: F.when(F.size(a) > WINDOW, F.slice(a, -WINDOW, WINDOW)).otherwise(a)
    title = F.get(F.reverse(F.filter(last(F.concat("before", own(left))), _says_something)), F.lit(0))
    company = F.get(F.filter(F.slice(F.concat(own(right), "after"), 1, WINDOW), lambda x: _says_something(x) & ~x.startswith(")") & ~x.startswith("(")), F.lit(0))
    url = F.regexp_replace("found", r"""[.,;)\]>"']+$""", "")
    said = one.select(*key, "label", "sent", url.alias("url"), F.struct("i", "j", title.alias("title"), company.alias("company")).alias("s"))
    first = said.groupBy(*key, "label", "sent", "url").agg(F.min("s").alias("s")).filter("s.title is not null and s.company is not null")
    return first.select(*key, "label", "sent", "url", "s.title", "s.company")


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as raw alert mail of five builds: plain with a folded header, base64 behind an attachment, HTML, without a
    sender, and from an unknown one. A body is the turn's text, a posting with a title of its own, one without, and the first again."""
    n = F.col("conv_id") * 100 + F.col("turn")
    nth = n.cast("string")
    first = F.concat(F.lit("https://jobs.lever.co/acme/"), nth)
    body = F.concat(
        F.coalesce("text", F.lit("")), F.lit("\n\nEngineer "), nth, F.lit("\n( "), first, F.lit(" )\n\n  Firm "), nth, F.lit(" \nhttps://www.linkedin.com/jobs/view/"), nth, F.lit("/?trk=x.\nUnsubscribe here\nBranch "),
        F.col("turn").cast("string"), F.lit("\nsee "), first, F.lit(", or https://de.indeed.com/viewjob?a=1&jk="), nth, F.lit(" today\nIt is by Outfit "), nth, F.lit("\n"),
    )
    head = F.lit("Date: Tue, 02 Jan 2024 23:30:00 -0200\nSubject: digest\nMIME-Version: 1.0\n")
    plain = F.concat(F.lit("From: Alerts\n <JobAlerts-noreply@LinkedIn.com>\n"), head, F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), body)
    mixed = F.concat(
        F.lit("From: alert@indeed.com\n"), head, F.lit('Content-Type: multipart/mixed; boundary="b1"\n\n--b1\nContent-Type: text/plain\nContent-Disposition: attachment; filename="a.txt"\n\nnothing\nhttps://jobs.lever.co/no/1\nof it\n'),
        F.lit("--b1\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode(body, "UTF-8")), F.lit("\n--b1--\n"),
    )
    rich = F.concat(F.lit("From: =?utf-8?q?True=20up?= <hello@trueup.io>\n"), head, F.lit("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"), body)
    other = F.concat(F.lit("From: someone@mail.example\n"), head, F.lit("\n"), body)
    raw = F.element_at(F.array(plain, mixed, rich, F.concat(head, F.lit("\n"), body), other), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode(raw, "UTF-8").alias("raw"))


def q_s04_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(read_messages(mails(spark, sf_dir)), ["conv_id", "turn"])


QUERIES = {"S04_alert_batch": q_s04_batch}
ORACLES = {
    # From what the mails were made of: what stands around their three addresses is known.
    "S04_alert_batch": """with a as (select conv_id, turn, conv_id * 100 + turn as n from conversations),
b as (select *, case n % 5 when 0 then 'linkedin' when 1 then 'indeed' else 'trueup' end as label, timestamp '2024-01-03 01:30:00' as sent from a where n % 5 < 3)
select conv_id, turn, label, sent, 'https://jobs.lever.co/acme/' || n as url, 'Engineer ' || n as title, 'Firm ' || n as company from b
union all select conv_id, turn, label, sent, 'https://www.linkedin.com/jobs/view/' || n || '/?trk=x', 'Firm ' || n, 'Branch ' || turn from b
union all select conv_id, turn, label, sent, 'https://de.indeed.com/viewjob?a=1&jk=' || n, 'see https://jobs.lever.co/acme/' || n || ', or', 'today' from b""",
}
