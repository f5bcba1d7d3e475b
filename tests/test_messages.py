"""Mail as it comes: parts, encodings, senders, and the lines around addresses."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.sources.messages import WINDOW, label_of, postings, read_messages

MIXED = b"""From: X <a@b.c>
Date: Mon, 1 Jan 2024 00:30:00 +0100
Content-Type: multipart/alternative; boundary=q

--q
Content-Type: text/plain; charset=iso-8859-1
Content-Transfer-Encoding: quoted-printable

caf=E9 a long=
er line
--q
Content-Type: text/html

<p>other</p>
--q--
"""
ATTACHED = b"From: a@b.c\nContent-Type: text/plain\nContent-Disposition: attachment\n\nhidden\n"
CHARSET = b"From: a@b.c\nContent-Type: text/plain; charset=no-such\n\nbody\n"


def test_read_messages(spark):
    raws = [MIXED, ATTACHED, b"From: q@r.s\n\nplain \xff text\n", b"", None, CHARSET, b"Date: nonsense\n\nno sender\n"]
    df = spark.createDataFrame([(i, r, "kept") for i, r in enumerate(raws)], "id int, raw binary, sender_name string")
    got = {r.id: (r.sender, r.body, r.sent, r.error, r.sender_name) for r in read_messages(df).collect()}
    assert got[0] == ("a@b.c", "caf\u00e9 a longer line", datetime(2023, 12, 31, 23, 30), None, "kept")
    assert got[1][:2] == ("a@b.c", None) and got[2][:2] == ("q@r.s", "plain  text\n")
    assert got[3][:4] == ("", None, None, None) == got[4][:4]
    assert got[5][1] is None and got[6][:3] == ("", "no sender\n", None)
    assert read_messages(df.limit(0)).count() == 0


def test_labels(spark):
    cases = {"JobAlerts-NoReply@linkedin.com": "linkedin", "noreply@jobright.ai": "jobright", "donotreply@match.indeed.com": "indeed_match", "x@y.z": None, "": None, None: None}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.m for r in df.select("c", label_of(F.col("c")).alias("m")).collect()} == cases


def found(spark, body):
    read = spark.createDataFrame([(1, "hello@trueup.io", body, None)], "id int, sender string, body string, sent timestamp_ntz")
    return sorted((r.url, r.title, r.company) for r in postings(read, ["id"]).collect())


def test_lines_around_addresses(spark):
    one, two = "https://jobs.lever.co/a/1", "https://careers.acme.myworkdayjobs.com/x/2"
    assert found(spark, f"Engineer\n\n({one})\n\n Acme \n") == [(one, "Engineer", "Acme")]
    assert found(spark, f"Engineer\nunknown\nClick here\n{one}.\n(remote)\nNA\nAcme") == [(one, "Engineer", "Acme")]
    assert found(spark, f"Engineer\n{one}\nAcme\n{two}\nBolt\n{one}\nLast") == [(two, "Acme", "Bolt"), (one, "Engineer", "Acme")]
    assert found(spark, f"Cook at {one} or {two} now") == [(two, f"Cook at {one} or", "now"), (one, "Cook at", f"or {two} now")]
    assert found(spark, f"{one}\nAcme") == [] == found(spark, f"Engineer\n{one}")
    assert found(spark, "Engineer\nhttps://example.com/1\nAcme") == [] == found(spark, "") == found(spark, None)
    assert found(spark, f"HTTPS://JOBS.LEVER.CO/a/1\n{'x' * 151}\nCook\n{two}\nBolt")[0] == (two, "Cook", "Bolt")


def test_only_ten_lines_count(spark):
    url = "https://jobs.ashbyhq.com/a/1"
    fill = lambda n: "\n".join(["ab"] * n)
    assert found(spark, f"Engineer\n{fill(WINDOW - 1)}\n{url}\n{fill(WINDOW - 1)}\nAcme") == [(url, "Engineer", "Acme")]
    assert found(spark, f"Engineer\n{fill(WINDOW)}\n{url}\nAcme") == [] == found(spark, f"Engineer\n{url}\n{fill(WINDOW)}\nAcme")
    assert found(spark, f"Engineer\n{fill(WINDOW - 1)}\n- {url}\nAcme") == []


def test_a_long_body_of_many_addresses(spark):
    body = "\n".join(f"Role {i}\nhttps://jobs.lever.co/a/{i}\nFirm {i}" for i in range(3000))
    assert len(found(spark, body)) == 3000
