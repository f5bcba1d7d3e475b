"""Platforms by pinned addresses."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.platforms import platform

GUID = "0A1b2c3d-4e5f-6789-abcd-ef0123456789"
CASES = {
    "https://jobs.lever.co/NetFlix/123": ("lever", "NetFlix", 5, False),
    "https://api.lever.co/v0/postings/netflix?mode=json": ("lever", "netflix", 10, False),
    "https://boards.greenhouse.io/stripe/jobs/1": ("greenhouse", "stripe", 5, False),
    "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/External/jobs": ("workday", "acme.wd5/External", 10, False),
    "https://acme.wd5.myworkdayjobs.com/en-US/External/job/x": ("workday", "acme.wd5/External", 5, False),
    "https://acme.wd5.myworkdayjobs.com/wday/authgwy": None,
    "https://jobs.ashbyhq.com/OpenAI?x=1": ("ashby", "OpenAI", 5, False),
    "https://JOBS.ashbyhq.com/OpenAI": ("phenom", "jobs.ashbyhq.com", 5, True),
    "https://jobs.smartrecruiters.com/Visa": ("smartrecruiters", "Visa", 5, False),
    "https://Acme.applytojob.com/apply": ("jazzhr", "acme", 5, False),
    "https://acme.jobs.personio.com": ("personio", "acme", 5, False),
    f"https://recruiting2.ultipro.com/ABC1000/JobBoard/{GUID}/?q=": ("ultipro", f"recruiting2.ultipro.com/ABC1000/{GUID.lower()}", 5, False),
    f"https://recruiting.paylocity.com/recruiting/jobs/All/{GUID}/Acme": ("paylocity", GUID, 5, False),
    "https://eabc.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_45001/x": ("oracle_cloud", "eabc.fa.us2.oraclecloud.com|CX_45001", 5, False),
    "https://eabc.fa.us2.oraclecloud.com/x?siteNumber=CX_7": ("oracle_cloud", "eabc.fa.us2.oraclecloud.com|CX_7", 5, False),
    "https://eabc.fa.us2.oraclecloud.com/": ("oracle_cloud", "eabc.fa.us2.oraclecloud.com|CX_1", 5, False),
    "https://careers-acme.icims.com/jobs/1": ("icims", "acme", 5, False),
    "https://jobs.hr.cloud.sap.com/x": None,
    "https://careers.playstation.com/job": ("phenom", "careers.playstation.com", 5, True),
    "https://career10.successfactors.eu/career?career_ns=x&company=AcmeP&y=1": ("successfactors", "career10.successfactors.eu|AcmeP", 5, False),
    f"https://workforcenow.adp.com/x.html?a=1&cid={GUID}&b=2": ("adp", GUID.lower(), 5, False),
    "https://mail.example/click?to=https://jobs.lever.co/Acme": ("lever", "Acme", 5, False),
    "https://example.com/careers": None,
    "jobs.lever.co/acme": None,
    "": None,
    None: None,
}


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "u string")
    return {r.u: r.p for r in df.select("u", platform(F.col("u")).alias("p")).collect()}


@pytest.mark.parametrize("url", CASES, ids=str)
def test_platform(found, url):
    got = found[url]
    assert (None if got is None else tuple(got)) == CASES[url]
