"""Counts before nouns, refusals, pay ranges and levels on single texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import names, pay
from millrace.functions.phrases import counted
from millrace.operators import content, rules, verdicts


def told(spark, expression, texts):
    return [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(expression(F.col("t")).alias("x")).collect()]


LISTS = {
    "1,200+ Data Scientist jobs in Oslo": True, "84 jobs in Bonn": True, "see (12 Sales & Marketing jobs  in Rome)": True, "x84 jobs in Bonn": False, "jobs in Bonn": False, "123456 jobs in Bonn": False, "7 jobs at Bonn": False, "": False, None: False,
    "3 " + "word " * 8 + "jobs in Bonn": True, "3 " + "word " * 9 + "jobs in Bonn": False, "3: jobs in Bonn": False, "no. 5 of 9 jobs in": True, "84 JOBS\nIN Bonn": True, "84 jobs inside": False,
}


def test_lists_of_jobs(spark):
    assert told(spark, lambda t: counted(t, content.JOBS_IN, content.JOBS_GAP), LISTS) == list(LISTS.values())
    assert told(spark, lambda t: counted(t, verdicts.RESULTS, 0), ["50,048 results", "12 good results", "12results", "results 12"]) == [True, False, False, False]


REFUSALS = {
    "I'd be happy to help": True, "Im not able to": True, "I cannot reformat this posting.": True, "As an AI": False, "No job description content was provided": True, "no job description text was provided": True, "unable to draft": True, "By clicking Apply, I understand": False,
    "You have shared a link": True, "Could you please provide the text": True, "More details are needed": True, "x" * 395 + " I need": False, "insufficient context": True, "I needed": False, "We cannot": False,
}


def test_refusals(spark):
    assert told(spark, rules.refuses, REFUSALS) == list(REFUSALS.values())


PAYS = {
    "$120K - $150K": (120e3, 150e3), "$42 - $51 an hour": (42.0, 51.0), "£60,000 - £80,000": (60e3, 80e3), "$1.5M - $2M": (1.5e6, 2e6), "starting at $120K": None, "C$5,000 to C$6,000 per month": (5e3, 6e3), "401k match, USD 90,000–USD 110,000": (90e3, 110e3), "$120 - $150": (120e3, 150e3), "": None, None: None,
    "from 3 or 4 to 5 years": (4e3, 5e3), "€50K~€60K": (50e3, 60e3), "$100 and $200": None, "120 k — 130 k": (120e3, 130e3),
}


def test_pay_ranges(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(PAYS)], "i int, t string")
    got = [None if r.o is None else (r.o.min_value, r.o.max_value) for r in pay.with_observed(rows, "o", "t", "p").orderBy("i").collect()]
    assert got == list(PAYS.values())


@pytest.mark.parametrize(("title", "bare"), [("Engineer (IC5)", "Engineer"), ("Engineer IC5", "Engineer"), ("Engineer L4", "Engineer"), ("Engineer - L4", "Engineer"), ("Engineer – Level 4", "Engineer"), ("Engineer Level 3", "Engineer"), ("Engineer Lvl. 3", "Engineer"), ("Engineer lvl3", "Engineer"), ("Engineer III", "Engineer"), ("Engineer VII", "Engineer"), ("Engineer V", "Engineer V"), ("Level Designer", "Level Designer"), ("HTML5", "HTML5"), ("Engineer 3", "Engineer 3")])
def test_levels(spark, title, bare):
    assert told(spark, lambda t: F.regexp_replace(t, names.level_at_end(), ""), [title]) == [bare]
