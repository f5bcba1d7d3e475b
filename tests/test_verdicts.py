"""The content verdict on pinned texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators.verdicts import EMPTY_DEMANDS, with_verdict

LONG = "The clerk keeps the books of the harbour and answers letters from captains. " * 10
BODY = f"About the role: the clerk at Acme Harbours.\n## Responsibilities\n{LONG}"


@pytest.mark.parametrize("title, company, text, want", [
    ("Harbour Clerk", "Acme Harbours", BODY, ("CLEAN", "shape+grounded")),
    ("Harbour Clerk", None, BODY, ("CLEAN", "shape+grounded")),
    (None, "Acme Harbours", BODY, ("CLEAN", "shape+grounded")),
    ("Harbour Clerk", "Zenith Foods", BODY, ("AMBIGUOUS", "company_absent")),
    ("Harbour Clerk", "AT&T", BODY, ("AMBIGUOUS", "company_absent")),
    ("Harbour Clerk", "AT&T", BODY + " for AT&T", ("CLEAN", "shape+grounded")),
    ("Harbour Clerk", "The Corporate Group", BODY, ("CLEAN", "shape+grounded")),
    ("Harbour Clerk", "Acme", LONG, ("AMBIGUOUS", "needs_adjudication")),
    ("Harbour Clerk", "Acme", BODY[:300], ("AMBIGUOUS", "needs_adjudication")),
    ("Harbour Clerk", "Acme", BODY + "\n## Skills\n\n", ("AMBIGUOUS", "empty_requirements_header")),
    ("Harbour Clerk", "Acme", BODY + " with 50,048 results", ("AMBIGUOUS", "listing_index")),
    ("What is a Harbour Clerk", "Acme", BODY + " The national average is high", ("AMBIGUOUS", "career_explainer_seo")),
    ("Harbour Clerk", "Acme", BODY + " The national average is high", ("CLEAN", "shape+grounded")),
    ("Harbour Clerk", "Acme", '# Harbour\n{"theme": "' + "x" * 300 + '"}', ("AMBIGUOUS", "json_config_blob_unanchored")),
    ("Harbour Clerk", "Acme", '# Harbour\n{"job_description": "' + "x" * 300 + '"}', ("AMBIGUOUS", "needs_adjudication")),
    ("Harbour Clerk", "Acme", '{"theme": "' + "x" * 300 + '"}', ("REJECT", "config_blob")),
    ("Harbour Clerk", "Acme", "short", ("REJECT", "truncated")),
    ("Harbour Clerk", "Acme", "", ("AMBIGUOUS", "empty")),
    (None, None, None, ("AMBIGUOUS", "empty")),
])
def test_content_verdict(spark, title, company, text, want):
    df = spark.createDataFrame([(title, company, text)], "title string, company string, text string")
    assert tuple(with_verdict(df).select("verdict", "why").first()) == want


@pytest.mark.parametrize("text, hollow", [
    ("## Requirements\n## Benefits\nx", True), ("## Requirements\n\n \n# Benefits\nx", True), ("## Requirements\n### Minimum\nx", False), ("### Skills\n## Other\nx", True), ("# Skills\nx\n## Duties", True),
    ("## Company\n## Other", False), ("## Skills, Knowledge ##\n\nRead", False), ("####### Skills\n", False), ("Skills\n## Other", False), ("##Skills\n## Other", False), ("a ## Skills\n## Other", False),
])
def test_empty_demands(spark, text, hollow):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(EMPTY_DEMANDS).alias("h")).first().h is hollow
