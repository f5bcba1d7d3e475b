"""J15's clusters against union-find, components on long paths and hot nodes, C17's verdicts on pinned cohorts."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from test_similar_titles import common

from millrace.operators.clusters import affine, cohort_verdicts, connected, title_clusters
from millrace.plans.bounds import placed


def united(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def normal(title):
    return " ".join("".join(x if x.isascii() and x.isalnum() else " " for x in (title or "").lower()).split())


@pytest.mark.parametrize("seed", range(3))
def test_clusters_by_union_find(spark, seed):
    rng = random.Random(seed)
    words = "senior staff data platform engineer manager ii iii sales remote 1 2 7".split()
    rows = [(rng.choice(["a", "b", None]), " ".join(rng.choices(words, k=rng.randint(1, 6)))) for _ in range(90)] + [("a", None), ("a", "!!"), ("b", "Engineer, DATA!"), ("b", "engineer data")]
    want = set()
    for cohort in ("a", "b", None):
        titles = sorted({normal(t) for c, t in rows if c == cohort} - {""})
        near = [(a, b) for a, b in combinations(titles, 2) if common(a.split(), b.split()) / max(len(a.split()), len(b.split())) >= 0.7]
        want |= {(cohort, t, c) for t, c in united(titles, near).items()}
    got = {(r.cohort, r.title, r.cluster) for r in title_clusters(spark.createDataFrame(rows, "cohort string, title string")).collect()}
    assert got >= {w for w in want if w[0] is not None} and {g for g in got if g[0] is not None} == {w for w in want if w[0] is not None}
    assert {g[1] for g in got if g[0] is None} == {w[1] for w in want if w[0] is None}


def test_long_path_and_hot_node(spark):
    path = [("p", f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)]
    star = [("s", "hub", f"x{i}") for i in range(500)] + [("s", "x7", "a")]
    got = {(r.cohort, r.node): r.least for r in connected(spark.createDataFrame(path + star, "cohort string, u string, v string")).collect()}
    assert {v for k, v in got.items() if k[0] == "p"} == {"n000"} and {v for k, v in got.items() if k[0] == "s"} == {"a"} and len(got) == 201 + 502


def test_affinity(spark):
    cases = [("Cigna Health", "cigna.wd5/cignacareers", True), ("Home Depot", "careers.homedepot.com", True), ("Gong.IO", "gongio", True), ("Next Frontier Capital", "aumni", False), ("Acme", "3f9c77d1", False), (None, "acme", False), ("Jobs Inc", "jobs", False)]
    got = spark.createDataFrame(cases, "a string, b string, want boolean").select(affine(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def cohort(name, company, n, title=lambda i: f"role {chr(97 + i)}{i} {chr(98 + i)}", url=lambda i: f"https://x.example/{i}", org=lambda i: None, place=lambda i: "Oslo"):
    return [(name, company, i, title(i), url(i), org(i), place(i)) for i in range(n)]


def test_verdicts(spark):
    rows = cohort("template", "Acme", 5, title=lambda i: f"Cook at Zeta {i // 4}") + cohort("slug", "Next Frontier", 3, url=lambda i: f"https://b.example/companies/{'aumni' if i else 'x'}/j/{i}") + cohort("own", "Aumni", 3, url=lambda i: f"https://b.example/companies/Aumni/j/{i}")
    rows += cohort("many", "Acme", 20, org=lambda i: f"Employer{i % 3}") + cohort("one", "Acme", 20, org=lambda i: "Zeta") + cohort("small", "Acme", 9, org=lambda i: f"Employer{i}") + cohort("nav", "Acme", 20, place=lambda i: "Popular Jobs") + cohort("fine", "Acme", 20, org=lambda i: "ACME Corp")
    rows += cohort("nameless", None, 12, org=lambda i: f"E{i}") + cohort("once", "Acme", 80, org=lambda i: "Zeta" if i == 10 else None) + cohort("unseen", "Acme", 80, org=lambda i: "Zeta" if i % 10 else None) + cohort("blank", "Acme", 2, title=lambda i: "...")
    df = spark.createDataFrame(rows, "cohort string, company string, at long, title string, url string, org string, place string")
    got = {r.cohort: (r.reason, r.positive) for r in cohort_verdicts(df).collect()}
    assert got == {
        "template": ("title_template", 5), "slug": ("portfolio_path", 2), "own": (None, 0), "many": ("distinct_employers", 3), "one": ("other_employer", 8), "small": (None, 0), "nav": ("place_furniture", 8), "fine": (None, 0), "nameless": (None, 0), "once": (None, 0), "unseen": (None, 0), "blank": (None, 0),
    }


def test_places_of_a_hot_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.xxhash64("id").alias("o"))
    got = placed(rows, ["k"], [F.col("o")], 16).toPandas()
    assert len(got) == 5000
    for _, part in got.groupby("k", dropna=False):
        part = part.sort_values("o")
        assert list(part["place"]) == list(range(len(part))) and set(part["of"]) == {len(part)}
