"""J15 against every pair of a cohort's titles."""

from __future__ import annotations

from itertools import combinations

from millrace.operators.cohorts import similar_titles


def common(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(row[-1], before[j + 1]))
    return row[-1]


def test_pairs_by_force(spark):
    titles = {"a": ["red big ring 1", "red big ring 2", "big red ring 1", "red ring", "blue gear", "", "red big gear ring 1", "RED big ring 1!"], "b": ["red big ring 1", "x y z", "x y w", "x x y z"]}
    rows = spark.createDataFrame([(c, t) for c, ts in titles.items() for t in ts], "cohort string, title string")
    want = set()
    for c, ts in titles.items():
        words = {" ".join(w) for t in ts if (w := "".join(x if x.isalnum() else " " for x in t.lower()).split())}
        for p, q in combinations(sorted(words), 2):
            s = round(common(p.split(), q.split()) / max(len(p.split()), len(q.split())), 6)
            if s >= 0.7:
                want.add((c, p, q, s))
    got = {(r.cohort, r.title_a, r.title_b, r.similarity) for r in similar_titles(rows).collect()}
    assert got == want and want
