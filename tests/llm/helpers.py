"""Awkward rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, k int, r string, slab string, node int, _split string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def awkward(spark, extra: list[tuple] = ()):
    rng = random.Random(5)
    long, base = words(rng, 4000), words(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "  \n\t ", "en", None), (5, long, "de", "b"), (6, base, "en", "a"), (6, base, "en", "a"),
        (7, " ".join(near), "en", "c"), (8, "one two", "en", "a"), (9, "ONE two", "fr", "a"), (10, "Ünï©ode ▁ \u0000   x y 😀 " + base, "en", "b"),
        (11, long + " tail", "de", "b"), (12, "the " * 300, "en", "a"), (13, base.replace(" ", "\n"), "en", "a"), (14, words(rng, 300), "en", "c"), *extra,
    ]
    return spark.createDataFrame([(*r, 0, "x", 1, "y", "z", 2, "w") for r in rows], KIND)
