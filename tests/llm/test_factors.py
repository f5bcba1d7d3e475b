"""Longest previous factors against a quadratic search."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.llm.suffix_dedup import as_words, longest_previous_factors, smaller


def by_force(strings: list[bytes], docs: list[int]) -> list[int]:
    def common(a: bytes, b: bytes) -> int:
        return next((k for k in range(len(a)) if a[k] != b[k]), len(a))

    return [max((common(s, t) for t, e in zip(strings, docs, strict=True) if e < d), default=0) for s, d in zip(strings, docs, strict=True)]


@pytest.mark.parametrize("length, letters, n", [(50, 2, 300), (50, 1, 120), (13, 3, 200), (8, 2, 64), (17, 2, 1), (17, 2, 2), (17, 2, 0)])
def test_factors(length, letters, n):
    rng = np.random.default_rng(length * n)
    for _ in range(5):
        text = rng.integers(97, 97 + letters, n + length, dtype=np.uint8)
        text[rng.integers(0, n + length, 3)] = 200
        starts = np.arange(n)
        docs = rng.integers(-3, 5, n) * 10**12
        got = longest_previous_factors(as_words(text, starts, length), docs, length)
        want = by_force([text[k : k + length].tobytes() for k in starts], docs.tolist())
        assert got.tolist() == want
        for least in (3, length):
            few = longest_previous_factors(as_words(text, starts, length), docs, length, least)
            assert [f if f >= least else 0 for f in few.tolist()] == [w if w >= least else 0 for w in want]


def test_previous_smaller_values():
    rng = np.random.default_rng(4)
    docs, lcp = rng.integers(0, 6, 200).astype(np.int32), np.r_[0, rng.integers(0, 9, 199), 0].astype(np.uint16)
    want = []
    for i in range(200):
        j = next((j for j in range(i - 1, -1, -1) if docs[j] < docs[i]), None)
        want.append(0 if j is None else int(lcp[j + 1 : i + 1].min()))
    assert smaller(docs, lcp).tolist() == want
