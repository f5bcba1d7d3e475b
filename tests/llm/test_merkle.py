"""The Merkle manifest against a plain tree, its layout against a recursive one, its SQL, and edge rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import awkward, words
from pyspark.sql import functions as F

from millrace.llm import merkle

TURNED = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def laid_out(nodes: list[list]) -> list:
    """The layout by its definition: nodes by level, leaves first; the upper subtree, then the lower ones."""
    if len(nodes) == 1:
        return list(nodes[0])
    low = len(nodes) // 2
    out = laid_out(nodes[low:])
    for j in range(len(nodes[low - 1])):
        out += laid_out([level[j * 8 ** (low - 1 - k) : (j + 1) * 8 ** (low - 1 - k)] for k, level in enumerate(nodes[:low])])
    return out


@pytest.mark.parametrize(("n", "levels"), [(n, levels) for levels in range(1, 6) for n in (1, 2, 8, 9, 63, 64, 65, 511, 512, 600, 4096) if n <= 8 ** (levels - 1)])
def test_addresses(n, levels):
    sizes = [int(c) for c in merkle.counts(np.int64(n), levels, 8)]
    want = laid_out([[(level, i) for i in range(size)] for level, size in enumerate(sizes)])
    got = {}
    for level, size in enumerate(sizes):
        got |= {int(a): (level, i) for i, a in enumerate(merkle.address(n, levels, level, np.arange(size)))}
    assert [got[i] for i in range(len(want))] == want


def by_force(docs, turned):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, low: h(*[field(v.translate({c: c + 32 for c in range(65, 91)}) if low and k == 4 and v is not None else v) for k, v in enumerate(d)])

    def tree(row):
        levels = [row]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        out = []
        for row in levels[:-1]:
            run = at - at % 8
            out.append(("".join(row[run:at]), "".join(row[at + 1 : run + 8])))
            at //= 8
        return out

    groups: dict = {}
    for d in docs:
        groups.setdefault(d[2], []).append((leaf(d, False), leaf(d, turned(d)), d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[2][0] is not None, x[2][0] or 0, x[0], x[1]))
        trees[g] = tree([x[0] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        for i, (first, shown, d) in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            now = shown
            for a, b in steps:
                now = h(a, now, b)
            out[d[0], first, trees[g][-1][0], top[-1][0], h(*[x for s in steps for x in s]), now, now == top[-1][0]] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def plain(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]


def turned(d):
    return d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0


def test_query_as_its_sql_and_by_force(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    got = found(merkle.op11_merkle_manifest(spark, folder))
    assert got == Counter(con.sql(merkle.SQL["op11_merkle_manifest"]).fetchall())
    assert got == by_force(plain(spark.read.parquet(f"{folder}/documents.parquet")), turned)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("height", [1, 2, 3])
def test_several_layers_of_blocks(spark, height):
    """One hot language of 700 rows, one of a single row, forty small ones: layers of blocks in both trees."""
    rng = random.Random(height)
    docs = [(i, "s", "hot" if i < 700 else "one" if i == 700 else f"l{i % 40}", 3, words(rng, 3).title()) for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    manifest = merkle.Manifest(merkle.leaves_of(df, TURNED()), height)
    assert found(manifest.proofs()) == by_force(docs, turned)
    assert manifest.blocks().filter("layer > 0").count() > 0 or height == 3
    nodes = manifest.blocks().agg(F.sum(F.octet_length("nodes"))).first()[0] / 32
    assert nodes < 1.35 * 1000  # a node is stored once, and as a leaf of the next layer where it is a block's root


def test_edges(spark):
    docs = awkward(spark, [(None, "No Id", None, None), (None, "No Id", None, None), (6, "Other", "en", "a"), (-5, "ÀÉ A", "ßz", "c"), (3_000_000_000, "X" * 200_000, "en", "a"), (21, "A", "", "a")])
    assert found(merkle.verified_manifest(docs, TURNED())) == by_force(plain(docs), turned)
    assert found(merkle.verified_manifest(docs)) == by_force(plain(docs), lambda d: False)
    assert merkle.verified_manifest(docs.limit(0), TURNED()).count() == 0
    one = docs.filter("doc_id = 12")
    assert found(merkle.verified_manifest(one)) == by_force(plain(one), lambda d: False)
