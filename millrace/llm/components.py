"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.common import cut, split_join


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): each v with the smallest of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return split_join(pairs, least, ["u"], "inner")


def _settled(pairs: DataFrame) -> tuple[DataFrame, dict]:
    """The pairs, checkpointed, and a count and checksum of them that the same job observes."""
    seen = Observation()
    out = cut(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")))
    return out, seen.get


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    A round costs two grouped minima, joined back with a split of hot nodes. Rounds end when nothing changes,
    after about the logarithm of the longest path. Each round is checkpointed, so lineage stays short and a
    lost executor costs no earlier round. No node's partners are ever gathered in one row.
    """
    now, state = _settled(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _star(large)
        parents = small.select(F.col("u").alias("u"), F.col("m").alias("v"))
        before = state
        now, state = _settled(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(parents).filter("u <> v").distinct())
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
