"""A Merkle manifest of a dataset in Van Emde Boas layout.

Leaves are numbered within their group (language) by a distributed sort. Aligned blocks of at most fanout**height leaves are built
apart, each one array of digests: the block's levels are split at half height, the upper subtree comes first, then the lower ones
from left to right, each split again in the same way. Where a node lies follows from its level and index alone, whatever the size of a cache line or page,
and the same arithmetic finds it in construction and when siblings are read for a proof. Block roots are the leaves of
the next layer's blocks until one node of a group is left; the groups' roots are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table
from millrace.session import ship

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS = "tree string, place long, n long, height int, root string, nodes binary"
#: A path is two texts for each level from the bottom: the hex digests of the siblings before and behind.
PATHS = "tree string, place long, path array<string>"


# --- the layout ---


def counts(n: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """How many nodes each of `levels` levels over n leaves has, leaves first."""
    out = [np.asarray(n, np.int64)]
    for _ in range(levels - 1):
        out.append(-(-out[-1] // fanout))
    return out


def address(n: np.ndarray | int, levels: int, level: np.ndarray | int, index: np.ndarray, fanout: int = 8) -> np.ndarray:
    """Where nodes (level, index) of trees of `levels` levels over n leaves lie; a tree may be cut short on its right."""
    index = np.asarray(index, np.int64)
    n, level = np.broadcast_to(np.asarray(n, np.int64), index.shape), np.broadcast_to(np.asarray(level, np.int64), index.shape)
    if levels == 1:
        return np.zeros(index.shape, np.int64)
    low = levels // 2
    out = np.empty(index.shape, np.int64)
    above = level >= low
    on_top = counts(n, low + 1, fanout)[low]
    if above.any():
        out[above] = address(on_top[above], levels - low, level[above] - low, index[above], fanout)
    if not above.all():
        n, level, index, on_top = n[~above], level[~above], index[~above], on_top[~above]
        below = fanout ** (low - 1 - level)  # nodes of this level in one whole lower subtree
        which = index // below
        leaves = fanout ** (low - 1)
        whole = (fanout**low - 1) // (fanout - 1)
        start = sum(counts(on_top, levels - low, fanout)) + which * whole
        out[~above] = start + address(np.minimum(leaves, n - which * leaves), low, level, index - which * below, fanout)
    return out


def height_of(n: int, fanout: int) -> int:
    """Levels above n leaves until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def built(leaves: list[str], height: int, fanout: int) -> tuple[str, bytes]:
    """Root and nodes of one block; digests are kept as 32 bytes each, in the layout's order."""
    n, level, row = len(leaves), 0, leaves
    nodes = np.zeros((sum(counts(n, height + 1, fanout)).item(), 32), np.uint8)
    while True:
        nodes[address(n, height + 1, level, np.arange(len(row)), fanout)] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        if level == height:
            return row[0], nodes.tobytes()
        row, level = [digest(row[i : i + fanout]) for i in range(0, len(row), fanout)], level + 1


def siblings(nodes: bytes, n: int, height: int, fanout: int) -> list[list[tuple[str, str]]]:
    """For each level below the root, for each node: its siblings' hex digests, those before and those behind it."""
    at, out = np.frombuffer(nodes, np.uint8).reshape(-1, 32), []
    for level, count in enumerate(counts(np.int64(n), height + 1, fanout)[:-1]):
        text = at[address(n, height + 1, level, np.arange(count), fanout)].tobytes().hex()
        runs = [text[i : i + 64 * fanout] for i in range(0, len(text), 64 * fanout)]
        out.append([(run[:i], run[i + 64 :]) for run in runs for i in range(0, len(run), 64)])
    return out


def folded(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for before, behind in zip(path[::2], path[1::2], strict=True):
        leaf = digest([before, leaf, behind])
    return leaf


# --- leaves ---


def lowered(text: Column) -> Column:
    """A-Z as a-z, nothing else; texts of one byte a character take the fast way to the same."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def leaf_of(fields: list[Column]) -> Column:
    """H of the fields: `-` for null, else the length in UTF-8 bytes, a colon and the value."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values]).cast("binary"), 256)


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, shown): the leaf, and the leaf as it shows itself where `tampered` holds, with its text in lower case; else null."""
    cols = {c: F.col(f"`{c}`").cast("long" if c in ("doc_id", "n_chars") else "string") for c in FIELDS}
    rows = docs.select(*[v.alias(c) for c, v in cols.items()], F.coalesce(tampered, F.lit(False)).alias("turned") if tampered is not None else F.lit(False).alias("turned"))
    rows = rows.withColumn("low", F.when(F.col("turned") & (lowered(F.col("text")) != F.col("text")), lowered(F.col("text"))))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))  # sorts null first, then by bytes
    shown = F.when(F.col("low").isNotNull(), leaf_of([F.col("low") if c == "text" else F.col(c) for c in FIELDS]))
    return rows.select(tree.alias("tree"), "doc_id", leaf_of([F.col(c) for c in FIELDS]).alias("leaf"), shown.alias("shown"))


# --- trees ---


def numbered(rows: DataFrame, order: list[Column], partitions: int) -> DataFrame:
    """The rows with their place among their tree's rows, from 0, and how many these are.

    Sorted by range over all trees, so a tree may span many partitions; only a count for each tree and partition it
    touches is summed up, and these are at most as many as there are trees and partitions.
    """
    laid = rows.repartitionByRange(partitions, "tree", *order).sortWithinPartitions("tree", *order)
    laid = cut(laid.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = laid.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by_part = Window.partitionBy("tree").orderBy("_part")
    offset = F.sum("_n").over(by_part) - F.col("_n") - F.col("_first")
    parts = cut(parts.select("tree", "_part", offset.alias("_offset"), F.sum("_n").over(Window.partitionBy("tree")).alias("n")))
    few = F.broadcast(parts) if parts.count() <= 100_000 else parts
    return laid.join(few, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def layers_of(leaves: DataFrame, height: int, fanout: int) -> list[DataFrame]:
    """BLOCKS of leaves (tree, place, n, leaf), layer by layer: each layer's leaves are the block roots of the one before."""
    size = fanout**height

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        tree, n = rows.column("tree")[0].as_py(), rows.column("n")[0].as_py()
        up = height if n > size else height_of(n, fanout)
        root, nodes = built(rows.column("leaf").to_pylist(), up, fanout)
        return pa.table({"tree": [tree], "place": [rows.column("place")[0].as_py() // size], "n": [-(-n // size)], "height": pa.array([up], pa.int32()), "root": [root], "nodes": pa.array([nodes], pa.binary())})

    layers = []
    while True:
        seen = Observation()
        groups = leaves.select("tree", "place", "n", "leaf").groupBy("tree", F.floor(F.col("place") / size).alias("block"))
        layer = cut(groups.applyInArrow(build, BLOCKS).observe(seen, F.count_if(F.col("n") > 1).alias("more")))
        layers.append(layer)
        if not seen.get.get("more"):
            return layers
        leaves = layer.filter("n > 1").select("tree", "place", "n", F.col("root").alias("leaf"))


def paths_of(layers: list[DataFrame], roots: DataFrame, fanout: int, height: int) -> tuple[DataFrame, DataFrame]:
    """PATHS from the first layer's block roots to the end of `roots` (tree, path), and the first layer's blocks."""
    size = fanout**height

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = siblings(row["nodes"], row["leaves"], row["height"], fanout)
                own = [[part for level, at in zip(levels, (i // fanout**k for k in range(len(levels))), strict=True) for part in level[at]] for i in range(row["leaves"])]
                kids = range(row["place"] * size, row["place"] * size + row["leaves"])
                yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * len(own)), pa.array(kids, pa.int64()), pa.array([path + row["path"] for path in own], pa.list_(pa.string()))], ["tree", "place", "path"])

    from_above = None
    for depth in range(len(layers) - 1, -1, -1):
        layer = layers[depth]
        ended = layer.filter("n = 1").join(roots, "tree").select("tree", "place", "path")
        paths = ended if from_above is None else ended.unionByName(from_above)
        if depth == 0:
            return paths, layer
        below = layers[depth - 1].groupBy("tree").agg(F.max("n").alias("below"))  # how many blocks the layer under this one has
        leaves = F.least(F.lit(size).cast("long"), F.col("below") - F.col("place") * size).alias("leaves")
        asked = layer.join(below, "tree").join(paths, ["tree", "place"]).select("tree", "place", leaves, "height", "nodes", "path")
        from_above = asked.mapInArrow(children, PATHS)
    raise AssertionError("no layers")


class Manifest:
    """Blocks of every layer of the groups' trees and of the tree over their roots, and the leaves' places."""

    def __init__(self, leaves: DataFrame, height: int = 4, fanout: int = 8, partition_rows: int = 1_000_000):
        ship(leaves.sparkSession)
        self.height, self.fanout, self.size = height, fanout, fanout**height
        leaves = cut(leaves)
        partitions = max(16, math.ceil(leaves.count() / partition_rows))
        self.leaves = cut(numbered(leaves, [F.asc_nulls_first("doc_id"), F.col("leaf"), F.asc_nulls_first("shown")], partitions))
        self.layers = layers_of(self.leaves, height, fanout)
        subroots = self.layers[0].filter("n = 1")
        for layer in self.layers[1:]:
            subroots = subroots.unionByName(layer.filter("n = 1"))
        self.subroots = cut(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("leaf")), [F.col("group")], 16))
        self.top = layers_of(self.subroots, height, fanout) if self.subroots.count() else []

    def blocks(self) -> DataFrame:
        """layer, tree, place, n, height, root, nodes: what is stored; the groups' trees first, the tree over their roots (tree '') last."""
        kinds = [(layer, depth) for layers in (self.layers, self.top) for depth, layer in enumerate(layers)]
        out = [layer.select(F.lit(depth).alias("layer"), "*") for layer, depth in kinds]
        for more in out[1:]:
            out[0] = out[0].unionByName(more)
        return out[0]

    def _group_paths(self) -> DataFrame:
        """(tree, subroot, root, path) of each group: from its root to the root of all."""
        if not self.top:
            return self.subroots.select(F.col("group").alias("tree"), F.col("leaf").alias("subroot"), F.col("leaf").alias("root"), F.array().cast("array<string>").alias("path"))
        none = self.top[-1].filter("n = 1").select("tree", F.array().cast("array<string>").alias("path"))
        root = self.top[-1].filter("n = 1").select(F.col("root").alias("root"))
        paths = self._read(self.subroots.select("tree", "place", "n", F.col("leaf"), F.lit(None).cast("string").alias("shown"), F.col("group")), self.top, none, paths=True)
        return paths.join(F.broadcast(root)).select(F.col("group").alias("tree"), F.col("leaf").alias("subroot"), "root", "path")

    def _read(self, rows: DataFrame, layers: list[DataFrame], roots: DataFrame, paths: bool) -> DataFrame:
        """The rows with their path, or with its digest and the folded root; rows meet the block that holds them."""
        size, fanout = self.size, self.fanout
        above, first = paths_of(layers, roots, fanout, self.height)
        keyed = rows.withColumn("block", F.floor(F.col("place") / size))
        held = first.join(above, ["tree", "place"]).select("tree", F.col("place").alias("block"), "height", "nodes", "path")
        names = [c for c in rows.columns if c not in ("n", "shown")]

        def read(mine: pa.Table, block: pa.Table) -> pa.Table:
            height, above = block.column("height")[0].as_py(), block.column("path")[0].as_py()
            total, number = mine.column("n")[0].as_py(), block.column("block")[0].as_py()
            levels = siblings(block.column("nodes")[0].as_py(), min(size, total - number * size), height, fanout)
            out, proof, root = [], [], []
            for place, leaf, shown in zip(mine.column("place").to_pylist(), mine.column("leaf").to_pylist(), mine.column("shown").to_pylist(), strict=True):
                at = place - number * size
                path = [part for k, level in enumerate(levels) for part in level[at // fanout**k]] + above
                if paths:
                    out.append(path)
                else:
                    proof.append(digest(path))
                    root.append(folded(shown or leaf, path))
            found = {"path": pa.array(out, pa.list_(pa.string()))} if paths else {"proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(root, pa.string())}
            return pa.table({c: mine.column(c) for c in names} | found)

        kinds = dict(rows.dtypes)
        kind = ", ".join(f"{c} {kinds[c]}" for c in names) + (", path array<string>" if paths else ", proof_sha256 string, folded_root string")
        return keyed.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInArrow(read, kind)

    def proofs(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf."""
        groups = cut(self._group_paths())
        rows = self._read(self.leaves, self.layers, groups.select("tree", "path"), paths=False)
        known = groups.select("tree", "subroot", "root")
        few = F.broadcast(known) if known.count() <= 100_000 else known
        return rows.join(few, "tree").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def verified_manifest(docs: DataFrame, tampered: Column | None = None, height: int = 4, fanout: int = 8) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of documents.

    A leaf is the digest of doc_id, source, lang, n_chars and text, null or not; other columns are ignored. Leaves of a language (null is one of its own)
    go by doc_id, null first, rows of one id by their digest; equal rows have a place each. Where `tampered` holds, the row shows itself with
    its text's A-Z in lower case, and its proof fails unless that changes nothing. Very long texts are hashed whole in the scan and never move; what
    moves is a digest a row. An empty table gives an empty result. A hot language is many partitions and blocks.
    """
    return Manifest(leaves_of(docs, tampered), height, fanout).proofs()


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


def _levels(name: str, leaves: str) -> str:
    """SQL of all nodes (tree, level, i, h, n) over leaves (tree, i, h, n), eight to a run."""
    return f"""{name} as (
  select tree, 0 as level, i, h, n from {leaves}
  union all
  select tree, level + 1, i // 8, sha256(string_agg(h, '' order by i)), (n + 7) // 8 from {name} where n > 1 group by tree, level, i // 8, n
)"""


def _walk(name: str, start: str, nodes: str) -> str:
    """SQL of (k, level, tree, i, h, sibs): from start (k, tree, i, h, total) to the root of its tree, with siblings."""
    return f"""{name}_sibs as (
  select a.tree, a.level, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (b.i < a.i), '') as before, coalesce(string_agg(b.h, '' order by b.i) filter (b.i > a.i), '') as behind
  from {nodes} a join {nodes} b on a.tree = b.tree and a.level = b.level and a.i // 8 = b.i // 8 where a.n > 1 group by all
), {name} as (
  select k, tree, 0 as level, i, h, '' as sibs from {start}
  union all
  select w.k, w.tree, w.level + 1, w.i // 8, sha256(s.before || w.h || s.behind), w.sibs || s.before || s.behind from {name} w join {name}_sibs s using (tree, level, i)
), {name}_end as (select k, arg_max(h, level) as h, arg_max(sibs, level) as sibs from {name} group by k)"""


def _field(column: str) -> str:
    return f"case when {column} is null then '-' else strlen({column}::varchar)::varchar || ':' || {column}::varchar end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(text if c == "text" else c) for c in FIELDS) + ")"


SQL = {
    "op11_merkle_manifest": f"""
with recursive crc_table as (
  select list(v order by b) as t from (
    select b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256))::bigint as b)
  )
), checked as (
  select doc_id, source, lang, n_chars, text, xor(list_reduce(list_prepend(4294967295::bigint, [ord(x)::bigint for x in string_split(doc_id::varchar, '')]), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 3 = 0 as turned
  from documents, crc_table
), leaves as (
  select doc_id, case when lang is null then '-' else '=' || lang end as tree, {_leaf("text")} as h,
    case when turned then {_leaf("translate(text, '" + UPPER + "', '" + LOWER + "')")} end as shown from checked
), placed as (
  select row_number() over () as k, doc_id, tree, h, coalesce(shown, h) as shown, row_number() over (partition by tree order by doc_id nulls first, h) - 1 as i, count(*) over (partition by tree) as n from leaves
), {_levels("nodes", "placed")}, subroots as (
  select '' as tree, tree as lang, row_number() over (order by encode(tree)) - 1 as i, h, count(*) over () as n from nodes where n = 1
), {_levels("top", "subroots")}, {_walk("inner_walk", "(select k, tree, i, shown as h from placed)", "nodes")}, outer_start as (
  select p.k, s.tree, s.i, w.h, w.sibs from placed p join subroots s on s.lang = p.tree join inner_walk_end w using (k)
), {_walk("outer_walk", "outer_start", "top")}
select p.doc_id, p.h as leaf, s.h as subroot, r.h as root, sha256(i.sibs || o.sibs) as proof_sha256, o.h as folded_root, o.h = r.h as verified
from placed p join subroots s on s.lang = p.tree join inner_walk_end i using (k) join outer_walk_end o using (k), (select h from top where n = 1) r""",
}
