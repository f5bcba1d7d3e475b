"""N-gram Jaccard join through count vectors in an R-tree.

Shingles are hashed into groups; a document is the point of its group counts, and the overlap of two documents is at
most the sum of their coordinates' minima. Two uses of the groups make this a distributed join:

- Blocks. If two sets of at most U elements link, they differ in at most 2U (1 - t) / (1 + t) elements, so of one more
  groups than that, one at least holds the same elements in both. Documents meet in blocks of equal groups, never by
  crossing.
- Points. Inside a block an R-tree of count vectors finds the pairs whose bound reaches the threshold; they
  are joined to candidate components, and there the same tree's survivors are verified on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, row_key, slab, slabs_for, split_join, table, texts, without
from millrace.llm.components import components
from millrace.llm.shared import KEY, M1, M2, by_bucket, column, found, give_back, mixed, owned, received, shared_keys

#: Coordinates of a point, at least.
COORDINATES = 32


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * M1)
_LETTER[_SPACE] = 0
_STEP = M2 | np.uint64(1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a buffer's words, and where they start; no table of words is kept."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    at = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    powers = np.cumprod(np.full(int(at.max()) + 1, _STEP))
    return mixed(np.add.reduceat(_LETTER[data[starts[0] :]] * powers[at], starts - starts[0])), starts


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of shingles; a shorter text is one shingle, one without words has none."""
    raws = [t.encode().lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raws], np.int64)
    h, starts = word_hashes(b" ".join(raws))
    bounds = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    total = h.copy()
    for k in range(1, width):
        left = max(0, len(h) - k)
        total[:left] = mixed(total[:left] * M1) + h[k:]
    total = mixed(total * M2 + np.uint64(width))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(total[a : b - width + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif b > a:
            own = h[a : a + 1].copy()
            for k in range(1, b - a):
                own = mixed(own * M1) + h[a + k : a + k + 1]
            out.append(mixed(own * M2 + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


class Threshold:
    """Jaccard at least over / of, in whole numbers."""

    def __init__(self, over: int, of: int = 100):
        self.over, self.of = over, of
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 5 // 4)))
        self.bounds = np.array(bounds)

    def need(self, x, y):
        """The least overlap with which sets of these sizes link."""
        return -(-(x + y) * self.over // (self.over + self.of))

    def tiers(self, n: int) -> list[int]:
        """The size tiers in which a set may meet a partner that is as large or larger, its own first."""
        t = int(np.searchsorted(self.bounds, n, "right")) - 1
        out = [t]
        while n * self.of >= self.over * int(self.bounds[out[-1] + 1]):
            out.append(out[-1] + 1)
        return out

    def groups(self, tier: int) -> tuple[int, int]:
        """How many groups a tier has, and how many of them a set may leave out.

        Linked sets differ in at most k elements, so in at most k groups: of k + 1 + spare, spare + 1 are equal. Each
        set leaves out groups smaller than some size, at most spare of them. Of two sets take the one with the larger
        size: of the equal groups at most spare are smaller than that, so one at least is kept by both.
        """
        most = int(self.bounds[tier + 1]) - 1
        k = 2 * most * (self.of - self.over) // (self.of + self.over)
        spare = -(-k * 3 // 20)
        return k + 1 + spare, spare

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each kept group's elements, in each tier, and the number of coordinates that the tier's points have."""
        out, coordinates = [], []
        # Groups are ranges of the hash, and the set is sorted, so a group's elements are neighbours.
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mixed(s ^ M2), out=total[1:])
        for tier in self.tiers(len(s)):
            edges, names, spare = self.ranges(tier)
            at = np.empty(len(edges) + 1, np.int64)
            at[:-1], at[-1] = np.searchsorted(s, edges), len(s)
            ends = total[at]
            sums, sizes = ends[1:] - ends[:-1], at[1:] - at[:-1]
            kept = sizes >= np.partition(sizes, spare)[spare]
            out.append(mixed(sums[kept] + names[kept]) & KEY)
            coordinates.append(np.full(len(out[-1]), self.coordinates(int(self.bounds[tier + 1]))))
        return np.concatenate(out), np.concatenate(coordinates)

    def coordinates(self, n: int) -> int:
        """How many coordinates part unrelated sets of size n: their counts then differ by more than linked ones may."""
        wanted = 1.5 * (2.3 * (self.of - self.over) / (self.of + self.over)) ** 2 * n
        d = COORDINATES
        while d < wanted and d < 4096:
            d *= 2
        return d

    @lru_cache(maxsize=None)  # noqa: B019  one entry for each tier
    def ranges(self, tier: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The least hash of each of a tier's groups, a number for each group, and how many a set may leave out."""
        d, spare = self.groups(tier)
        edges = np.array([-(-(k << 64) // d) for k in range(d)], np.uint64)
        return edges, mixed(np.arange(d, dtype=np.uint64) * M2 + np.uint64(tier)), spare


def point(s: np.ndarray, coordinates: int) -> np.ndarray:
    return np.minimum(np.bincount((mixed(s ^ M2) >> np.uint64(40)).astype(np.int64) % coordinates, minlength=coordinates), 65535).astype(np.uint16)


class Tree:
    """An R-tree of two levels over count vectors, packed by size; a leaf keeps its coordinates' maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, threshold: Threshold, leaf: int = 48):
        self.threshold, self.leaf = threshold, leaf
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.points, self.sizes = points[self.order].astype(np.int32), sizes[self.order]
        self.starts = np.arange(0, len(sizes), leaf)
        self.top = np.maximum.reduceat(self.points, self.starts, axis=0)
        self.small = self.sizes[self.starts]
        self.large = np.maximum.reduceat(self.sizes, self.starts)
        self.open = np.ones(len(sizes), bool)
        self.left = len(sizes)

    def near(self, q: np.ndarray, n: int) -> np.ndarray:
        """Open members whose bound with a point of size n reaches the threshold, as positions before packing."""
        t = self.threshold
        leaves = np.flatnonzero((self.large * t.of >= t.over * n) & (self.small * t.over <= t.of * n))
        leaves = leaves[np.minimum(self.top[leaves], q).sum(1) >= t.need(n, self.small[leaves])]
        at = (self.starts[leaves][:, None] + np.arange(self.leaf)).ravel()
        at = at[at < len(self.sizes)]
        at = at[self.open[at]]
        return at[np.minimum(self.points[at], q).sum(1) >= t.need(n, self.sizes[at])]

    def take(self, at: np.ndarray) -> None:
        self.open[at] = False


def forest(points: np.ndarray, sizes: np.ndarray, threshold: Threshold, verify=None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links: a found member leaves the tree, so none is met twice.

    verify(i, candidates) says which candidates link with i; without it the bound decides.
    """
    edges: list[tuple[int, int]] = []
    tree = Tree(points, sizes, threshold)
    packed = np.empty(len(sizes), np.int64)
    packed[tree.order] = np.arange(len(sizes))
    for first in range(len(sizes)):
        if not tree.open[packed[first]]:
            continue
        tree.take(packed[first : first + 1])
        queue = [first]
        while queue:
            i = queue.pop()
            at = tree.near(points[i].astype(np.int32), int(sizes[i]))
            if len(at):
                members = tree.order[at]
                if verify is not None:
                    links = verify(i, members)
                    members, at = members[links], at[links]
                tree.take(at)
                queue += members.tolist()
                edges += [(i, int(j)) for j in members]
    return edges


class Joined(dict):
    """Nodes joined within one task; comes out as each node's edge to the smallest of its set."""

    def root(self, node: int) -> int:
        top = self.setdefault(node, node)
        while self[top] != top:
            top = self[top]
        while self[node] != top:
            self[node], node = top, self[node]
        return top

    def add(self, u: int, v: int) -> None:
        a, b = self.root(u), self.root(v)
        self[max(a, b)] = min(a, b)

    def all_one(self, nodes: list[int]) -> bool:
        first = self.root(nodes[0])
        return all(n in self and self.root(n) == first for n in nodes[1:])

    def edges(self) -> pa.Table:
        pairs = [(n, top) for n in list(self) if (top := self.root(n)) != n]
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})


class Classes:
    """A slab's documents with equal sets as one class; its node is the smallest doc_id."""

    def __init__(self, rows: pa.Table, width: int):
        ids = np.array(column(rows, "doc_id"), np.int64)
        self.docs: list[tuple[int, int, int]] = []
        known: dict[bytes, int] = {}
        self.sets: list[np.ndarray] = []
        self.nodes: list[int] = []
        order = np.argsort(ids, kind="stable").tolist()
        text = column(rows, "text")
        for k, s in zip(order, shingle_sets([text[k] for k in order], width), strict=True):
            if not len(s):
                self.docs.append((int(ids[k]), 0, int(ids[k])))
                continue
            c = known.setdefault(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(self.sets))
            if c == len(self.sets):
                self.sets.append(s)
                self.nodes.append(int(ids[k]))
            self.docs.append((int(ids[k]), len(s), self.nodes[c]))

    def signatures(self, threshold: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All signatures, the class of each, and its number of coordinates."""
        parts = [threshold.signatures(s) for s in self.sets]
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])


def row(coordinates: int) -> np.dtype:
    return np.dtype([("sig", "<u8"), ("node", "<i8"), ("n", "<i8"), ("point", "<u2", (coordinates,))])


def packed_rows(rows: np.ndarray) -> bytes:
    """Rows column by column, compressed: a node's number and point come with each of its signatures."""
    raw = b"".join([rows["sig"].tobytes(), rows["node"].tobytes(), rows["n"].astype("<u4").tobytes(), np.ascontiguousarray(rows["point"].T).tobytes()])
    return len(rows).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked_rows(blobs: list[bytes], coordinates: int) -> np.ndarray:
    parts = []
    for blob in blobs:
        k = int.from_bytes(blob[:4], "little")
        raw = pa.decompress(blob[4:], k * (20 + 2 * coordinates), "zstd", asbytes=True)
        rows = np.empty(k, row(coordinates))
        rows["sig"], rows["node"] = np.frombuffer(raw, "<u8", k), np.frombuffer(raw, "<i8", k, 8 * k)
        rows["n"] = np.frombuffer(raw, "<u4", k, 16 * k)
        rows["point"] = np.frombuffer(raw, "<u2", k * coordinates, 20 * k).reshape(coordinates, k).T
        parts.append(rows)
    return np.concatenate(parts)


KIND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
KIND_DDL = "kind int, doc_id long, n long, node long, bucket long, data binary"


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, over: int = 90, of: int = 100, slab_bytes: int = 1 << 20, tile: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when of * intersection >= over * union of their sets of distinct word shingles (A-Z lowered,
    words between ASCII white space); component_id is the smallest doc_id reachable by links. Null and
    empty texts have no shingles and link with nothing; texts shorter than the width are one shingle; equal
    texts and repeated rows share a component; an empty table gives an empty result; rows
    without an id are counted and have no component, as they can be the smallest of none, and link nobody. Slabs and tiles
    bound what a task holds; the number of both follows the input. A candidate component of more than `tile` hashes is cut
    into parts, and each pair of parts is a group of its own.
    """
    threshold = Threshold(over, of)
    whole = texts(docs, id_col, text_col)
    rows = whole.filter("doc_id is not null")
    n_slabs = slabs_for(rows, slab_bytes)
    n_buckets = max(64, n_slabs // 8)
    slabs = rows.withColumn("slab", slab(n_slabs))

    def keys_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return owned(*Classes(part, width).signatures(threshold)[:2])

    shared = shared_keys(slabs, keys_of, n_buckets)

    def members(part: pa.Table, flags: pa.Table) -> pa.Table:
        if not part.num_rows:
            return KIND.empty_table()
        own = Classes(part, width)
        give_back()
        sigs, of_class, coordinates = own.signatures(threshold)
        hit, _ = found(sigs, received(flags)[0])
        sigs, of_class, coordinates = sigs[hit], of_class[hit], coordinates[hit]
        out = [(0, d, n, node, 0, None) for d, n, node in own.docs]
        for size in np.unique(coordinates).tolist():
            some = coordinates == size
            chosen, where = np.unique(of_class[some], return_inverse=True)
            rows = np.zeros(int(some.sum()), row(size))
            rows["sig"] = sigs[some]
            rows["node"] = np.array(own.nodes, np.int64)[chosen][where]
            rows["n"] = np.array([len(own.sets[c]) for c in chosen.tolist()])[where]
            rows["point"] = np.stack([point(own.sets[c], size) for c in chosen.tolist()])[where]
            out += [(1, 0, size, 0, b, packed_rows(rows[at])) for b, at in by_bucket(rows["sig"], n_buckets)]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), KIND, strict=True)], schema=KIND)

    all_rows = cut(slabs.groupBy("slab").cogroup(shared.groupBy("slab")).applyInArrow(members, KIND_DDL))
    def blocks(part: pa.Table) -> pa.Table:
        give_back()
        joined = Joined()
        blobs: dict[int, list[bytes]] = {}
        for size, blob in zip(column(part, "n"), column(part, "data"), strict=True):
            blobs.setdefault(size, []).append(blob)
        for size, some in blobs.items():
            join_blocks(unpacked_rows(some, size), joined)
        return joined.edges()

    def join_blocks(packed: np.ndarray, joined: Joined) -> None:
        packed = packed[np.argsort(packed["sig"], kind="stable")]
        starts = np.flatnonzero(np.r_[True, packed["sig"][1:] != packed["sig"][:-1]])
        sizes = np.diff(np.r_[starts, len(packed)])
        # Blocks of two are many and need no tree: all their bounds at once.
        two = starts[sizes == 2]
        a, b = packed[two], packed[two + 1]
        near = np.minimum(a["point"], b["point"]).sum(1, dtype=np.int64) >= threshold.need(a["n"], b["n"])
        for u, v in set(zip(a["node"][near].tolist(), b["node"][near].tolist(), strict=True)):
            joined.add(u, v)
        for first, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            block = packed[first : first + size]
            nodes = block["node"].tolist()
            if not joined.all_one(nodes):
                for i, j in forest(block["point"], block["n"], threshold):
                    joined.add(nodes[i], nodes[j])

    candidates = all_rows.filter("kind = 1").select("bucket", "n", "data").groupBy("bucket").applyInArrow(blocks, "u long, v long")
    grouped = components(candidates)
    # Where each set goes is settled on its size alone; only sets of candidate components are then taken from the slabs.
    sizes = split_join(all_rows.filter("kind = 0 and doc_id = node").select("node", "n").distinct(), grouped, ["node"], "inner")
    parts = sizes.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(tile)).cast("int").alias("parts"))
    places = split_join(sizes, parts, ["component"], "inner").select(slab(n_slabs, "node").alias("slab"), "node", "component", "parts")
    n_groups = max(n_buckets, 256)
    set_kind = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("component", pa.int64()), ("node", pa.int64()), ("data", pa.binary())])

    def placed(part: pa.Table, wanted: pa.Table) -> pa.Table:
        if not part.num_rows or not wanted.num_rows:
            return set_kind.empty_table()
        own = Classes(part, width)
        give_back()
        place = {node: (c, p) for node, c, p in zip(column(wanted, "node"), column(wanted, "component"), column(wanted, "parts"), strict=True)}
        out = []
        for node, s in zip(own.nodes, own.sets, strict=True):
            if node in place:
                c, p = place[node]
                mine = int(mixed(np.array([node], np.int64).astype(np.uint64))[0]) % p
                for k in range(p) if p > 1 else ():
                    out.append((c, min(k, mine), max(k, mine), c, node, s.tobytes()))
                if p == 1:
                    out.append((int(mixed(np.array([c], np.int64).astype(np.uint64))[0]) % n_groups, -1, -1, c, node, s.tobytes()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), set_kind, strict=True)], schema=set_kind) if out else set_kind.empty_table()

    sets = slabs.groupBy("slab").cogroup(places.groupBy("slab")).applyInArrow(placed, "g long, i int, j int, component long, node long, data binary")

    def verified(part: pa.Table) -> pa.Table:
        give_back()
        nodes, of_component = np.array(column(part, "node"), np.int64), np.array(column(part, "component"), np.int64)
        data = part.column("data")
        joined = Joined()
        order = np.argsort(of_component, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(of_component[order])) + 1):
            if len(group) < 2:
                continue
            own_sets = [np.frombuffer(data[k].as_buffer(), np.uint64) for k in group.tolist()]
            sizes = np.array([len(s) for s in own_sets])
            coordinates = threshold.coordinates(int(sizes.max()))
            starts = np.r_[0, np.cumsum(sizes)]
            _, dense = np.unique(np.concatenate(own_sets), return_inverse=True)
            mark = np.zeros(int(dense.max()) + 1, bool)

            def verify(i: int, among: np.ndarray) -> np.ndarray:
                mine = dense[starts[i] : starts[i + 1]]
                mark[mine] = True
                overlap = np.array([int(mark[dense[starts[j] : starts[j + 1]]].sum()) for j in among.tolist()])
                mark[mine] = False
                return of * overlap >= over * (sizes[i] + sizes[among] - overlap)

            for i, j in forest(np.stack([point(s, coordinates) for s in own_sets]), sizes, threshold, verify):
                joined.add(int(nodes[group[i]]), int(nodes[group[j]]))
        return joined.edges()

    links = sets.groupBy("g", "i", "j").applyInArrow(verified, "u long, v long")
    classes = components(links)
    out = split_join(all_rows.filter("kind = 0").select("doc_id", "n", "node"), classes, ["node"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")).unionByName(_unnamed(whole, width))


def _unnamed(whole: DataFrame, width: int) -> DataFrame:
    """The rows without an id, with the size of their set; nothing moves."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(shingle_sets([text.as_py()], width)[0]) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return whole.filter("doc_id is null").mapInArrow(sized, "doc_id long, n_shingles long, component_id long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row of each class with the smallest id, a null id last, with all its columns; rows are judged, not ids."""
    rows = docs.select(row_key(docs).alias("doc_id"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    classes = similarity_classes(rows, **options).select("doc_id", "component_id")
    named = cut(split_join(classes, rows.select("doc_id", "id").distinct(), ["doc_id"], "inner"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).getField("doc_id")
    groups = named.groupBy("component_id").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return without(docs, split_join(named, groups, ["component_id"], "inner").filter("doc_id <> best").select("doc_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), width=3, over=90, of=100)
