"""Hard negatives by coordinate pruning: length buckets, sorted coordinate lists, feasible ranges, exact verification.

Vectors are laid out by label and falling length in slabs of bounded size. A slab is cut into buckets of like length, and a
bucket holds, for each coordinate, its unit vectors' values in order. An anchor that needs a score of at least s meets only buckets whose
longest vector can reach it; in these an angle of at most arccos(s / lengths) is left, so each coordinate of a match lies in a range
about the anchor's own. The ranges of the anchor's largest (focus) coordinates select slices of the sorted lists, and rows in
all slices are verified by their exact inner products. Where even the narrowest slice holds much of a bucket, coordinates don't part
anything there, and the whole bucket is verified by one matrix product. Nothing is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table
from millrace.llm.shared import give_back
from millrace.session import ship

#: Components this large give scores that need not fit a long; such rows take no part.
WIDEST = 1 << 28
#: Below and above every score; both are exact as floats.
NONE, ANY = np.iinfo(np.int64).min, 1 << 62
PACKED = "id long, label long, asks boolean, own long, length double, wide boolean, v binary"


def components_of(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * x) of each vector, shorter ones filled up with 0, their sizes, and which rows may take part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.array(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls come out as NaN
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    with np.errstate(invalid="ignore", over="ignore"):
        out = np.floor(out * scale)
        good = np.array(column.is_valid()) & np.isfinite(out).all(1) & (np.abs(out) < WIDEST).all(1)
    return np.where(good[:, None], out, 0).astype(np.int64), sizes, good


def packed(rows: DataFrame, asks: Column, id_col: str, label_col: str, vector_col: str, scale: float) -> DataFrame:
    """PACKED rows: integer components as 16 bits each, or 32 where one is wide."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes, good = components_of(batch.column("vector"), scale)
            own = (parts**2).sum(1)
            wide = (np.abs(parts) > 32767).any(1) if parts.shape[1] else np.zeros(len(parts), bool)
            data = [p[:n].astype("<i4" if w else "<i2").tobytes() for p, n, w in zip(parts, sizes, wide, strict=True)]
            kept = pa.array(good)
            cols = [batch.column("id"), batch.column("label"), batch.column("asks"), pa.array(own), pa.array(np.sqrt(own)), pa.array(wide), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in cols], [f.split()[0] for f in PACKED.split(", ")])

    q = lambda c: F.col(f"`{c}`")
    narrow = rows.select(q(id_col).cast("long").alias("id"), q(label_col).cast("long").alias("label"), F.coalesce(asks, F.lit(False)).alias("asks"), q(vector_col).alias("vector"))
    return narrow.filter("label is not null and vector is not null").mapInArrow(run, PACKED)


def unpacked(rows: pa.Table) -> np.ndarray:
    """The vectors of PACKED rows as one matrix of int64."""
    data, wide = rows.column("v").to_pylist(), rows.column("wide").to_pylist()
    parts = [np.frombuffer(d, "<i4" if w else "<i2") for d, w in zip(data, wide, strict=True)]
    if len({len(p) for p in parts}) == 1:
        return np.stack(parts).astype(np.int64)
    out = np.zeros((len(parts), max(map(len, parts), default=0)), np.int64)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = part
    return out


def fitted(matrix: np.ndarray, kind: np.dtype, dims: int) -> np.ndarray:
    out = np.zeros((len(matrix), dims), kind)
    out[:, : matrix.shape[1]] = matrix
    return out


class Bucket:
    """Distinct vectors of like length, with each coordinate's unit values in order."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray, lengths: np.ndarray):
        self.rows, self.x = rows, matrix
        self.least, self.most = float(lengths.min()), float(lengths.max())
        unit = (matrix / np.maximum(lengths, 1e-300)[:, None]).astype(np.float32)
        self.order = np.ascontiguousarray(np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16))
        self.value = np.take_along_axis(np.ascontiguousarray(unit.T), self.order.astype(np.int64), 1)

    def cosines(self, size: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The cosine that a vector of this bucket must have at least with anchors of these lengths; above 1 there is none."""
        reach = size * np.where(need > 0, self.most, self.least)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(reach > 0, need / reach, np.where(need > 0, np.inf, -np.inf))

    def slices(self, unit: np.ndarray, focus: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the sorted lists of the focus coordinates between which all matches lie."""
        off = (np.arccos(np.clip(cosine, -1, 1)) + 1e-6)[:, None]
        own = np.arccos(np.clip(np.take_along_axis(unit, focus, 1), -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + off)) - 1e-6, np.cos(np.maximum(0, own - off)) + 1e-6
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            at = np.nonzero(focus == f)
            first[at], last[at] = np.searchsorted(self.value[f], low[at], "left"), np.searchsorted(self.value[f], high[at], "right")
        return first, last

    def hits(self, anchors: np.ndarray, unit: np.ndarray, size: np.ndarray, focus: np.ndarray, need: np.ndarray, most: np.ndarray, ok: np.ndarray | None, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, row of the bucket, score) with need <= score <= most, exactly; ok tells allowed (anchor, row) pairs."""
        cosine = self.cosines(size, need)
        alive = np.flatnonzero(cosine <= 1 + 1e-9)
        if not len(alive):
            return
        first, last = self.slices(unit[alive], focus[alive], cosine[alive])
        few = (last - first).min(1) < share * len(self.rows)
        kind = self.x.dtype
        for i, a, b in zip(alive[few], first[few], last[few], strict=True):
            lists = [self.order[f, s:e] for f, s, e in zip(focus[i], a, b, strict=True)]
            j = np.flatnonzero(np.bincount(np.concatenate(lists), minlength=1) == len(lists))
            score = self.x[j] @ anchors[i]
            good = (score >= need[i].astype(kind)) & (score <= most[i].astype(kind))
            good &= True if ok is None else ok[i, j]
            yield np.full(int(good.sum()), i), j[good], score[good].astype(np.int64)
        dense = alive[~few]
        if len(dense):
            score = anchors[dense] @ self.x.T
            good = (score >= need[dense, None].astype(kind)) & (score <= most[dense, None].astype(kind))
            if ok is not None:
                good &= ok[dense]
            i, j = np.nonzero(good)
            yield dense[i], j, score[i, j].astype(np.int64)


class Slab:
    """A slab's vectors: equal ones of one label once, with their smallest ids, in buckets of falling length."""

    def __init__(self, rows: pa.Table, copies: int, bucket: int, longest: float):
        self.bucket = bucket
        matrix, label, length = unpacked(rows), np.array(rows.column("label")), np.array(rows.column("length"))
        ids = rows.column("id").combine_chunks()
        named = np.array(ids.is_valid())
        ids = np.array(ids.fill_null(0))
        by_id = np.lexsort((ids, ~named))
        self.ids, self.named = ids[by_id], named[by_id]
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        #: Float products and sums are exact as long as no score needs more bits than the mantissa has.
        reach = longest * float(length.max(initial=0))
        self.kind = np.dtype(np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64)
        same = np.unique(np.column_stack([label, matrix]), axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((rank, same))
        start = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
        place = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
        first = order[start]
        kept = order[place < copies]
        self.ranks = rank[kept]
        self.from_, self.to = np.searchsorted(same[kept], np.arange(len(first)), "left"), np.searchsorted(same[kept], np.arange(len(first)), "right")
        self.matrix, self.label, self.length = matrix[first].astype(self.kind), label[first], length[first]

    def buckets(self, among: np.ndarray) -> Iterator[Bucket]:
        among = among[np.argsort(-self.length[among], kind="stable")]
        for at in range(0, len(among), self.bucket):
            rows = among[at : at + self.bucket]
            yield Bucket(rows, self.matrix[rows], self.length[rows])

    def expanded(self, key: np.ndarray, row: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hits of distinct vectors as hits of their rows: (key, score, rank of the id)."""
        n = self.to[row] - self.from_[row]
        at = np.repeat(self.from_[row] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(key, n), np.repeat(score, n), self.ranks[at]


class Best:
    """The k best (score, then rank of id) of each key so far."""

    def __init__(self, keys: int, k: int):
        self.k, self.score, self.rank = k, np.full((keys, k), NONE), np.full((keys, k), -1)

    def take(self, key: np.ndarray, score: np.ndarray, rank: np.ndarray) -> None:
        if not len(key):
            return
        touched = np.unique(key)
        old = self.score[touched] != NONE
        key = np.concatenate([key, np.repeat(touched, old.sum(1))])
        score, rank = np.concatenate([score, self.score[touched][old]]), np.concatenate([rank, self.rank[touched][old]])
        order = np.lexsort((rank, -score, key))
        key = key[order]
        start = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        place = np.arange(len(key)) - np.repeat(start, np.diff(np.r_[start, len(key)]))
        kept = place < self.k
        self.score[touched], self.rank[touched] = NONE, -1
        self.score[key[kept], place[kept]], self.rank[key[kept], place[kept]] = score[order][kept], rank[order][kept]


def _pruned(score_rows: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row: what a first look at a bucket needs of it at least."""
    return np.partition(score_rows, -k, axis=1)[:, -k].astype(np.int64) if score_rows.shape[1] >= k else np.full(len(score_rows), NONE)


class Asking:
    """A block of anchors as the buckets take them."""

    def __init__(self, rows: pa.Table, slab: Slab, focus: int):
        whole = unpacked(rows)
        dims = max(whole.shape[1], slab.matrix.shape[1])
        slab.matrix = fitted(slab.matrix, slab.kind, dims)
        self.x = fitted(whole, slab.kind, dims)
        self.size, self.label = np.array(rows.column("length")), np.array(rows.column("label"))
        self.unit = self.x / np.maximum(self.size, 1e-300)[:, None]
        n = min(focus, dims)
        self.focus = np.argpartition(-np.abs(self.unit), max(0, n - 1), axis=1)[:, :n] if dims else np.zeros((len(whole), 0), np.int64)

    def cut(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        return self.x[at], self.unit[at], self.size[at], self.focus[at]


def positives_in(slab: Slab, anchors: pa.Table, k: int, focus: int, share: float, chunk: int) -> Best:
    """The k best rows of each anchor's own label in the slab."""
    asking, best = Asking(anchors, slab, focus), Best(anchors.num_rows, k)
    for label in np.unique(asking.label):
        mine = np.flatnonzero(asking.label == label)
        for bucket in slab.buckets(np.flatnonzero(slab.label == label)):
            for start in range(0, len(mine), chunk):
                part = mine[start : start + chunk]
                x, unit, size, axes = asking.cut(part)
                need = best.score[part, k - 1]
                if (need == NONE).any():  # a first look: of this bucket, only its own k best can be among the best
                    need = np.maximum(need, _pruned(x @ bucket.x.T, k))
                for i, j, score in bucket.hits(x, unit, size, axes, need, np.full(len(part), ANY), None, share):
                    best.take(*slab.expanded(part[i], bucket.rows[j], score))
    return best


def negatives_in(slab: Slab, anchors: pa.Table, k: int, low: int, high: int, of: int, focus: int, share: float, chunk: int) -> tuple[Best, np.ndarray]:
    """The k best rows of other labels for each (anchor, positive), and the anchor of each of these keys."""
    asking = Asking(anchors, slab, focus)
    scores = anchors.column("positive_scores").to_pylist()
    of_key = np.repeat(np.arange(len(scores)), [len(s) for s in scores])
    from_ = np.searchsorted(of_key, np.arange(len(scores)))
    width = max(map(len, scores), default=0)
    wanted = [p for s in scores for p in s]
    least, most = np.array([-(-low * p // of) for p in wanted], np.int64), np.array([high * p // of for p in wanted], np.int64)
    best = Best(len(of_key), k)
    for bucket in slab.buckets(np.arange(len(slab.label))):
        for start in range(0, len(scores), chunk):
            part = np.arange(start, min(start + chunk, len(scores)))
            x, unit, size, axes = asking.cut(part)
            # What each of an anchor's positives still needs; the anchor needs the least of these.
            need_key = np.maximum(least, best.score[:, k - 1])
            void = need_key > most
            need, top = np.full(len(part), ANY), np.full(len(part), NONE)
            keys = np.flatnonzero((of_key >= part[0]) & (of_key <= part[-1]) & ~void)
            np.minimum.at(need, of_key[keys] - start, need_key[keys])
            np.maximum.at(top, of_key[keys] - start, most[keys])
            other = asking.label[part][:, None] != slab.label[bucket.rows][None, :]
            for i, j, score in bucket.hits(x, unit, size, axes, need, top, other, share):
                for p in range(width):
                    key = from_[part[i]] + p
                    real = key < np.r_[from_[1:], len(of_key)][part[i]]
                    good = np.zeros(len(i), bool)
                    good[real] = (score[real] >= need_key[key[real]]) & (score[real] <= most[key[real]])
                    best.take(*slab.expanded(key[good], bucket.rows[j[good]], score[good]))
    return best, of_key


def hard_negatives(
    rows: DataFrame, asks: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, of: int = 100,
    slab_rows: int = 131_072, most_anchors: int = 262_144, bucket: int = 4096, focus: int = 3, share: float = 0.25, chunk: int = 512, least_slabs: int = 32,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows that `asks` tells.

    A score is the inner product of floor(scale * x). An anchor's positives are the best other rows of its label; the negatives of each are the
    best rows of other labels with low * positive <= of * score <= high * positive; ties go by smaller id. Rows with a null label, a null
    vector, a null or non-finite component or a component of 2^28 or more after scaling take no part; shorter vectors count as filled up
    with 0; rows without an id are found (as null, last among equals); of a repeated row each is a row of its own; empty tables give an empty result; other columns are ignored.

    Two searches of all anchors against all vectors, in tiles of a slab and a block of anchors, both of bounded size: first the positives in the
    slabs that hold the anchor's label, then the negatives in the slabs whose length can reach what the positives ask for. Equal vectors of one label are
    one vector with a few smallest ids inside a slab, so copies cost nothing. Only the slabs' labels and lengths, a row for each slab, come to the driver.
    """
    laid = cut(packed(rows, asks, id_col, label_col, vector_col, scale))
    n, n_anchors, longest = laid.agg(F.count(F.lit(1)), F.count_if("asks"), F.coalesce(F.max("length"), F.lit(0.0))).first()
    slabs, blocks = max(least_slabs, math.ceil(n / slab_rows)), max(1, math.ceil(n_anchors / most_anchors))
    laid = cut(laid.repartitionByRange(slabs, "label", F.desc("length"), F.xxhash64("v"), "id").withColumn("slab", F.spark_partition_id()))
    shape = [tuple(r) for r in laid.groupBy("slab").agg(F.min("label"), F.max("label"), F.max("length")).collect()]
    anchors = cut(laid.filter("asks").drop("asks", "slab").withColumn("aid", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int")))
    vectors = laid.drop("asks", "own")
    vectors = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else vectors.withColumn("block", F.lit(0))

    def sent(asking: DataFrame, reaches) -> DataFrame:
        """Each anchor once for each slab that it can find something in."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for slab, *what in shape:
                    part = batch.filter(pa.array(reaches(batch, *what)))
                    if part.num_rows:
                        yield part.append_column("slab", pa.array([slab] * part.num_rows, pa.int32()))

        return asking.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in asking.dtypes) + ", slab int")

    def tiles(asking: DataFrame, search, kind: str) -> DataFrame:
        return vectors.groupBy("slab", "block").cogroup(asking.groupBy("slab", "block")).applyInArrow(search, kind)

    def of_label(batch: pa.RecordBatch, first: int, last: int, _: float) -> np.ndarray:
        label = np.array(batch.column("label"))
        return (label >= first) & (label <= last)

    def found(slab: Slab, best: Best, cols: list[tuple[str, np.ndarray]]) -> pa.Table:
        key, place = np.nonzero(best.score != NONE)
        rank = best.rank[key, place]
        out = {name: values[key] for name, values in cols}
        give_back()
        return pa.table(out | {"score": best.score[key, place], "found": pa.array(slab.ids[rank], pa.int64(), mask=~slab.named[rank])})

    def first_search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"aid": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "found": pa.array([], pa.int64())})
        slab = Slab(left, positives + 1, bucket, longest)
        return found(slab, positives_in(slab, right, positives + 1, focus, share, chunk), [("aid", np.array(right.column("aid")))])

    # An anchor finds itself, so one more is sought; of equal rows any one is itself.
    by_score = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("found"))
    near = tiles(sent(anchors, of_label), first_search, "aid long, score long, found long").withColumn("at", F.row_number().over(by_score("aid"))).filter(F.col("at") <= positives + 1)
    listed = near.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("at", "score", "found"))).alias("near"))
    known = anchors.join(listed, "aid")
    itself = F.array_position(F.transform("near", lambda x: (x.score == F.col("own")) & x.found.eqNullSafe(F.col("id"))), True)
    others = F.slice(F.filter("near", lambda x, i: (itself == 0) | (i != itself - 1)), 1, positives)
    known = cut(known.withColumn("others", others).filter(F.size("others") > 0).withColumn("positive_scores", F.col("others.score")).drop("near", "own"))

    def in_reach(batch: pa.RecordBatch, first: int, last: int, length: float) -> np.ndarray:
        need = np.array([min(-(-low * p // of) for p in s) for s in batch.column("positive_scores").to_pylist()], float)
        label, size = np.array(batch.column("label")), np.array(batch.column("length"))
        return ((label != first) | (label != last)) & (size * length * (1 + 1e-9) >= need)

    def second_search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"aid": pa.array([], pa.int64()), "place": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "found": pa.array([], pa.int64())})
        slab = Slab(left, negatives, bucket, longest)
        best, of_key = negatives_in(slab, right, negatives, low, high, of, focus, share, chunk)
        place = np.arange(len(of_key)) - np.searchsorted(of_key, of_key)
        return found(slab, best, [("aid", np.array(right.column("aid"))[of_key]), ("place", place.astype(np.int32))])

    far = tiles(sent(known.drop("others", "id"), in_reach), second_search, "aid long, place int, score long, found long")
    far = far.withColumn("rank", F.row_number().over(by_score("aid", "place"))).filter(F.col("rank") <= negatives)
    asked = known.select("aid", F.col("id").alias("anchor_id"), F.posexplode("others").alias("place", "positive"))
    out = far.join(asked, ["aid", "place"])
    return out.select("anchor_id", F.col("positive.found").alias("positive_id"), "rank", F.col("found").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    turned = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(turned, F.col("vec_id") % 100 == 0)


SQL = {
    "op12_hard_negatives": """
with rows as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
  select a.r as ar, a.vec_id as anchor_id, b.r as br, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from rows a join rows b on a.r <> b.r where a.vec_id % 100 = 0
), positives as (
  select * from scored where same qualify row_number() over (partition by ar order by score desc, other_id) <= 5
), bands as (
  select p.anchor_id, p.other_id as positive_id, p.score as positive_score, n.other_id as negative_id, n.score as negative_score,
    row_number() over (partition by p.ar, p.br order by n.score desc, n.other_id) as rank
  from positives p join scored n on n.ar = p.ar and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from bands where rank <= 5""",
}
