"""Nearest vectors by an index of inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.bounds import cut
from millrace.plans.projections import table
from millrace.session import ship

CHUNK = 1024


def units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of a list column at unit length; a vector of length 0 stays."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = np.concatenate([part.flatten().to_numpy(zero_copy_only=False) for part in parts]).astype(np.float64, copy=False).reshape(len(column), -1)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    out /= np.where(size > 0, size, 1)
    return out


def best_of_list(k: int):
    """The k best of each query among a part of a list: products of a chunk of queries with a chunk of vectors, merged as they come."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return kind.empty_table()
        asks, ids = queries.column("query_id").to_numpy(), vectors.column("vec_id").to_numpy()
        q, v = units(queries.column("q")), units(vectors.column("v"))
        out = []
        for start in range(0, len(asks), CHUNK):
            mine = asks[start : start + CHUNK]
            held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for at in range(0, len(ids), CHUNK):
                among = ids[at : at + CHUNK]
                score = np.round(q[start : start + CHUNK] @ v[at : at + CHUNK].T, 6)
                score[mine[:, None] == among] = -np.inf
                most = min(k, len(among))
                i, j = np.nonzero((score >= -np.partition(-score, most - 1, axis=1)[:, most - 1 : most]) & (score > -np.inf))
                held = tuple(np.concatenate(p) for p in zip(held, (i, among[j], score[i, j]), strict=True))
                order = np.lexsort((held[1], -held[2], held[0]))
                held = tuple(p[order] for p in held)
                first = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k
                held = tuple(p[first] for p in held)
            out.append((mine[held[0]], held[1], held[2]))
        return pa.Table.from_arrays([pa.array(np.concatenate(p)) for p in zip(*out, strict=True)], schema=kind)

    return run


@dataclass
class VectorIndex:
    """Vectors in the lists of their nearest centroids. A list of very many vectors is several parts."""

    centroids: np.ndarray
    probes: int
    rows: DataFrame
    parts: np.ndarray
    sampled_recall: dict[int, float] = field(default_factory=dict)


def _recalls(sample: np.ndarray, centroids: np.ndarray, k: int, queries: int) -> dict[int, float]:
    """Share of the sample's true k nearest that lie in the p nearest lists, for each p."""
    home = np.argmax(sample @ centroids.T, axis=1)
    asked = sample[:queries]
    score = asked @ sample.T
    np.fill_diagonal(score, -np.inf)
    near = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    order = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    needed = np.take_along_axis(order, home[near], 1)
    return {p: float((needed < p).mean()) if needed.size else 1.0 for p in range(1, len(centroids) + 1)}


def vector_index(vectors: DataFrame, k: int = 5, recall: float = 0.97, lists: int | None = None, most_learnt: int = 20_000, part_rows: int = 65_536, most_lists: int = 4096) -> VectorIndex:
    """An index of all rows (vec_id, v) for cosines; rows without a vector, or with one of length 0, which has no cosine, aren't in it.

    Centroids, about the root of the number of rows, are fitted on at most most_learnt rows, those with the smallest hash of their id; every row is put
    in the list of its nearest one. How many lists a search probes is measured on the same sample: the fewest that hold `recall` of the true neighbours
    of 256 of its rows. Rows lie closer in the whole table than in a sample of it, so a search of the table finds no smaller a share.
    """
    ship(vectors.sparkSession)
    whole = vectors.select("vec_id", F.col("v").cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    n = whole.count()
    drawn = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most_learnt)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    drawn = cut(drawn.select("vec_id", F.transform("v", lambda x: x / size).alias("v")).repartition(8))
    k_lists = max(1, min(lists or math.ceil(math.sqrt(n)), most_lists, n))
    if n:
        model = KMeans(k=k_lists, seed=7, maxIter=10, featuresCol="f").fit(drawn.select(array_to_vector("v").alias("f")))
        centroids = np.array(model.clusterCenters())
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        sample = np.array([r.v for r in drawn.orderBy(F.xxhash64("vec_id"), "vec_id").collect()])
    else:
        centroids, sample = np.zeros((0, 0)), np.zeros((0, 0))
    found = _recalls(sample, centroids, k, min(256, len(sample))) if n else {}
    probes = min((p for p, share in found.items() if share >= recall or p == len(centroids)), default=0)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home = np.argmax(units(batch.column("v")) @ centroids.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], ["vec_id", "v", "list"])

    rows = cut(whole.mapInArrow(put, "vec_id long, v array<double>, list int"))
    parts = np.ones(len(centroids), np.int64)
    for r in rows.groupBy("list").count().collect():
        parts[r["list"]] = math.ceil(r["count"] / part_rows)
    table_ = rows.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(parts)], "list int, parts int")
    dealt = rows.join(F.broadcast(table_), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    return VectorIndex(centroids, probes, dealt, parts, found)


def search(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int | None = None, block: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, cosine): the k nearest of each query (query_id, q) in the lists probed, by exact cosines, ties by smaller id.

    Probing all lists is exact. A query goes to each part of its lists, with what that part finds merged in the end; queries come in blocks, so a
    group holds a bounded number of either. A query isn't its own neighbour; one without a vector, or of length 0, has none.
    """
    many, centroids, parts = min(probes or index.probes, len(index.centroids)), index.centroids, index.parts
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).filter(F.col("q").isNotNull() & F.exists("q", lambda x: x != 0))
    blocks = max(1, math.ceil(asked.count() / block))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not many:
                continue
            near = np.argsort(-(units(batch.column("q")) @ centroids.T), axis=1, kind="stable")[:, :many]
            row, lists = np.repeat(np.arange(len(near)), near.shape[1]), near.reshape(-1)
            times = parts[lists]
            at = np.repeat(np.arange(len(lists)), times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            rows = pa.Table.from_batches([batch]).take(pa.array(row[at]))
            yield from rows.append_column("list", pa.array(lists[at].astype(np.int32))).append_column("part", pa.array(part.astype(np.int32))).to_batches(max_chunksize=10_000)

    left = asked.mapInArrow(ask, "query_id long, q array<double>, list int, part int").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    right = index.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("list", "part", "block")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_of_list(k), "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")


def q_j16_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of every vector whose id is divisible by 100, by the index."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return search(vector_index(rows), rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))


def q_j16_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every list probed, which is exact."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    index = vector_index(rows)
    return search(index, rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), probes=len(index.centroids))


QUERIES = {"J16_index": q_j16_index, "J16_index_all": q_j16_all}
ORACLES = {
    "J16_index_all": """with p as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as cosine from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0)
select query_id, rank, vec_id, cosine from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from p) where rank <= 5""",
}
