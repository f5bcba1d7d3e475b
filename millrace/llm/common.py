"""What the operators of this subpackage share: reading, slabs, safe joins and lineage cuts."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship

#: ASCII white space, the separator of words in every contract here.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns are dropped before anything moves."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def packed(docs: DataFrame, id_col: str) -> DataFrame:
    """(k, r): the id, and the whole row as one struct, so that no column of the documents can clash with an operator's."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))


def row_key(docs: DataFrame, seed: int | None = None) -> Column:
    """A 64-bit hash of the whole row, nulls in their places: what a row is named by where ids are null or repeated. A seed gives another such hash."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return F.xxhash64(*([] if seed is None else [F.lit(seed)]), *cols, *[c.isNull() for c in cols])


def without(docs: DataFrame, gone: DataFrame, most: int = 500_000) -> DataFrame:
    """The documents whose row key isn't in the one column of gone, equal rows once.

    The keys are counted: up to `most` of them (two longs a key at most half full, so 16 MB) go to every task and no
    document moves; more are joined by key. Only rows that occur again in every column are gathered, by partial aggregates.
    Rows are equal if two hashes agree, 128 bits; a key that different rows share names none of them, so all of these stay.
    """
    def few(keys: DataFrame) -> tuple[DataFrame, int]:
        keys = cut(keys.toDF("k").distinct())
        n = keys.count()
        return (F.broadcast(keys) if n <= most else keys), n

    other = row_key(docs, 1)
    counts = docs.select(row_key(docs).alias("k"), other.alias("h")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).filter("n > 1")
    counts = cut(counts.select("k", (F.col("a") != F.col("b")).alias("shared")))
    again, n_again = few(counts.select("k"))
    shared = counts.filter("shared").select("k")
    rows = docs.select(row_key(docs).alias("k"), other.alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    named = gone.toDF("k").distinct()
    rows = rows.join(few(named.join(shared, "k", "left_anti") if n_again else named)[0], "k", "left_anti")
    if not n_again:
        return rows.select("r.*")
    several = rows.join(again, "k", "left_semi").groupBy("k", "h").agg(F.first("r").alias("r"))
    return rows.join(again, "k", "left_anti").select("r").unionByName(several.select("r")).select("r.*")


def slabs_for(docs: DataFrame, slab_bytes: int, least: int = 64) -> int:
    """How many slabs of about slab_bytes of text the documents fill; one scan of lengths."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least, math.ceil(total / slab_bytes))


def slab(n: int, column: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; where it is unset a local master takes a local folder, a cluster fails."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, readable after an executor is lost."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def split_join(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Equi join with an aggregate over the same keys, in which a hot key of the left side can be split.

    An aggregate's output is already dealt out by its keys, so Spark would join it without an exchange,
    and then adaptive execution can't split a skewed partition. One more, derived key makes both sides
    exchange; the left side's hot partitions are then split at run time, or the right side is
    broadcast if it turns out small. Nulls in keys match nulls.
    """
    keys = list(keys)
    extra = F.xxhash64(*[F.col(k) for k in keys], F.lit(17))
    a, b = left.withColumn("_split", extra).alias("a"), right.withColumn("_split", extra).alias("b")
    on = F.col("a._split") == F.col("b._split")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    out = a.join(b, on, how)
    if how in ("left_semi", "left_anti"):
        return out.drop("_split")
    return out.select("a.*", *[F.col(f"b.{c}") for c in right.columns if c not in keys]).drop("_split")
