"""Sizes before broadcasts, and lineage cuts, for modules outside the optional subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(rows: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's spark.checkpoint.dir; where it is unset a local master takes a local folder, a cluster fails."""
    spark = rows.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return rows.checkpoint(eager=True)


def sent_whole(rows: DataFrame, most_bytes: int = 32_000_000) -> DataFrame:
    """The rows, cut from their lineage, and marked for broadcast if they hold at most most_bytes as text; else to be joined by key."""
    kept = cut(rows)
    size = kept.agg(F.sum(F.octet_length(F.to_json(F.struct(*kept.columns))))).first()[0] or 0
    return F.broadcast(kept) if size <= most_bytes else kept


def placed(rows: DataFrame, keys: list[str], order: list, partitions: int = 64) -> DataFrame:
    """The rows with `place`, their rank from 0 within equal keys by `order`, and `of`, how many these are.

    Sorted by range over all keys, so one hot key is many partitions and no window gathers it; only a count for each key and partition it touches is
    summed up. Rows equal in keys and order are placed in any order; null keys are a key.
    """
    names = [F.col(k) for k in keys]
    laid = cut(rows.repartitionByRange(partitions, *names, *order).sortWithinPartitions(*names, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    parts = laid.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by_part = Window.partitionBy(*keys).orderBy("_part")
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), (F.sum("_n").over(by_part) - F.col("_n") - F.col("_first")).alias("_offset"), F.sum("_n").over(Window.partitionBy(*keys)).alias("of"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = laid.join(sent_whole(parts), on).withColumn("place", F.col("_at") + F.col("_offset"))
    return out.drop("_at", "_part", "_p", "_offset", *[f"_k{i}" for i in range(len(keys))])
