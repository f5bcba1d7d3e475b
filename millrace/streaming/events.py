"""Structured Streaming over the event log: cursors, windows, fire-once keys, latest state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.projections import table


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder; where that is unset a local master takes a local one, a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-stream-")
    return f"{base}/stream-{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; zoneless moments become instants of the session's zone, for watermarks."""
    path = f"{sf_dir}/{name}.parquet"  # a file or a folder: as a pattern that matches just this name, the source takes both
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path[:-1] + "[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(rows: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Run the stream over what is there now, and read what it wrote.

    Without a key rows are appended, at least once, with a commit log, so reruns add nothing. With a key only rows that changed are written, each batch in a
    folder of its own that a retry overwrites, and of each key the row of the latest batch is read.
    """
    spark = rows.sparkSession
    out = shared_folder(spark, name)
    if key is None:
        query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{out}/rows")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.parquet(f"{out}/rows")
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("last")).select(key, "last.*")


def fetched(rows: DataFrame, since: int, limit: int = 200) -> DataFrame:
    """Rows behind a cursor in id order, bounded; the new high water is the largest id, or the old without rows."""
    return rows.filter(F.col("event_id") > since).orderBy("event_id").limit(limit)


def q_t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cursors over one log: one advances over all that is read, one only over what is processed."""
    rows = fetched(table(spark, sf_dir, "events"), 41)
    read, done = F.max("event_id"), F.max(F.when(F.col("event_type") != "error", F.col("event_id")))
    return rows.agg(F.coalesce(read, F.lit(41)).alias("read_to"), F.coalesce(done, F.lit(41)).alias("processed_to"), F.count(F.lit(1)).alias("n"))


def q_t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each notification key fires once; a key is forgotten 30 days of events later, which bounds the state."""
    keys = stream(spark, sf_dir, "events").select("ts", F.concat_ws(":", "event_type", (F.col("user_id") % 25).cast("string")).alias("key"))
    return finished(keys.withWatermark("ts", "30 days").dropDuplicatesWithinWatermark(["key"]).select("key"), "once")


def q_t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows that the watermark has passed, per kind."""
    rows = stream(spark, sf_dir, "events").withWatermark("ts", "1 day")
    out = finished(rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")), "tumbling")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def q_t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of calls, for a rolling limit."""
    rows = stream(spark, sf_dir, "events").withWatermark("ts", "1 day")
    out = finished(rows.groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count(F.lit(1)).alias("calls")), "sliding")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "calls", (F.col("calls") > 170).alias("limited"))


def q_t07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest sight and counts per user as keyed state; late and repeated sights don't move it back."""
    rows = stream(spark, sf_dir, "events")
    out = finished(rows.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_kind")), "latest", "user_id")
    return out.select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n", "last_kind")


QUERIES = {"T01_cursors": q_t01, "T03_fire_once": q_t03, "T04_tumbling": q_t04, "T05_sliding": q_t05, "T07_latest": q_t07}
ORACLES = {
    "T01_cursors": "with f as (select * from events where event_id > 41 order by event_id limit 200) select coalesce(max(event_id), 41) as read_to, coalesce(max(event_id) filter (event_type <> 'error'), 41) as processed_to, count(*) as n from f",
    "T03_fire_once": "select distinct event_type || ':' || (user_id % 25)::varchar as key from events",
    "T04_tumbling": """select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as value from events
group by 1, 2 having date_trunc('day', any_value(ts)) + interval 1 day <= (select max(ts) from events) - interval 1 day""",
    "T05_sliding": """with w as (select unnest([time_bucket(interval 6 hours, ts), time_bucket(interval 6 hours, ts) - interval 6 hours]) as start from events)
select start, count(*) as calls, count(*) > 170 as limited from w group by 1 having start + interval 12 hours <= (select max(ts) from events) - interval 1 day""",
    "T07_latest": "select user_id, max(ts) as last_seen, count(*) as n, arg_max(event_type, (ts, event_id)) as last_kind from events group by 1",
}
