"""State by key over the event log with timers: a limiter that judges each call, notification keys that fire once.

Both are decisions in the order of event time, each depending on those before it. Rows wait in their key's state until the watermark has passed them, then a timer
decides them in order of (moment, id), so that batches and restarts don't change the result; rows that come later than the watermark are dropped by the engine.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import ship
from millrace.streaming.events import shared_folder, stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = "array<struct<us: bigint, event_id: bigint, kind: string, cost: bigint>>"
DAY, MINUTE = 86_400_000_000, 60_000_000


class InOrder:
    """Holds a key's rows back until the watermark passes them and then decides them one by one.

    A key's state is one row: the rows that wait, and the memory that earlier decisions left. It comes and goes with the batch of its key's rows, so that a key
    costs no calls of its own to the store.
    """

    def __call__(self, key: Any, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, kept = ([tuple(r) for r in part] for part in state.get) if state.exists else ([], [])
        for chunk in rows:
            waiting.extend(zip(*(chunk[c].tolist() for c in ("us", "event_id", "kind", "cost")), strict=True))
        until = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        at = bisect_left(waiting, (until,))
        ready, rest = waiting[:at], waiting[at:]
        out = []
        for row in ready:
            verdict, kept = self.decide(kept, row)
            out.append((row[1], verdict))
        state.update((rest, kept))
        if rest:
            state.setTimeoutTimestamp(rest[0][0] // 1000)
        if out:
            ids, verdicts = zip(*out, strict=True)
            yield pd.DataFrame({"user_id": key[0], "event_id": ids, "verdict": verdicts})

    def decide(self, kept: list[tuple], row: tuple) -> tuple[str, list[tuple]]:
        raise NotImplementedError


class Limiter(InOrder):
    """Admits a call unless its user's admitted spend of the last day, or admitted calls of its kind in the last minute or day, have reached their caps.

    Only admitted calls are remembered, for a day, so memory holds at most the day's cap of each kind.
    """

    def __init__(self, spend: int, minute: int, day: int) -> None:
        self.caps = spend, minute, day

    def decide(self, kept: list[tuple], row: tuple) -> tuple[str, list[tuple]]:
        kept = [r for r in kept if r[0] >= row[0] - DAY]
        same = [r[0] for r in kept if r[2] == row[2]]
        spend, minute, day = self.caps
        if sum(r[3] for r in kept) >= spend:
            return "spend", kept
        if sum(at >= row[0] - MINUTE for at in same) >= minute:
            return "minute", kept
        return ("day", kept) if len(same) >= day else ("admitted", [*kept, row])


class FireOnce(InOrder):
    """A key fires unless it is among the last `cap` keys that did; being asked again doesn't renew it."""

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def decide(self, kept: list[tuple], row: tuple) -> tuple[str, list[tuple]]:
        return ("silent", kept) if any(r[2] == row[2] for r in kept) else ("fired", [*kept, row][-self.cap :])


def decided(events: DataFrame, by: InOrder, delay: str = "1 day") -> DataFrame:
    """(user_id, event_id, verdict) of a stream of events with `ts`, as the watermark passes them; rows without a user or moment take no part."""
    ship(events.sparkSession)
    cost = F.coalesce(F.round(F.col("value") * 100).cast("long"), F.lit(0))
    rows = events.filter("ts is not null and user_id is not null").withWatermark("ts", delay)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", F.coalesce("event_type", F.lit("")).alias("kind"), cost.alias("cost"))
    return rows.groupBy("user_id").applyInPandasWithState(by.__call__, "user_id long, event_id long, verdict string", f"waiting {ROW}, memory {ROW}", "append", GroupStateTimeout.EventTimeTimeout)


def run(rows: DataFrame, out: str) -> DataFrame:
    """The stream run over what is there now, into and from a folder that also keeps its state; run again, it goes on where it ended."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


def q_t05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(decided(stream(spark, sf_dir, "events"), Limiter(20_000, 1, 2)), shared_folder(spark, "limits"))


def q_t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(decided(stream(spark, sf_dir, "events"), FireOnce(3)), shared_folder(spark, "capped"))


_SEEN = """e as (select user_id, event_id, event_type as kind, epoch_us(ts) as us, round(value * 100)::bigint as cost, row_number() over (partition by user_id order by ts, event_id) as k
  from events where epoch_us(ts) < (select (epoch_ms(max(ts)) - 86400000) * 1000 from events))"""

QUERIES = {"T03_capped_keys": q_t03, "T05_limits": q_t05}
ORACLES = {
    "T03_capped_keys": f"""with recursive {_SEEN}, r as (
select user_id, 0::bigint as k, 0::bigint as event_id, '' as verdict, []::varchar[] as kept from (select distinct user_id from e)
union all select e.user_id, e.k, e.event_id, case when list_contains(kept, kind) then 'silent' else 'fired' end,
  case when list_contains(kept, kind) then kept when len(kept) < 3 then list_append(kept, kind) else list_append(kept[2:], kind) end from r join e on e.user_id = r.user_id and e.k = r.k + 1)
select user_id, event_id, verdict from r where k > 0""",
    "T05_limits": f"""with recursive {_SEEN}, r as (
select user_id, 0::bigint as k, 0::bigint as event_id, '' as verdict, []::struct(us bigint, kind varchar, cost bigint)[] as kept from (select distinct user_id from e)
union all select user_id, k, event_id, verdict, case verdict when 'admitted' then list_append(day, struct_pack(us := us, kind := kind, cost := cost)) else day end from (
  select *, case when coalesce(list_sum(list_transform(day, lambda x: x.cost)), 0) >= 20000 then 'spend' when len(list_filter(day, lambda x: x.kind = kind and x.us >= us - 60000000)) >= 1 then 'minute'
    when len(list_filter(day, lambda x: x.kind = kind)) >= 2 then 'day' else 'admitted' end as verdict from (
    select e.*, list_filter(r.kept, lambda x: x.us >= e.us - 86400000000) as day from r join e on e.user_id = r.user_id and e.k = r.k + 1)))
select user_id, event_id, verdict from r where k > 0""",
}
