"""Mailboxes as a streaming source with a cursor of validity and uid."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.plans.projections import table
from millrace.session import ship
from millrace.streaming.events import shared_folder

BLOCK = 1000
#: Width of the blocks of mailboxes that share their uids, so that a block still holds thousands of messages of each.
SHARED_BLOCK = 250_000


@dataclass
class Range(InputPartition):
    """Messages first..last of one mailbox, in the blocks that hold them."""

    mailbox: str
    validity: int
    first: int
    last: int
    folders: tuple[str, ...]


class Mailboxes(DataSource):
    """Folders mailbox=M/validity=V/block=B of JSON lines {uid, raw}; a block holds the uids of one width.

    Only the largest validity of a mailbox can be read. Options: path, any file system that Arrow knows; most, how many blocks a partition reads; block,
    the width that the store was written with, BLOCK by default. A store has about one file a block and arrival, so narrow blocks of thin mailboxes are many small files.
    """

    @classmethod
    def name(cls) -> str:
        return "mailboxes"

    def schema(self) -> str:
        return "mailbox string, validity long, uid long, raw string"

    def streamReader(self, schema) -> MailboxReader:
        return MailboxReader(self.options)


class MailboxReader(DataSourceStreamReader):
    """Offsets are {mailbox: [validity, uid]}: all messages up to that uid of that validity have been handed out.

    A batch reads what lies above the uid within the same validity, and all of a new validity. Ranges are planned from the offsets alone, so a batch that is run again reads the
    same messages; what arrives late below the uid isn't read, as a mailbox numbers its messages in order.
    """

    def __init__(self, options: dict):
        self.path, self.most, self.block = options["path"], int(options.get("most", 16)), int(options.get("block", BLOCK))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def _numbers(self, store, folder: str, name: str) -> dict:
        """Sub-folders name=value by value."""
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.base_name.split("=", 1)[1]: f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{name}=")}

    def _files(self, store, folder: str) -> list[str]:
        from pyarrow import fs

        return sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and f.base_name[0] not in "._")

    def _messages(self, store, files: list[str]) -> Iterator[dict]:
        for file in files:
            with store.open_input_stream(file) as stream:
                yield from (json.loads(line) for line in io.TextIOWrapper(stream, "utf-8", newline="\n") if line != "\n")  # JSON keeps other line ends as they are

    def _live(self, store, folder: str) -> tuple[int, dict[int, str]] | None:
        """The validity that can be read now, and its blocks."""
        all_ = {int(v): path for v, path in self._numbers(store, folder, "validity").items()}
        if not all_:
            return None
        return max(all_), {int(b): path for b, path in self._numbers(store, all_[max(all_)], "block").items()}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = self._store()
        out = {}
        for mailbox, folder in self._numbers(store, root, "mailbox").items():
            live = self._live(store, folder)
            if live and live[1]:
                # Uids rise with their blocks, so only the last one is opened.
                out[mailbox] = [live[0], max((m["uid"] for m in self._messages(store, self._files(store, live[1][max(live[1])]))), default=0)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        store, root = self._store()
        out = []
        for mailbox, (validity, last) in sorted(end.items()):
            known, water = start.get(mailbox, (None, 0))
            first = water + 1 if known == validity else 1
            if first > last:
                continue
            blocks = self._numbers(store, f"{root}/mailbox={mailbox}/validity={validity}", "block")
            wanted = sorted((int(b), path) for b, path in blocks.items() if first // self.block <= int(b) <= last // self.block)
            for at in range(0, len(wanted), self.most):
                out.append(Range(mailbox, validity, first, last, tuple(path for _, path in wanted[at : at + self.most])))
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = self._store()
        for message in self._messages(store, [f for folder in partition.folders for f in self._files(store, folder)]):
            # A range is asked for by its ends, which a store may clamp to the nearest message: what lies outside is left.
            if partition.first <= message["uid"] <= partition.last:
                yield partition.mailbox, partition.validity, message["uid"], message["raw"]


def store_messages(rows: DataFrame, path: str, block: int = BLOCK) -> None:
    """Append messages (mailbox, validity, uid, raw) to a store of mailboxes with blocks of that width."""
    laid = rows.withColumn("block", F.floor(F.col("uid") / block)).repartition("mailbox", "validity", "block")
    laid.select("mailbox", "validity", "block", "uid", "raw").write.mode("append").partitionBy("mailbox", "validity", "block").json(path)


def read_mailboxes(spark: SparkSession, path: str, out: str, most: int = 16, block: int = BLOCK) -> DataFrame:
    """Take what is new since the last call with the same `out` folder, and return all messages taken so far.

    The cursor lies in the checkpoint of the stream, rows in a folder with a commit log, so a run that is broken off and repeated neither loses
    nor doubles a message.
    """
    ship(spark)
    spark.dataSource.register(Mailboxes)
    rows = spark.readStream.format("mailboxes").option("path", path).option("most", most).option("block", block).load()
    query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("mailbox string, validity long, uid long, raw string").parquet(f"{out}/rows")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of sixteen mailboxes, ten days to a validity, arriving in two rounds; the second brings late, lower uids too, and half the mailboxes a new validity."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("mailbox"), F.floor(F.dayofyear("ts") / 10).alias("validity"), F.col("event_id").alias("uid"), F.concat_ws(" ", "event_type", "props").alias("raw"))
    newest = rows.groupBy("mailbox").agg(F.max("validity").alias("newest"))
    second = (F.col("uid") % 3 == 0) | ((F.col("mailbox") % 2 == 1) & (F.col("validity") == F.col("newest")))
    return rows.join(F.broadcast(newest), "mailbox").withColumn("round", F.when(second, 2).otherwise(1)).drop("newest")


def two_rounds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(messages, what was taken with its round): the mailboxes are read after each round of arrivals, and once more."""
    messages, path, out = event_messages(spark, sf_dir), shared_folder(spark, "mail"), shared_folder(spark, "taken")
    store_messages(messages.filter("round = 1").drop("round"), path, SHARED_BLOCK)
    first = read_mailboxes(spark, path, out, block=SHARED_BLOCK).select("mailbox", "validity", "uid").withColumn("seen", F.lit(True))
    kept = shared_folder(spark, "first")
    first.write.parquet(kept)
    store_messages(messages.filter("round = 2").drop("round"), path, SHARED_BLOCK)
    read_mailboxes(spark, path, out, block=SHARED_BLOCK)
    taken = read_mailboxes(spark, path, out, block=SHARED_BLOCK)
    return messages, taken.join(spark.read.parquet(kept), ["mailbox", "validity", "uid"], "left").withColumn("taken_in", F.when(F.col("seen"), 1).otherwise(2))


def q_s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = two_rounds(spark, sf_dir)[1]
    return taken.groupBy(F.col("mailbox").cast("long").alias("mailbox"), "taken_in", "validity").agg(F.count(F.lit(1)).alias("read"), F.min("uid").alias("first"), F.max("uid").alias("last"))


def q_t06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mailbox's cursor at the end, and how many of its messages were read, came late below the cursor, or lay in a validity that was gone."""
    messages, taken = two_rounds(spark, sf_dir)
    cursor = taken.groupBy(F.col("mailbox").cast("long").alias("mailbox")).agg(F.max(F.struct("validity", "uid")).alias("c"), F.count(F.lit(1)).alias("read"))
    there = messages.join(cursor, "mailbox", "left").join(taken.select(F.col("mailbox").cast("long").alias("mailbox"), "validity", "uid", "taken_in"), ["mailbox", "validity", "uid"], "left")
    unread = F.col("taken_in").isNull()
    late = unread & (F.col("validity") == F.col("c.validity")) & (F.col("uid") < F.col("c.uid"))
    out = there.groupBy("mailbox").agg(F.first("c").alias("c"), F.first("read").alias("read"), F.count_if(late).alias("late"), F.count_if(unread & ~late).alias("gone"))
    return out.select("mailbox", F.col("c.validity").alias("validity"), F.col("c.uid").alias("uid"), "read", "late", "gone")


_ROUNDS = """m as (select user_id % 16 as mailbox, dayofyear(ts) // 10 as validity, event_id as uid from events), d as (select *, max(validity) over (partition by mailbox) as newest from m),
r as (select *, case when uid % 3 = 0 or mailbox % 2 = 1 and validity = newest then 2 else 1 end as round from d),
one as (select *, max(validity) over (partition by mailbox) as live from r where round = 1), first as (select *, max(uid) over (partition by mailbox) as water from one where validity = live),
water as (select mailbox, max(live) as live, max(water) as water from first group by 1),
taken as (select mailbox, validity, uid, 1 as taken_in from first union all
  select r.mailbox, r.validity, uid, 2 from r left join water w on w.mailbox = r.mailbox where r.validity = r.newest and (w.live is null or w.live <> r.newest or uid > w.water))"""
QUERIES = {"S05_mailbox": q_s05, "T06_mail_cursor": q_t06}
ORACLES = {
    "S05_mailbox": f"with {_ROUNDS} select mailbox, taken_in, validity, count(*) as read, min(uid) as first, max(uid) as last from taken group by 1, 2, 3",
    "T06_mail_cursor": f"""with {_ROUNDS}, c as (select mailbox, max(validity) as validity, arg_max(uid, (validity, uid)) as uid, count(*) as read from taken group by 1)
select r.mailbox, c.validity, c.uid, c.read, count(*) filter (taken_in is null and r.validity = c.validity and r.uid < c.uid) as late, count(*) filter (taken_in is null and not (r.validity = c.validity and r.uid < c.uid)) as gone
from r left join c on c.mailbox = r.mailbox left join taken t on t.mailbox = r.mailbox and t.validity = r.validity and t.uid = r.uid group by 1, 2, 3, 4""",
}
