"""Sources and sinks: seeds, JSON lines, vendor payloads, pages, exports."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.merges import keyed_merge
from millrace.plans.projections import table
from millrace.session import ship
from millrace.streaming.events import shared_folder


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """A CSV seed with a header, under a schema."""
    return spark.read.csv(path, header=True, schema="name string, platform string, slug string")


def companies(rows: DataFrame) -> DataFrame:
    """Trimmed names that aren't empty, overlong or without a letter or digit; one row per name without regard to case."""
    name = F.trim("name")
    good = rows.withColumn("name", name).filter((name != "") & (F.char_length(name) <= 200) & name.rlike("[A-Za-z0-9]"))
    return good.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name"), F.max("platform").alias("platform"), F.max("slug").alias("slug"))


def q_s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as a CSV seed, read back and merged into the customers' companies."""
    path = shared_folder(spark, "seed")
    seed = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("name"), F.when(F.col("s_nationkey") < 12, "greenhouse").alias("platform"), F.lower("s_name").alias("slug"))
    seed.write.csv(path, header=True)
    there = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("platform"), F.lower("c_name").alias("slug"))
    there = there.unionByName(seed.filter(F.col("name").endswith("1 ")).withColumn("platform", F.lit("lever")))
    return keyed_merge(companies(there), companies(read_seed(spark, path)), ["key"], "coalesce").select("key", "name", "platform")


def q_s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON-lines log with broken lines, which are skipped, and a time cut-off."""
    path = shared_folder(spark, "log")
    line = F.when(F.col("event_id") % 50 == 0, F.lit('{"event_id": broken')).otherwise(F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), "event_type")))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    rows = spark.read.json(path, schema="event_id long, ts timestamp_ntz, event_type string", mode="DROPMALFORMED")
    return rows.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def q_s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message batches to postings: headers parted from bodies, one row per body line that reads like one; errors in a side column."""
    head = F.concat(F.lit("From: "), F.col("role"), F.lit("@mail.example\nSubject: digest\n\n"))
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 9 == 0, F.col("text")).otherwise(F.concat(head, F.col("text"))).alias("raw"))
    sender = F.regexp_extract("raw", r"^From: (\S+)@", 1)
    body = F.regexp_replace("raw", r"^(?:[A-Za-z-]+: [^\n]*\n)+\n", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.char_length(F.trim(x)) > 0)
    rows = raw.select(F.when(sender != "", sender).alias("sender"), F.size(lines).alias("jobs"))
    return rows.groupBy("sender").agg(F.count(F.lit(1)).alias("messages"), F.sum("jobs").alias("jobs"), F.count_if(F.col("sender").isNull()).alias("errors"))


def q_s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor payloads of two shapes read by alias paths and exploded; a page holds at most 50 jobs."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").withColumn("page", F.floor((F.row_number().over(w) - 1) / 50))
    a, b = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")), F.struct(F.col("o_orderkey").alias("jobId"), F.col("o_orderpriority").alias("name"))
    jobs = orders.groupBy("o_custkey", "page").agg(F.collect_list(a).alias("x"), F.collect_list(b).alias("y"))
    payload = jobs.select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.struct(F.col("x").alias("jobs")))).otherwise(F.to_json(F.struct(F.struct(F.col("y").alias("items")).alias("data")))).alias("json"))
    kind = "jobs array<struct<id: long, title: string>>, data struct<items: array<struct<jobId: long, name: string>>>"
    parsed = payload.withColumn("p", F.from_json("json", kind))
    same = F.coalesce(F.col("p.jobs"), F.transform("p.data.items", lambda i: F.struct(i["jobId"].alias("id"), i["name"].alias("title"))))
    return parsed.select("o_custkey", F.explode(same).alias("j")).select("o_custkey", F.col("j.id").alias("id"), F.col("j.title").alias("title"))


class _Text(HTMLParser):
    """Visible text: no scripts or styles, blocks on lines of their own, repeated blocks once."""

    BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def visible(html: str | None) -> str:
    reader = _Text()
    reader.feed(html or "")
    reader.close()
    lines = (" ".join(line.split()) for line in "".join(reader.parts).split("\n"))
    return "\n".join(dict.fromkeys(line for line in lines if line))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, text) by an HTML reader in Arrow batches, as no built-in function parses HTML."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([visible(h.as_py()) for h in batch.column("html")], pa.string())], ["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string")


def q_x22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def q_s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and title of each page by expressions; script blocks counted."""
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).alias("links"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<script")).alias("scripts"))


def q_s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's whole slice as one JSON document."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    return rows.select("c_custkey", F.to_json(F.struct("c_name", F.coalesce("orders", F.array().cast("array<bigint>")).alias("orders"))).alias("export"))


QUERIES = {"S02_seed": q_s02, "S03_json_lines": q_s03, "S04_messages": q_s04, "S06_payloads": q_s06, "S08_pages": q_s08, "S11_export": q_s11, "X22_page_text": q_x22}
ORACLES = {
    "S02_seed": """with s as (select trim(s_name) as name, case when s_nationkey < 12 then 'greenhouse' end as platform from supplier),
c as (select c_name as name, null::varchar as platform from customer union all select name, 'lever' from s where name like '%1'), a as (select lower(name) as key, min(name) as name, max(platform) as platform from c group by 1),
b as (select lower(name) as key, min(name) as name, max(platform) as platform from s group by 1)
select coalesce(a.key, b.key) as key, coalesce(b.name, a.name) as name, coalesce(b.platform, a.platform) as platform from a full outer join b on a.key = b.key""",
    "S03_json_lines": "select event_type, count(*) as n from events where event_id % 50 <> 0 and date_trunc('second', ts) >= timestamp '2024-01-10' group by 1",
    "S04_messages": r"""select case when conv_id % 9 <> 0 then role end as sender, count(*) as messages, sum(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)))::bigint as jobs, count(*) filter (conv_id % 9 = 0) as errors from conversations group by 1""",
    "S06_payloads": "select o_custkey, o_orderkey as id, o_orderpriority as title from orders",
    "S08_pages": """select page_id, len(regexp_extract_all(html, 'href="([^"]*)"'))::int as links, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '<script'))::int as scripts from pages""",
    "S11_export": """with o as (select o_custkey, list(o_orderkey order by o_orderkey) as orders from orders group by 1)
select c_custkey, '{"c_name":"' || c_name || '","orders":[' || coalesce(array_to_string(orders, ','), '') || ']}' as export from customer left join o on c_custkey = o_custkey""",
}
