"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut, packed, split_join, table

WEIGHTS = (3, 1, 2)
SEED = "mix-1:"


def draw(id_col: str = "doc_id", seed: str = SEED) -> Column:
    """Uniform in [0, 1) from 52 bits of an MD5 over seed and id; the same on every run and engine."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, nulls last, get the weights in turn and share total times all sizes. No
    target exceeds most times its source's size; what is above is shared again by weight until none is. That
    is min(cap, level * weight) for one level, found by running sums in the order of cap / weight.
    The table has one row per source, so its ordering in one task is as small as the list of sources: some hundred bytes
    a source, tested with 100,000 of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.array(*[F.lit(w) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(turn, (rank - 1) % len(weights) + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumns({
        "capped_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        # As what is not before, since a frame that ends at the last row is summed anew for each row.
        "weight_left": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(total),
    })
    level = (F.col("budget") - F.col("capped_before")) / F.col("weight_left")
    # The level rises while sources are capped that it would overfill, and falls from then on: it is the largest.
    per = per.withColumn("level", F.max(level).over(Window.partitionBy()))
    share = F.least("cap", F.col("level") * F.col("weight"))
    return per.select("source", "source_size", share.alias("target"))


def _sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, source, size in words)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _copies(id_col: str) -> Column:
    """floor(rate) and one more if the draw is below the fraction."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return F.floor(rate) + (draw(id_col) < rate - F.floor(rate)).cast("long")


def mix_rates(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies.

    Size counts words; null texts have none, a null source is a source of its own, a source without words
    has target 0 and no copies. Rates are target / source_size; a document is taken floor(rate) times
    and once more if its draw is below the fraction. Reruns agree, repeated ids draw alike; a very long text counts
    whole; an empty table gives an empty result; columns besides these three are ignored, whatever their names.
    """
    sizes = cut(_sizes(docs, text_col, source_col, id_col))
    out = split_join(sizes, source_targets(sizes, weights, total, most), ["source"])
    return out.select("doc_id", "size", "source_size", "target", _copies("doc_id").alias("copies"))


def mixed(docs: DataFrame, most: int = 16 << 20, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns.

    How often a row is taken depends on its source's rate and its id alone, so the rates (a row per source, broadcast while
    they hold at most `most` bytes, else joined) meet the documents in their scan and no text moves. Null sources are a
    source, null ids draw alike, null and empty texts count no words but are taken like their source's others;
    repeated rows are taken alike; an empty table gives an empty result. A document taken no time goes.
    """
    rates = cut(source_targets(_sizes(docs, **{k: v for k, v in options.items() if k.endswith("_col")}), **{k: v for k, v in options.items() if not k.endswith("_col")}))
    bytes_held = rates.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    rows = packed(docs, options.get("id_col", "doc_id")).withColumn("source", F.col("r").getField(options.get("source_col", "source")).cast("string"))
    if bytes_held <= most:
        joined = rows.join(F.broadcast(rates.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "inner")
    else:
        joined = split_join(rows, rates, ["source"], "inner")
    copies = _copies("k").cast("int")
    return joined.select("r", copies.alias("copies")).filter("copies > 0").select("r", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("r.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_rates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = {
    "op2_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
p as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, source_size * 2.0::double as cap from p),
o as (
  select *,
    coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as capped_before,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as weight_left,
    sum(source_size) over () * 1.5::double as budget
  from w),
l as (select *, (budget - capped_before) / weight_left as own from o),
t as (
  select source, source_size, least(cap, lev * weight)::double as target
  from (select *, max(own) over () as lev from l)),
r as (
  select doc_id, size, source_size, target,
    case when source_size > 0 then target / source_size else 0.0 end as rate,
    ('0x' || substr(md5('mix-1:' || doc_id::varchar), 1, 13))::bigint::double / 4503599627370496.0 as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from r
"""
}
