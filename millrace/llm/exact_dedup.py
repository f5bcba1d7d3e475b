"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]. Of equal texts the row
with the most code points in the original text stays, then the one with the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, row_key, split_join, table, texts, without


def squeezed(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _again(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys another row has as well; counted with partial sums, joined back with a split of hot keys."""
    several = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return split_join(rows, several, keys, "left_semi")


def _best(*more: str) -> Column:
    """Of equal texts the longest, then the smallest id, a null id last; ids are turned by their bits, which can't overflow."""
    return F.max(F.struct("chars", F.bitwise_not("doc_id").alias("turned"), *more))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are refined in three steps, each only among the survivors of the one before: equal normalised
    length, equal hash of the first `prefix` characters, equal SHA-256 of the whole. The hash of every text is a column
    of this result, so the one scan of texts takes it along; its rows of a few numbers are cut, and no text moves or
    is read again. (keep_first, which returns no hashes, reads only survivors' contents.) A group with a third of all rows
    is spread over tasks.

    Null text counts as empty; empty texts are equal to each other; rows with one doc_id are counted as rows and those as
    long as the longest share a verdict; a row with a null id stays only where no row of its length has an id; very long
    texts cost one hash; an empty table gives an empty result; other columns are ignored.
    """
    scan = texts(docs, id_col, text_col).select("doc_id", F.char_length("text").alias("chars"), squeezed(F.col("text")).alias("t"))
    keyed = cut(scan.select(
        "doc_id", "chars", F.char_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("head"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256")
    ))
    rough = _again(_again(keyed.select("len", "head"), "len"), "len", "head").distinct()
    left = split_join(keyed, rough, ["len", "head"], "left_semi")
    groups = left.groupBy("len", "head", "text_sha256").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    out = split_join(keyed, groups, ["len", "head", "text_sha256"])
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.bitwise_not(F.col("best.turned")))
    kept = alone | keep.eqNullSafe(F.col("doc_id")) & (F.col("chars") == F.col("best.chars"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 128, most: int = 500_000) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts one row, also where ids are null or repeated.

    The row is chosen as by exact_groups, a null id last; among rows of one id and length the row key decides. Whole
    contents are hashed only for rows that share length and prefix hash with another: up to `most` such pairs of keys
    (16 MB) are broadcast to the scan, more are joined with the rows' keys, so that texts don't move either way.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(row_key(docs).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.char_length(text).alias("chars"), squeezed(text).alias("t"))
    lengths = ("row", F.char_length("t").alias("len"), F.xxhash64(F.substring("t", 1, prefix)).alias("head"))
    rough = cut(_again(_again(rows.select(*lengths).select("len", "head"), "len"), "len", "head").distinct())
    keyed = rows.select(*lengths, "doc_id", "chars", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))
    if rough.count() <= most:
        left = rows.select("*", *lengths[1:]).join(F.broadcast(rough), ["len", "head"], "left_semi").select("row", "doc_id", "chars", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))
    else:
        left = split_join(keyed, rough, ["len", "head"], "left_semi")
    left = cut(left)
    groups = left.groupBy("text_sha256").agg(_best("row").getField("row").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return without(docs, split_join(left, groups, ["text_sha256"], "inner").filter("row <> best").select("row"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = {
    "op5_exact_dedup": r"""
with t as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents),
g as (
  select *, first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id,
         count(*) over (partition by text_sha256) as group_size
  from t)
select doc_id, keep_id, group_size, keep_id = doc_id as kept, text_sha256 from g
"""
}
