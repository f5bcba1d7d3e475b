"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is cut into blocks, each block is compressed with either dictionary, and the difference of the compressed
sizes, divided by the text's own size, tells which kind of text it is more like. Blocks keep the dictionaries in play over the
whole of a long text, which would otherwise soon be compressed by its own beginning. An isotonic fit on labelled
texts that the dictionaries haven't seen makes the difference a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, table, texts

#: Added to a text's size, so that the difference of a few bytes of a very short text says little.
DAMP = 50


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary(samples: list[bytes], size: int) -> tuple[bytes, bool]:
    """Content of a dictionary of about `size` bytes, and whether it is a trained one.

    The trainer refuses samples that are too few or too short; their own last bytes are then the dictionary.
    """
    try:
        return zstandard.train_dictionary(size, samples).as_bytes(), True
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:], False


@lru_cache(maxsize=4)
def compressor(content: bytes, trained: bool, level: int) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    known = zstandard.ZstdCompressionDict(content, dict_type=kind)
    known.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: bytes, bad: zstandard.ZstdCompressor, good: zstandard.ZstdCompressor, size: int) -> float:
    """Bytes that the good dictionary saves against the bad one, per byte of text."""
    saved = 0
    for block in blocks(text, size):
        saved += len(bad.compress(block)) - len(good.compress(block))
    return saved / (len(text) + DAMP)


def with_difference(rows: DataFrame, bad: tuple[bytes, bool], good: tuple[bytes, bool], level: int, block: int) -> DataFrame:
    """The rows with `difference` of their text in its place; one narrow pass."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressor(*bad, level), compressor(*good, level)
        for batch in batches:
            found = [difference(text.as_py().encode(), *pair, block) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(found, pa.float64())], [*others, "difference"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in others), "difference double"]))


def learnt_dictionaries(sample: DataFrame, size: int, most_bytes: int, block: int) -> list[tuple[bytes, bool]]:
    """Dictionaries of label 0 and label 1, from texts of each in hash order as far as most_bytes go.

    Sizes of the bounded sample's rows are summed in that order, so that what comes to the driver is bounded in bytes.
    """
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sample.groupBy("label", "doc_id").agg(F.sum(F.octet_length("text")).alias("size"))
    within = sizes.withColumn("_upto", F.sum("size").over(order)).filter(F.col("_upto") <= most_bytes).select("doc_id", "_upto")
    # Ids and sizes alone are put in order, a row for each learnt document; texts stay where they lie.
    taken = sample.join(F.broadcast(within), "doc_id")
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for row in taken.select("label", "text").orderBy("label", "_upto", "text").collect():
        found[row.label] += blocks(row.text.encode(), block)
    return [dictionary(found[label], size) for label in (0, 1)]


def compression_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7, most_learnt: int = 20_000, most_bytes: int = 8_000_000, size: int = 65_536, level: int = 3, block: int = 1000
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from at most most_learnt labelled rows that aren't held out, those with the smallest hash of their id, and of these
    from at most most_bytes of text of each label for the dictionaries; a quarter of the rows calibrates. The bounds make the sample safe to
    broadcast by id and to train on in one place; every whole text is scored, in a narrow pass, by its text alone.
    Null texts count as empty; empty texts get the score that the fit gives a difference of 0. Null labels aren't learnt from, labels other
    than 0 count as 1, of a document's several labels the largest counts. With one class or no labels every score is the share of good rows seen.
    Rows without an id are scored and aren't held out; repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") != 0).cast("int").alias("label")).dropna().filter(~held_out())
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_learnt)
    calibrates = F.crc32(F.concat(F.lit("fold:"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0
    sample = cut(rows.join(F.broadcast(chosen), "doc_id").withColumn("calibrates", calibrates))
    seen = {(r.label, r.calibrates): r.n for r in sample.groupBy("label", "calibrates").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = rows.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    taught = [seen.get((label, False), 0) for label in (0, 1)]
    if not all(taught):
        good = sum(n for (label, _), n in seen.items() if label)
        share = good / max(1, sum(seen.values()))
        return out.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= least)).alias("predicted"))
    bad, good = learnt_dictionaries(sample.filter(~F.col("calibrates")), size, most_bytes, block)
    fold = sample.filter("calibrates") if any(calibrating for _, calibrating in seen) else sample
    # A few thousand pairs of numbers at most; they are gathered after their differences were taken where the sample lies.
    pairs = cut(with_difference(fold.select("doc_id", "label", "text"), bad, good, level, block).select("difference", F.col("label").cast("double").alias("label")).coalesce(8))
    model = IsotonicRegression(featuresCol="difference", labelCol="label").fit(pairs)
    at, rate = np.array(model.boundaries.toArray()), np.array(model.predictions.toArray())

    def calibrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("difference").to_numpy(zero_copy_only=False)
            # Within a step of the fit the differences' own order is kept by a small share of it.
            score = 0.98 * np.interp(x, at, rate) + 0.02 / (1 + np.exp(-40 * np.clip(x, -1, 1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return with_difference(out, bad, good, level, block).mapInArrow(calibrated, "doc_id long, held_out boolean, score double, predicted int")


def op13_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
