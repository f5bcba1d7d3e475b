"""Substring dedup by hashing of lines: equal units meet by digest, the earliest stays, later ones are spans to remove."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, packed, split_join, table, texts

#: Sentences cover a text without a gap; a line ends with the sentence that holds a line feed.
SENTENCES = re.compile(r"[^\n.!?]+[.!?]*\n?|[\n.!?]+")
PARAGRAPHS = re.compile(r"(?:[^\n]|\n(?!\n))+\n*|\n+")


def _lines(text: str, alone: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(first sentence, sentence or -1, start, length, what is hashed) of a text's units."""
    pieces = [(m.start(), m.end(), m.group().encode().lower().split(), "\n" in m.group()) for m in SENTENCES.finditer(text)]
    said = [b" ".join(p[2]) for p in pieces]
    first = 0
    for k, (_, end, _, ends) in enumerate(pieces):
        if not ends and k + 1 < len(pieces):
            continue
        own = [j for j in range(first, k + 1) if said[j]]
        if own:
            yield first, -1, pieces[first][0], end - pieces[first][0], b" ".join([said[j] for j in own])
        for j in own if len(own) > 1 else ():
            start, stop, words, _ = pieces[j]
            yield first, j, start, stop - start, said[j] if len(words) >= alone else b"\x1f".join([said[j - 1] if j else b"", said[j], said[j + 1] if j + 1 < len(said) else b""])
        first = k + 1


def _paragraphs(text: str, alone: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    for k, m in enumerate(PARAGRAPHS.finditer(text)):
        if words := m.group().encode().lower().split():
            yield k, -1, m.start(), m.end() - m.start(), b" ".join(words)


def _sentences(text: str, alone: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    for k, m in enumerate(SENTENCES.finditer(text)):
        if words := m.group().encode().lower().split():
            yield k, -1, m.start(), m.end() - m.start(), b" ".join(words)


UNITS = {"line": _lines, "paragraph": _paragraphs, "sentence": _sentences}


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", alone: int = 1) -> DataFrame:
    """(doc_id, unit, sentence, start, length, digest), offsets in code points.

    A unit is a line (or a paragraph, or a sentence) with a word, however short; `unit` numbers it by its first sentence (paragraph) in the
    text. Digests are of normalised units: A-Z lowered, words joined by one space. A line of several sentences may
    hold a passage that stands elsewhere in a longer or shorter line, so its sentences are units too, however short; with `alone` above 1
    sentences of fewer words are told together with the sentence before and after them in the text.
    """
    split = UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for *place, said in split(text.as_py(), alone):
                    ids.append(doc)
                    rows.append((*place, hashlib.md5(said).digest()))
            number, sentence, start, length, digest = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(x, pa.int32()) for x in (number, sentence, start, length)], pa.array(digest, pa.binary())], ["doc_id", "unit", "sentence", "start", "length", "digest"])

    return texts(docs, id_col, text_col).filter("doc_id is not null").mapInArrow(run, "doc_id long, unit int, sentence int, start int, length int, digest binary")


def repeated_units(docs: DataFrame, **options) -> DataFrame:
    """One row per unit to remove: doc_id, unit, sentence, start, length, first_doc_id, first_unit, copies.

    Of units with equal digests the one of the smallest (doc_id, unit) stays; sentence is -1 for whole lines. Texts
    are split once and their units cut. Digests are counted with partial sums, only those that occur again are joined back,
    and a very common unit's rows are split over tasks. Every line with a word counts, so that a passage of
    short lines goes too. Null and empty texts have no units; rows without an id can't be named and have none; repeated rows of one document compare by
    unit number, so that an exact repeat of a row stays as it is the same place; a very long text or line is
    split like others; an empty table gives an empty result; other columns are ignored.
    """
    rows = cut(units(docs, **options))
    # A place as one number, which a hash aggregate can hold; sentences come after their line.
    rank = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + F.col("unit")
    first = rows.groupBy("digest").agg(F.min(rank.cast("decimal(38,0)")).alias("rank"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    doc = F.floor(F.col("rank") / F.lit(2**32).cast("decimal(11,0)")).cast("decimal(38,0)")
    first = first.select("digest", doc.cast("long").alias("first_doc_id"), (F.col("rank") - doc * F.lit(2**32).cast("decimal(11,0)")).cast("int").alias("first_unit"), "copies")
    again = split_join(rows, first, ["digest"], "inner")
    return again.filter("doc_id <> first_doc_id or unit <> first_unit").select("doc_id", "unit", "sentence", "start", "length", "first_doc_id", "first_unit", "copies")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with later copies of units cut out of their texts; a document's spans are sorted and applied once.

    A line that goes as a whole takes its sentences along.
    """
    found = repeated_units(docs, id_col=id_col, text_col=text_col, **options)
    span, whole = F.struct("start", "length"), F.col("sentence") < 0
    lines = found.groupBy("doc_id", "unit").agg(F.collect_set(F.when(whole, span)).alias("whole"), F.collect_set(F.when(~whole, span)).alias("parts"))
    spans = lines.select("doc_id", F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.col("parts")).alias("s")).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("_spans"))
    joined = packed(docs, id_col).join(spans.withColumnRenamed("doc_id", "k"), "k", "left")
    text = F.col("r").getField(text_col)
    ends = F.concat(F.array(F.lit(1)), F.transform("_spans", lambda s: s["start"] + s["length"] + 1))
    begins = F.concat(F.transform("_spans", lambda s: s["start"] + 1), F.array(F.char_length(text) + 1))
    parts = F.zip_with(ends, begins, lambda a, b: F.substring(text, a, b - a))
    cut_text = F.when(F.col("_spans").isNull(), text).otherwise(F.array_join(parts, ""))
    return joined.select(F.col("r").withField(text_col, cut_text).alias("r")).select("r.*")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))


SQL = {
    "op1_line_dedup": r"""
with u as (
  select doc_id, unnest(p) as piece, generate_subscripts(p, 1) - 1 as k
  from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\n.!?]+[.!?]*\n?|[\n.!?]+') as p from documents where doc_id is not null)),
n as (
  select *, length(piece) as length, array_to_string(words, ' ') as said, len(words) as n_words,
    coalesce(sum(length(piece)) over before, 0) as start, coalesce(sum((contains(piece, chr(10)))::int) over before, 0) as line
  from (select *, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from u)
  window before as (partition by doc_id order by k rows between unbounded preceding and 1 preceding)),
c as (
  select *, min(k) over (partition by doc_id, line) as unit, count(*) filter (n_words > 0) over (partition by doc_id, line) as spoken
  from n),
d as (
  select doc_id, unit, -1 as sentence, min(start) as start, sum(length) as length, string_agg(said, ' ' order by k) filter (n_words > 0) as digest
  from c where spoken > 0 group by doc_id, line, unit
  union all
  select doc_id, unit, k, start, length, said
  from c where n_words > 0 and spoken > 1),
f as (
  select *, first_value(doc_id) over w as first_doc_id, first_value(unit) over w as first_unit,
    count(*) over (partition by digest) as copies
  from d window w as (partition by digest order by doc_id, unit))
select doc_id, unit::int as unit, sentence::int as sentence, start::int as start, length::int as length, first_doc_id, first_unit::int as first_unit, copies
from f where doc_id <> first_doc_id or unit <> first_unit
"""
}
