"""op1 on units of few words: short lines and passages made of them are repeats like any other."""

from __future__ import annotations

import re

import pytest

from millrace.llm import line_dedup

POEM = "Rain fell.\nWe ran home!\nNobody spoke\nDoors shut. Lamps lit.\n"


def repeats_by_force(rows):
    """Later places of each unit with a word, by (doc_id, unit)."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        for number, m in enumerate(re.finditer(line_dedup.SENTENCES, t)):
            words = tuple(m.group().encode().lower().split())
            if words and seen.setdefault(words, (i, number)) != (i, number):
                out[i, number] = (m.start(), m.end() - m.start(), *seen[words])
    return out


def test_short_lines_are_removed(spark):
    docs = spark.createDataFrame([(1, "Start one. " + POEM), (2, POEM + "Other end"), (3, "rain  FELL. something else")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.without_repeats(docs, unit="sentence").collect()}
    assert out == {1: "Start one. " + POEM, 2: "Other end", 3: " something else"}


def test_every_repeated_unit_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = repeats_by_force([(r.doc_id, r.text or "") for r in docs.collect()])
    rows = line_dedup.repeated_units(docs, unit="sentence").collect()
    assert {(r.doc_id, r.unit): (r.start, r.length, r.first_doc_id, r.first_unit) for r in rows} == want
    assert any(length < 20 for _, length, _, _ in want.values())


def line_repeats_by_force(rows, alone=1):
    """Later places of lines and of sentences inside them; those of fewer words than `alone` between the same neighbours."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        pieces = [(m.start(), m.end(), tuple(m.group().encode().lower().split())) for m in re.finditer(r"[^\n.!?]+[.!?]*\n?|[\n.!?]+", t)]
        lines, own = [], []
        for k, (_, end, _) in enumerate(pieces):
            own.append(k)
            if "\n" in t[pieces[k][0] : end] or k + 1 == len(pieces):
                lines.append(own)
                own = []
        for line in lines:
            spoken = [k for k in line if pieces[k][2]]
            units = [(-1, pieces[line[0]][0], pieces[line[-1]][1], sum((pieces[k][2] for k in spoken), ()))] if spoken else []
            if len(spoken) > 1:
                around = lambda k: pieces[k][2] if 0 <= k < len(pieces) else ()
                units += [(k, pieces[k][0], pieces[k][1], pieces[k][2] if len(pieces[k][2]) >= alone else (around(k - 1), pieces[k][2], around(k + 1))) for k in spoken]
            for sentence, start, end, key in units:
                if seen.setdefault(key, (i, line[0])) != (i, line[0]):
                    out[i, line[0], sentence] = (start, end - start, *seen[key])
    return out


@pytest.mark.parametrize("alone", [1, 8])
def test_lines_of_real_documents(spark, alone):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = line_repeats_by_force([(r.doc_id, r.text or "") for r in docs.collect()], alone)
    rows = line_dedup.repeated_units(docs, alone=alone).collect()
    assert {(r.doc_id, r.unit, r.sentence): (r.start, r.length, r.first_doc_id, r.first_unit) for r in rows} == want
    assert any(k[2] >= 0 for k in want) and any(k[2] < 0 and v[1] < 20 for k, v in want.items())


def test_short_sentences_inside_other_lines(spark):
    passage = "Rain fell. We ran. This one sentence has quite enough words to count. Doors shut. Nobody at all spoke while the lamps went out. Good."
    docs = spark.createDataFrame([(-5, f"Intro here. {passage} Outro there."), (2, f"Other start. {passage} Other end."), (3, "Good. Rain fell. Something else happened then."), (4, "Yes\nno\n"), (5, "no\nmaybe"), (6, "Call us right now. A b c."), (7, "D e f. Call us right now. G h.")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert out[2] == "Other start. Other end." and out[3] == " Something else happened then." and out[7] == "D e f. G h."
    assert (out[4], out[5]) == ("Yes\nno\n", "maybe")
    out = {r.doc_id: r.text for r in line_dedup.without_repeats(docs, alone=8).collect()}
    assert out[2] == "Other start. Rain fell. Good. Other end." and out[3] == "Good. Rain fell. Something else happened then."


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a b\nc\n\nd e"), (2, "d  E\n\na b\nc")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.without_repeats(docs, unit="paragraph").collect()}
    assert out == {1: "a b\nc\n\nd e", 2: ""}
