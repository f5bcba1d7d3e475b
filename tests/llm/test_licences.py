"""Licence scans on whole texts, on versions that share most words, and base places on real documents by force."""

from __future__ import annotations

import random
import re
import time

from millrace.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scan(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in licences.licence_scan(docs, **options).orderBy("doc_id").collect()]


def test_every_template_is_told_from_the_others(spark):
    texts, labels = zip(*[("Intro words here. " + w.upper() + " closing words", label) for label, ws in licences.TEMPLATES.items() for w in ws], strict=True)
    for r, label in zip(scan(spark, texts), labels, strict=True):
        assert label in r.labels.split(","), label
        others = set(r.labels.split(",")) - {label} - set(licences.PHRASES.values())
        assert others <= {"apache-2.0"} and (not others or label == "apache-2.0"), (label, others)
        assert r.score == 1.0 and any(s.start == 3 and s.end == r.n_words - 2 for s in r.spans), label


def test_changed_and_repeated_texts(spark):
    mit = licences.TEMPLATES["mit"][2].split()
    odd = list(mit)
    for k in range(20, len(odd), 30):
        odd[k] = "CHANGED"
    r, twice, part = scan(spark, [" ".join(odd), " ".join(mit) + " between " + " ".join(mit), " ".join(mit[:40])])
    assert r.labels == "mit" and 0.75 < r.score < 1 and len(r.spans) == 1
    assert [s.label for s in twice.spans] == ["mit", "mit"] and twice.spans[0].end <= twice.spans[1].start
    assert part.labels == "" and 0 < part.score < 0.75


def test_long_templates_chain_over_any_distance(spark):
    rng = random.Random(1)
    words = ["w" + str(rng.randrange(400)) for _ in range(3000)]
    text = list(words)
    text[1500:1500] = ["zzz"] * 10
    (r,) = scan(spark, [" ".join(text)], templates={"own": (" ".join(words),)})
    assert r.labels == "own" and r.score == 1.0 and (r.spans[0].start, r.spans[0].end) == (0, 3010)


def test_base_places_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    hits = 0
    for r in docs.collect():
        words = WORD.findall((r.text or "").encode().lower().decode())
        at, labels = [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            here = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        g = got[r.doc_id]
        want = (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == want
        assert labels <= set(g.labels.split(",")) and 0 <= g.score <= 1
        hits += bool(at)
    assert hits > 5


def test_tags_and_short_forms(spark):
    texts = ["SPDX-License-Identifier: MIT", "Licensed under GPLv3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "CC BY-SA 4.0", "SPDX-License-Identifier: Foo", "spdx license identifier", "// SPDX-License-Identifier: GPL-2.0-or-later", "Apache License, Version 2.0", "Licensed under the AGPLv3."]
    got = [r.labels for r in scan(spark, texts)]
    assert got == ["mit", "gpl-3.0", "gpl,gpl-3.0", "cc-by,cc-by-sa-4.0", "", "", "gpl-2.0", "apache-2.0", "agpl-3.0"]


def test_many_notices_in_one_text():
    """100,000 notices take seconds, and spans are those of a plain comparison with all that are taken."""
    own = licences.Scanner(licences.TEMPLATES, 3, 12, 0.75, licences.EXACT)
    began = time.perf_counter()
    assert len(own.scan("licensed under the mit license. " * 100_000)[7]) == 100_000
    own.scan("this software is provided. free software foundation. " * 100_000)
    assert time.perf_counter() - began < 60
    rng, taken, plain = random.Random(2), licences.Spans(most=8), []
    for _ in range(3000):
        start = rng.randrange(4000)
        end = start + rng.choice([1, 2, 5, 40])
        assert taken.most_shared(start, end) == max([0, *(min(end, b) - max(start, a) for a, b in plain)])
        if taken.most_shared(start, end) * 2 < end - start:
            taken.add(start, end)
            plain.append((start, end))
    assert len(plain) > 300
