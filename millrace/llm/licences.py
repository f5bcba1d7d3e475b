"""Licence scans: matching statistics against a suffix automaton of licence templates, chained into template spans."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, texts

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Public licence texts and notices, by label.
_WARRANTY = """the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of
merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages
or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other
dealings in the software"""
_BSD = """redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. """
_BSD_NAMES = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission. """
_BSD_END = """this software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to,
the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be
liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or
services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or
tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"""
_GNU = """this {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the free software foundation,
either version {version} of the license, or (at your option) any later version. this {thing} is distributed in the hope that it will be useful, but without
any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the {name} for more details. you should have
received a copy of the {name} along with this {thing}. if not, """
_GNU_END = {"2": "write to the free software foundation, inc., 51 franklin street, fifth floor, boston, ma 02110-1301 usa", "3": "see https://www.gnu.org/licenses/"}
_GNU_KINDS = (("gpl", "gnu general public license", "program", ("2", "3")), ("lgpl", "gnu lesser general public license", "library", ("2.1", "3")), ("agpl", "gnu affero general public license", "program", ("3",)))
_CC_KINDS = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nd": "attribution-noderivatives", "by-nc": "attribution-noncommercial", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderivatives"}
_CC_VERSIONS = {"2.0": "generic", "2.5": "generic", "3.0": "unported", "4.0": "international"}
TEMPLATES = {
    "mit": (
        "released under the mit license", "licensed under the mit license",
        """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "software"), to
        deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the software. """ + _WARRANTY,
    ),
    "bsd-2-clause": ("licensed under the bsd 2-clause license", _BSD + _BSD_END),
    "bsd-3-clause": ("licensed under the bsd 3-clause license", _BSD + _BSD_NAMES + _BSD_END),
    "isc": (
        "licensed under the isc license",
        """permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. the software is provided "as is" and the author disclaims all warranties with regard to
        this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect,
        or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other
        tortious action, arising out of or in connection with the use or performance of this software""",
    ),
    "zlib": (
        """this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from
        the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions: the origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed
        or altered from any source distribution""",
    ),
    "bsl-1.0": (
        "distributed under the boost software license, version 1.0",
        """permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
        this license (the "software") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software,
        and to permit third-parties to whom the software is furnished to do so, all subject to the following""",
    ),
    "unlicense": (
        """this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    ),
    "apache-2.0": (
        "licensed under the apache license, version 2.0",
        """licensed under the apache license, version 2.0 (the "license"); you may not use this file except in compliance with the license. you may obtain a copy
        of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the
        license is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific
        language governing permissions and limitations under the license""",
    ),
    "mpl-2.0": (
        "licensed under the mozilla public license version 2.0",
        """this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can
        obtain one at https://mozilla.org/mpl/2.0/""",
    ),
    "epl-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "cc0-1.0": ("to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "licensed under cc0 1.0 universal"),
    # The families, a wording for each member and version.
    **{f"{short}-{v if '.' in v else v + '.0'}": (f"licensed under the {name} version {v}", (_GNU + _GNU_END[v[0]]).format(thing=thing, name=name, version=v)) for short, name, thing, versions in _GNU_KINDS for v in versions},
    **{f"cc-{kind}-{v}": (f"licensed under cc {kind} {v}", f"this work is licensed under a creative commons {name} {v} {where} license") for kind, name in _CC_KINDS.items() for v, where in _CC_VERSIONS.items()},
}
#: Tags and short forms, by label: they count only as a whole.
EXACT = {
    **{label: (f"spdx-license-identifier: {label}",) for label in TEMPLATES},
    **{f"{short}-{v if '.' in v else v + '.0'}": (f"spdx-license-identifier: {short}-{v if '.' in v else v + '.0'}", f"licensed under {short}v{v}", f"licensed under the {short}v{v}", f"{name} version {v}") for short, name, _, versions in _GNU_KINDS for v in versions},
    **{f"cc-{kind}-{v}": (f"spdx-license-identifier: cc-{kind}-{v}", f"cc {kind} {v}") for kind in _CC_KINDS for v in _CC_VERSIONS},
    "apache-2.0": ("spdx-license-identifier: apache-2.0", "apache license version 2.0"), "mpl-2.0": ("spdx-license-identifier: mpl-2.0", "mozilla public license version 2.0"), "epl-2.0": ("spdx-license-identifier: epl-2.0", "eclipse public license version 2.0"),
}
#: Bytes of words: 0-9, a-z after lowering A-Z, and all beyond ASCII; the rest parts words.
_SPLIT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Automaton:
    """A suffix automaton over all templates; each state knows the places in templates where its strings end."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].add((t, at))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(dict(following))
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        """The state that p reaches by word, cut so that it holds no string longer than p's and one."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word)
        return new

    def matches(self, words: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of the matches of `least` words or more that can't be carried on."""
        state = size = 0
        for at, word in enumerate(words):
            if word not in self.next[state]:
                if size >= least:
                    yield at - 1, size, state
                while state and word not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                state = size = 0
        if size >= least:
            yield len(words) - 1, size, state


class Spans:
    """Places taken so far, by their start in chunks of bounded size, so that a new one is compared with its neighbours alone.

    Places may overlap, each by less than half of a later one; `reach` is the length of the longest.
    """

    def __init__(self, most: int = 512):
        self.most, self.reach = most, 0
        self.chunks: list[list[tuple[int, int]]] = [[]]
        self.firsts: list[int] = [-1]

    def add(self, start: int, end: int) -> None:
        self.reach = max(self.reach, end - start)
        k = bisect_right(self.firsts, start) - 1
        insort(self.chunks[k], (start, end))
        if len(self.chunks[k]) > self.most:
            half = self.chunks[k][self.most // 2 :]
            del self.chunks[k][self.most // 2 :]
            self.chunks.insert(k + 1, half)
            self.firsts.insert(k + 1, half[0][0])

    def most_shared(self, start: int, end: int) -> int:
        """The most words that one place taken shares with start..end."""
        k, found = max(0, bisect_right(self.firsts, start - self.reach) - 1), 0
        while k < len(self.chunks) and self.firsts[k] < end:
            chunk = self.chunks[k]
            for at in range(bisect_left(chunk, (start - self.reach,)), len(chunk)):
                a, b = chunk[at]
                if a >= end:
                    return found
                found = max(found, min(end, b) - max(start, a))
            k += 1
        return max(0, found)


class Scanner:
    """Words of a text to base places and covered templates."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: int, gap: int, cover: float, exact: dict[str, tuple[str, ...]] | None = None):
        self.least, self.gap = least, gap
        self.number: dict[bytes, int] = {}
        spell = lambda text: [self.number.setdefault(w, len(self.number)) for w in text.encode().translate(_SPLIT).split()]
        self.phrases = [(spell(p), label) for p, label in PHRASES.items()]
        self.labels, self.templates, self.covers = [], [], []
        for some, share in ((templates, cover), (exact or {}, 1.0)):
            for label, wordings in some.items():
                for wording in wordings:
                    self.labels.append(label)
                    self.templates.append(spell(wording))
                    self.covers.append(share)
        self.automaton = Automaton(self.templates)

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = text.encode().translate(_SPLIT).split()
        n = len(words)
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, n)
        places, base = [], set()
        for phrase, label in self.phrases:
            if n >= len(phrase):
                hit = np.logical_and.reduce([ids[k : n - len(phrase) + 1 + k] == w for k, w in enumerate(phrase)])
                if hit.any():
                    places.append(np.flatnonzero(hit))
                    base.add(label)
        spans, most = self.spans(ids)
        labels = base | {span["label"] for span in spans}
        score = min(1.0, max(most, 0.5 * bool(base)))
        at = np.concatenate(places) if places else None
        return (n, 0 if at is None else len(at), None if at is None else int(at.min()), None if at is None else int(at.max()), ",".join(sorted(base)), ",".join(sorted(labels)), float(score), spans)

    def spans(self, ids: np.ndarray) -> tuple[list[dict], float]:
        """Covered spans of templates in order, none half inside a better covered one, and the largest covered share of any."""
        known = np.r_[False, ids >= 0, False]
        turns = np.flatnonzero(known[1:] != known[:-1])
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b - a >= self.least:
                for end, size, state in self.automaton.matches(ids[a:b].tolist(), self.least):
                    for t, last in self.automaton.ends[state]:
                        matches.setdefault(t, []).append((a + end + 1 - size, last + 1 - size, size))
        found, most = [], 0.0
        for t, own in matches.items():
            need = self.covers[t] * len(self.templates[t])
            for covered, start, end in self.chains(own):
                if self.covers[t] < 1 or covered >= need:
                    most = max(most, covered / len(self.templates[t]))
                if covered >= need:
                    found.append((-covered, -covered / len(self.templates[t]), start, end, t))
        # Versions of one text share most words: where two templates cover one place the one with more words there stays.
        out, taken = [], Spans()
        for covered, share, start, end, t in sorted(found):
            if taken.most_shared(start, end) * 2 < end - start:
                taken.add(start, end)
                out.append({"start": start, "end": end, "label": self.labels[t], "covered": -covered, "share": -share})
        return sorted(out, key=lambda o: o["start"]), most

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(covered words, start, end) of the best chains that share no place: matches in template order, no gap longer than allowed.

        A match may follow those that end at most a gap before it, and so start at most the longest match before that.
        """
        matches.sort()
        longest = max(size for _, _, size in matches)
        best: list[int] = []
        begin: list[int] = []
        for k, (at, there, size) in enumerate(matches):
            most, first, j = size, at, k - 1
            while j >= 0 and matches[j][0] + longest + self.gap >= at:
                a, b, s = matches[j]
                if 0 <= at - (a + s) <= self.gap and there >= b + s and best[j] + size > most:
                    most, first = best[j] + size, begin[j]
                j -= 1
            best.append(most)
            begin.append(first)
        out, taken = [], Spans()
        for k in sorted(range(len(best)), key=lambda k: (-best[k], begin[k])):
            start, end = begin[k], matches[k][0] + matches[k][2]
            if not taken.most_shared(start, end):
                taken.add(start, end)
                out.append((best[k], start, end))
        return out


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, tuple[str, ...]], ...], least: int, gap: int, cover: float, exact: bool) -> Scanner:
    return Scanner(dict(templates), least, gap, cover, EXACT if exact else None)


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, least: int = 3, gap: int = 12, cover: float = 0.75) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    One narrow pass; the automaton is a fixed model of the templates' words, built once in each worker. `templates` (label to texts) stand
    in for those carried here, so that whole texts of longer licences can be given. A text's
    matching statistics give its longest matches with any template; matches of `least` words are chained in
    template order over gaps of at most `gap` words, and a place that covers a template to `cover`, or a tag or short form as a whole, is a span (first word, word
    after the last, label, covered words, share) and adds its label; of versions that cover one place the best stays. The score is the
    largest covered share, and 0.5 at least where a base phrase stands. Null and empty texts have no words, empty labels and
    score 0; repeated rows are scanned each, rows without an id too; very long texts are scanned whole; other columns are ignored; an empty table gives an empty result.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("covered", pa.int64()), ("share", pa.float64())])
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))]
    wordings = tuple((label, tuple(texts_of)) for label, texts_of in (TEMPLATES if templates is None else templates).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(wordings, least, gap, cover, templates is None)
        for batch in batches:
            rows = list(zip(*[own.scan(t.as_py()) for t in batch.column("text")], strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, kind) for x, (_, kind) in zip(rows, fields, strict=True)]], ["doc_id", *[f for f, _ in fields]])

    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,end:long,label:string,covered:long,share:double>>"
    return texts(docs, id_col, text_col).mapInArrow(run, kind)


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")
