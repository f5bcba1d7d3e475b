"""Suffix-array dedup: later copies of long byte strings go, the first copy stays.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller doc_id:
that is where the longest previous factor of the string's start, among earlier documents, reaches `length`. In suffix order
the nearest positions before and after that belong to a smaller document share the longest prefixes with it; the larger of the
two common prefixes is the factor. Suffixes of all texts can't be sorted together, so each window of `length`
bytes is sent to the bucket of its minimiser (the smallest hash of a short gram inside it), which equal windows
share; of these only grams that several documents hold are followed, and the rest of the text never moves on. Inside a bucket
suffixes are ordered by their first `length` bytes, beyond which no factor needs to be known.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import slab, slabs_for, table, texts
from millrace.llm.shared import KEY, M1, M2, bucket_of, column, found, mixed, owned, received, shared_keys

GRAM = 16
CHUNK = 1 << 17


def in_order(ids: np.ndarray, texts: list[bytes]) -> list[int]:
    """A slab's rows by id and then text, so that each step numbers them alike."""
    return sorted(range(len(ids)), key=lambda k: (ids[k], texts[k] or b""))


class Slab:
    """A slab's documents in the order of their ids, as one buffer; grams and windows are positions in it."""

    def __init__(self, rows: pa.Table, length: int):
        ids = np.array(column(rows, "doc_id"), np.int64)
        texts = column(rows, "raw")
        order = in_order(ids, texts)
        parts = [texts[k] or b"" for k in order]
        self.length, self.ids = length, ids[order]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.raw = b"".join(parts)
        self.bytes = np.frombuffer(self.raw, np.uint8)

    def grams(self, first: int, last: int) -> np.ndarray:
        """64-bit values of the grams that start in [first, last)."""
        part = self.bytes[first : last + GRAM - 1]
        words = np.lib.stride_tricks.as_strided(part[: len(part) // 8 * 8].view(np.uint64) if len(part) >= 8 else part.astype(np.uint64), (max(0, len(part) - 7),), (1,))
        return words[: len(words) - 8] * M1 ^ (words[8:] * M2 + (words[:-8] >> np.uint64(31)))

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs of windows with one minimiser: first window and windows of each run, and the gram's position."""
        span = self.length - GRAM + 1
        total = len(self.bytes) - self.length + 1
        firsts, grams, counts = [], [], []
        for begin in range(0, max(0, total), CHUNK):
            end = min(total, begin + CHUNK)
            value = self.grams(begin, end + span - 1)
            least = (mixed(value) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
            width = 1
            while width * 2 <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64) + begin
            window = np.arange(begin, end)
            # Windows stay inside a document: the last length - 1 starts of each have none.
            doc = np.searchsorted(self.ends, window[[0, -1]], "right")
            good = np.ones(end - begin, bool)
            for d in range(int(doc[0]), int(doc[1]) + 1):
                good[max(0, max(self.starts[d], self.ends[d] - self.length + 1) - begin) : max(0, self.ends[d] - begin)] = False
            window, at = window[good], at[good]
            if len(window):
                cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)])
                firsts.append(window[cuts])
                grams.append(at[cuts])
                counts.append(np.diff(np.r_[cuts, len(at)]))
        if not firsts:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(firsts), np.concatenate(counts), np.concatenate(grams)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return np.zeros(0, np.uint64)
        index = grams[:, None] + np.arange(GRAM)
        words = np.ascontiguousarray(self.bytes[index]).view(np.uint64).reshape(-1, GRAM // 8)
        return mixed(mixed(words[:, 0] * M1) + words[:, 1]) & KEY

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def _table(values: np.ndarray) -> list[np.ndarray]:
    """values' minima over spans of 1, 2, 4 ... positions, by first position."""
    out = [values]
    while 2 << len(out) - 1 <= len(values):
        step = 1 << len(out) - 1
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
    return out


def smaller(docs: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each position of a suffix order the least common prefix between it and the position before it that is the nearest
    with a smaller document (the previous smaller value), 0 where there is none.

    docs are the owners in suffix order, lcp[k] the common prefix of positions k - 1 and k. All positions step back together
    over spans that hold no smaller owner, longest spans first, and keep the least common prefix on their way.
    """
    owners, common = _table(docs), _table(lcp)
    at = np.arange(len(docs))
    least = np.full(len(docs), np.iinfo(lcp.dtype).max, lcp.dtype)
    for k in range(len(owners) - 1, -1, -1):
        # The span [at - 2^k, at) may be passed if none of its owners is smaller; passing crosses lcp[at - 2^k + 1 .. at].
        first = at - (1 << k)
        able = first >= 0
        able[able] = owners[k][first[able]] >= docs[able]
        least[able] = np.minimum(least[able], common[k][first[able] + 1])
        at[able] = first[able]
    # Now the position just before is the nearest smaller one.
    there = at > 0
    least[there] = np.minimum(least[there], lcp[at[there]])
    least[~there] = 0
    return least


def longest_previous_factors(strings: np.ndarray, docs: np.ndarray, length: int, least: int = 0) -> np.ndarray:
    """For each string, how long a prefix of it (`length` at most) a string of a smaller document begins with.

    strings are rows of big-endian words; their order, ties by document, is the suffix order. The nearest positions
    before and after with a smaller document share the longest prefixes: the larger of the two is the factor. Factors below
    `least` may be told as 0: a position whose neighbours both share less has no longer factor, and is left out.
    """
    n = len(docs)
    order = np.lexsort((docs, *[strings[:, k] for k in range(strings.shape[1] - 1, -1, -1)]))
    ordered = strings[order]
    # Common prefixes of neighbours: words that agree, then bytes of the first word that doesn't.
    differs = ordered[1:] ^ ordered[:-1]
    word = (differs != 0).argmax(1)
    first = differs[np.arange(n - 1), word] if n > 1 else np.zeros(0, np.uint64)
    lead = np.zeros(n - 1 if n else 0, np.int64)
    for k in range(1, 8):
        lead += first < np.uint64(1) << np.uint64(64 - 8 * k)
    same = first == 0
    common = np.where(same, length, np.minimum(word * 8 + lead, length))
    out = np.zeros(n, np.uint16)
    near = common >= least
    at = np.flatnonzero(np.r_[False, near] | np.r_[near, False]) if n > 1 else np.zeros(0, np.int64)
    if not len(at):
        return out
    # Between two that are left and not neighbours lies one that shares less than `least`.
    lcp = np.zeros(len(at) + 1, np.uint16)
    lcp[1:-1] = np.where(np.diff(at) == 1, common[at[1:] - 1], 0)
    _, owner = np.unique(docs[order[at]], return_inverse=True)
    owner = owner.astype(np.int32)
    out[order[at]] = np.maximum(smaller(owner, lcp), smaller(owner[::-1], lcp[::-1])[::-1])
    return out


def as_words(source: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The strings of `length` bytes at starts as rows of big-endian words, whose order is the bytes' order."""
    padded = -(-length // 8) * 8
    out = np.zeros((len(starts), padded), np.uint8)
    for k in range(length):
        out[:, k] = source[starts + k]
    return out.view(">u8").astype(np.uint64)


HEAD = np.dtype([("doc", "<i8"), ("row", "<i4"), ("at", "<i4"), ("windows", "<i4")])
SENT = pa.schema([("bucket", pa.int32()), ("slab", pa.int32()), ("heads", pa.binary()), ("data", pa.binary())])


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, slab_bytes: int = 2 << 20, hot: int = 10_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the removed runs.

    Texts are UTF-8 bytes, null is empty, matches never cross documents; texts shorter than `length` keep all; a very long
    text is a slab of its own; an empty table gives an empty result; other columns are ignored.
    Rows that share a doc_id are judged each, and none is earlier than another; a row without an id is
    neither earlier nor later than any, so it keeps all and takes nothing from others. Strings are judged on the input, not on
    what is left. Texts move once, into slabs; a string that many documents hold goes on once from each
    slab, as the slab itself removes its later copies; where `hot` documents share a gram, windows are dealt out by
    their own content, not by the gram, so that the contexts of a common line don't meet in one task.
    """
    whole = texts(docs, id_col, text_col)
    rows = whole.filter("doc_id is not null")
    n_slabs = slabs_for(rows, slab_bytes)
    n_buckets = max(64, n_slabs // 2)
    slabs = rows.select("doc_id", F.col("text").cast("binary").alias("raw")).withColumn("slab", slab(n_slabs))

    def keys_of(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = Slab(part, length)
        grams = np.unique(own.minimisers()[2])
        return owned(own.keys(grams), own.ids[own.doc_of(grams)])

    shared = shared_keys(slabs, keys_of, n_buckets, hot)

    def strings(part: pa.Table, flags: pa.Table) -> pa.Table:
        """Runs of windows whose gram is shared, each kind of run once; later equal runs are removed here, in bucket -1."""
        if not part.num_rows or not flags.num_rows:
            return SENT.empty_table()
        own, (among, is_hot) = Slab(part, length), received(flags)
        first, count, gram = own.minimisers()
        key = own.keys(gram)
        hit, at = found(key, among)
        first, count, gram, key, often = first[hit], count[hit], gram[hit], key[hit], is_hot[at[hit]]
        # Of hot grams each window is a run of its own.
        each = np.where(often, count, 1)
        step = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        first, gram, key, often = (np.repeat(x, each) for x in (first, gram, key, often))
        first, count = first + step, np.where(often, 1, np.repeat(count, each))
        doc = own.doc_of(first)
        ids, local = own.ids[doc], first - own.starts[doc]
        size = count + length - 1
        seen: dict[bytes, int] = {}
        gone = np.zeros(len(first), bool)
        buckets = bucket_of(key, n_buckets)
        raw = own.raw
        for k, (f, s, d, o) in enumerate(zip(first.tolist(), size.tolist(), ids.tolist(), often.tolist(), strict=True)):
            run = raw[f : f + s]
            gone[k] = seen.setdefault(run, d) < d
            if o and not gone[k]:
                buckets[k] = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little") % n_buckets
        heads = np.zeros(len(first), HEAD)
        heads["doc"], heads["row"], heads["at"], heads["windows"] = ids, doc, local, count
        buckets[gone] = -1
        order = np.argsort(buckets, kind="stable")
        out, slab_id = [], part.column("slab")[0].as_py()
        for p in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1) if len(order) else []:
            b = int(buckets[p[0]])
            data = b"" if b < 0 else b"".join([raw[f : f + s] for f, s in zip(first[p].tolist(), size[p].tolist(), strict=True)])
            out.append((b if b >= 0 else -1 - slab_id, slab_id, heads[p].tobytes(), pa.compress(data, "zstd", asbytes=True) if data else data))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), SENT, strict=True)], schema=SENT) if out else SENT.empty_table()

    back = pa.schema([("slab", pa.int32()), ("heads", pa.binary())])

    def judged(part: pa.Table) -> pa.Table:
        """Windows of a bucket that an earlier document holds, as runs, for the slabs they came from."""
        if part.column("bucket")[0].as_py() < 0:
            return part.select(["slab", "heads"])
        lists = [np.frombuffer(x, HEAD) for x in column(part, "heads")]
        heads = np.concatenate(lists)
        of_slab = np.repeat(np.array(column(part, "slab"), np.int64), [len(x) for x in lists])
        sizes = heads["windows"].astype(np.int64) + length - 1
        raw = b"".join(pa.decompress(x, int(n["windows"].sum()) + len(n) * (length - 1), "zstd", asbytes=True) for x, n in zip(column(part, "data"), lists, strict=True))
        data = np.frombuffer(raw, np.uint8)
        begins = np.cumsum(sizes) - sizes
        # In a run that an earlier document holds as a whole every window's factor is long enough; it needs no sorting.
        seen: dict[bytes, int] = {}
        gone = np.zeros(len(heads), bool)
        by_doc = np.argsort(heads["doc"], kind="stable")
        for k, f, n, d in zip(by_doc.tolist(), begins[by_doc].tolist(), sizes[by_doc].tolist(), heads["doc"][by_doc].tolist(), strict=True):
            gone[k] = seen.setdefault(raw[f : f + n], d) < d
        del seen
        windows = np.where(gone, 0, heads["windows"].astype(np.int64))
        step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        starts, run = np.repeat(begins, windows) + step, np.repeat(np.arange(len(heads)), windows)
        late = np.zeros(len(starts), bool)
        # In parts by the string's first eight bytes, so that sorting holds a bounded part of the windows at a time; factors
        # of eight bytes or more stay within a part.
        front = as_words(data, starts, 8)[:, 0]
        parts = max(1, len(starts) // 400_000)
        for k in range(parts):
            at = np.flatnonzero(mixed(front) % np.uint64(parts) == np.uint64(k)) if parts > 1 else np.arange(len(starts))
            late[at] = longest_previous_factors(as_words(data, starts[at], length), heads["doc"][run[at]], length, length) >= length
        run, step = run[late], step[late]
        cuts = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (step[1:] != step[:-1] + 1)]) if len(run) else np.zeros(0, np.int64)
        out = np.zeros(len(cuts), HEAD)
        out["doc"], out["row"], out["at"] = heads["doc"][run[cuts]], heads["row"][run[cuts]], heads["at"][run[cuts]] + step[cuts]
        out["windows"] = np.diff(np.r_[cuts, len(run)])
        out, of_slab = np.concatenate([heads[gone], out]), np.concatenate([of_slab[gone], of_slab[run[cuts]]])
        order = np.argsort(of_slab, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(of_slab[order])) + 1) if len(order) else []
        return pa.Table.from_arrays([pa.array([int(of_slab[p[0]]) for p in groups], pa.int32()), pa.array([out[p].tobytes() for p in groups], pa.binary())], schema=back)

    final = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def cleaned(part: pa.Table, spans: pa.Table) -> pa.Table:
        if not part.num_rows:
            return final.empty_table()
        heads = np.frombuffer(b"".join(column(spans, "heads")), HEAD)
        heads = heads[np.argsort(heads["row"], kind="stable")]
        ids, raws = np.array(column(part, "doc_id"), np.int64), column(part, "raw")
        out = []
        for row, k in enumerate(in_order(ids, raws)):
            doc, raw = int(ids[k]), raws[k] or b""
            a, b = np.searchsorted(heads["row"], [row, row + 1])
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, heads["at"][a:b], 1)
            np.add.at(edge, np.minimum(heads["at"][a:b] + heads["windows"][a:b] + length - 1, len(raw)), -1)
            gone = np.cumsum(edge)[:-1] > 0
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if b > a else raw
            out.append((doc, len(raw), int(gone.sum()), len(turns) // 2, hashlib.sha256(kept).hexdigest(), turns[::2].tolist(), turns[1::2].tolist()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), final, strict=True)], schema=final)

    sent = slabs.groupBy("slab").cogroup(shared.groupBy("slab")).applyInArrow(strings, "bucket int, slab int, heads binary, data binary")
    spans = sent.groupBy("bucket").applyInArrow(judged, "slab int, heads binary")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<long>")
    unnamed = whole.filter("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), none.alias("starts"), none.alias("ends"))
    return slabs.groupBy("slab").cogroup(spans.groupBy("slab")).applyInArrow(cleaned, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>").unionByName(unnamed)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_bytes(table(spark, sf_dir, "documents")).drop("starts", "ends")
