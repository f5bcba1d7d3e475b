"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model holds a white-space marker behind another character, merges never cross the start
of a run of markers. A text is then cut before each such run, every distinct chunk is segmented once by the
library, and ids are joined back by position. Decoding concatenates the chunks' decodings alike.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


class Chunks(dict):
    """chunk -> (packed ids, decoded text), filled on demand; emptied when it holds `most` chunks."""

    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        if crossing := [p for i in range(len(self.model)) if MARK in (p := self.model.id_to_piece(i)).lstrip(MARK)]:
            raise ValueError(f"pieces cross white-space markers: {crossing[:3]}")
        self.bare = self.model.piece_to_id(MARK)
        self.bos, self.eos = struct.pack("<I", self.model.bos_id()), struct.pack("<I", self.model.eos_id())

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        # The library puts one marker before what it encodes and takes one off what it decodes.
        ids = self.model.encode(chunk[1:]) if chunk != MARK else [self.bare]
        found = struct.pack(f"<{len(ids)}I", *ids), " " + self.model.decode(ids)
        if len(self) >= self.most:
            self.clear()
        self[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids with begin and end, packed little-endian, and the decoded text."""
        if not text:
            return self.bos + self.eos, ""
        marked = MARK + text.replace(" ", MARK)
        pairs = list(map(self.__getitem__, CHUNK.findall(marked)))
        return b"".join([self.bos, *[p[0] for p in pairs], self.eos]), "".join([p[1] for p in pairs])[1:]


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def encoded(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text.

    Null texts count as empty and give only the begin and end ids. One narrow pass without a shuffle; each
    task keeps a bounded table of distinct chunks, as chunks of all texts need not fit anywhere.
    """
    return _mapped(texts(docs, id_col, text_col), model, digests=False)


def encoded_digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encoded() gives, digested before it leaves the task."""
    return _mapped(texts(docs, id_col, text_col), model, digests=True)


def _mapped(rows: DataFrame, model: str | None, digests: bool) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chunks(model)
        for batch in batches:
            ids, tokens, first, second = batch.column("doc_id"), [], [], []
            for text in batch.column("text"):
                packed, decoded = known.encode(text.as_py())
                if digests:
                    tokens.append(len(packed) // 4)
                    first.append(hashlib.sha256(packed).hexdigest())
                    second.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    first.append(struct.unpack(f"<{len(packed) // 4}i", packed))
                    second.append(decoded)
            if digests:
                yield pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([ids, pa.array(first, pa.list_(pa.int32())), pa.array(second, pa.string())], ["doc_id", "ids", "decoded"])

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return rows.mapInArrow(run, kind)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"))
