"""Keys that more than one owner holds, over all slabs, without moving what the keys were taken from.

Rows are grouped into slabs of bounded size by a hash of their id. Each slab sends its distinct 64-bit keys,
packed by bucket of the key; a bucket answers each slab with those of its keys that are shared. A key comes
at most once from each slab, however many rows hold it, so a hot key is no hot group.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keys are this wide: two different things that share a key by chance only cost a comparison later.
KEY = np.uint64((1 << 48) - 1)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = (x ^ (x >> np.uint64(32))) * M3
    x = (x ^ (x >> np.uint64(29))) * M1
    return x ^ (x >> np.uint64(32))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(n)).astype(np.int64)


def by_bucket(keys: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions) for each bucket that occurs."""
    at = bucket_of(keys, n)
    order = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[order])) + 1
    return [(int(at[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def owned(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the number of distinct owners of each."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    if not len(keys):
        return keys, np.zeros(0, np.uint32)
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    own = fresh | np.r_[True, owners[1:] != owners[:-1]]
    return keys[fresh], np.add.reduceat(own.astype(np.uint32), np.flatnonzero(fresh))


def give_back() -> None:
    """Hand freed memory back to the system: workers are reused, and what they hold on to counts for their executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def short(keys: np.ndarray) -> bytes:
    """Keys of 48 bits as six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def shared_keys(slabs: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], n_buckets: int, hot: int = 1000) -> DataFrame:
    """(slab, keys binary, hot binary): each slab's keys with two owners or more anywhere.

    keys_of gives a slab's distinct keys, of 48 bits, and how many owners each has there; owners of different
    slabs count as different. hot tells which keys have at least that many.
    """
    kind = pa.schema([("bucket", pa.int32()), ("slab", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary())])

    def send(table: pa.Table) -> pa.Table:
        own = table.column("slab")[0].as_py()
        keys, owners = keys_of(table)
        give_back()
        rows = []
        for b, at in by_bucket(keys, n_buckets):
            one = owners[at] == 1
            rows += [(b, own, short(keys[at[one]]), b"")] * bool(one.any())
            rows += [(b, own, short(keys[at[~one]]), owners[at[~one]].astype(np.uint32).tobytes())] * bool((~one).any())
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kind, strict=True)] if rows else [pa.array([], f.type) for f in kind], schema=kind)

    back = pa.schema([("slab", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        give_back()
        lists = [long(x) for x in column(table, "keys")]
        counts = [np.frombuffer(x, np.uint32) if x else np.ones(len(k), np.uint32) for x, k in zip(column(table, "owners"), lists, strict=True)]
        keys, count = np.concatenate(lists), np.concatenate(counts).astype(np.int64)
        slab = np.repeat(np.array(column(table, "slab"), np.int64), [len(x) for x in lists])
        order = np.argsort(keys, kind="stable")
        keys, count, slab = keys[order], count[order], slab[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.repeat(np.add.reduceat(count, starts), np.diff(np.r_[starts, len(keys)]))
        keep = total > 1
        keys, slab, often = keys[keep], slab[keep], (total[keep] >= hot)
        order = np.argsort(slab, kind="stable")
        keys, slab, often = keys[order], slab[order], often[order]
        parts = np.split(np.arange(len(keys)), np.flatnonzero(np.diff(slab)) + 1) if len(keys) else []
        return pa.Table.from_arrays(
            [pa.array([int(slab[p[0]]) for p in parts], pa.int32()), pa.array([short(keys[p]) for p in parts], pa.binary()), pa.array([often[p].tobytes() for p in parts], pa.binary())], schema=back
        )

    sent = slabs.groupBy("slab").applyInArrow(send, "bucket int, slab int, keys binary, owners binary")
    return sent.groupBy("bucket").applyInArrow(answer, "slab int, keys binary, hot binary")


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A slab's shared keys, sorted, and which of them are hot."""
    keys = long(b"".join(column(table, "keys")))
    hot = np.frombuffer(b"".join(column(table, "hot")), np.bool_)
    order = np.argsort(keys, kind="stable")
    return keys[order], hot[order]


def found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ones, and where."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at
