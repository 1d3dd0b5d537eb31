"""Which keys occur in more than one place: one packed shuffle instead of a row per key.

A chunk sends, for each bucket of the key space, one row with its sorted distinct keys. The
bucket's task compares the chunks' lists and answers every chunk with the keys that others
hold too. A key in a third of all documents is thus one entry per chunk, in either direction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKED = "p int, chunk long, keys binary"
LISTS = "chunk long, keys binary"


def split_buckets(keys: np.ndarray, buckets: int):
    """Yield (bucket, positions) for uint64 keys."""
    if not len(keys):
        return
    p = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(p, kind="stable")
    cut = np.flatnonzero(np.diff(p[order])) + 1
    for part in np.split(order, cut):
        yield int(p[part[0]]), part


def pack_keys(chunk: int, keys: np.ndarray, many: np.ndarray, buckets: int) -> pa.Table:
    """Rows of PACKED for distinct sorted keys; ``many``: occurs twice in this chunk. The
    lowest bit of a key is given up to carry that."""
    tagged = (keys & ~np.uint64(1)) | many.astype(np.uint64)
    ps, blobs = [], []
    for p, part in split_buckets(keys, buckets):
        ps.append(p)
        blobs.append(tagged[part].tobytes())
    return pa.table(
        {
            "p": pa.array(ps, pa.int32()),
            "chunk": pa.array([chunk] * len(ps), pa.int64()),
            "keys": pa.array(blobs, pa.binary()),
        }
    )


def _shared(table: pa.Table) -> pa.Table:
    blobs = table.column("keys").to_pylist()
    chunks = table.column("chunk").to_numpy()
    keys = np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])
    owner = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
    key = keys >> np.uint64(1)
    order = np.argsort(key, kind="stable")
    key, owner, many = key[order], owner[order], (keys[order] & np.uint64(1)).astype(bool)
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    group = np.cumsum(first) - 1
    hit = (np.bincount(group) > 1) | np.bincount(group, weights=many).astype(bool)
    on = hit[group]
    key, owner = key[on], owner[on]
    order = np.argsort(owner, kind="stable")
    key, owner = key[order] << np.uint64(1), owner[order]
    out_chunk, out_keys = [], []
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
        if len(part):
            out_chunk.append(int(chunks[owner[part[0]]]))
            out_keys.append(key[part].tobytes())
    return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "keys": pa.array(out_keys, pa.binary())})


def shared_keys(packed: DataFrame) -> DataFrame:
    """LISTS rows: for each chunk, those of its keys that occur twice or more anywhere.
    Keys have their lowest bit cleared."""
    return packed.groupBy("p").applyInArrow(_shared, LISTS)


def own_repeats(keys: np.ndarray, owner: np.ndarray | None = None):
    """Distinct sorted keys and whether each occurs twice (in two owners, where given;
    owners must not fall along the positions)."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    twice = same if owner is None else same & (owner[order][1:] != owner[order][:-1])
    first = np.ones(len(k), dtype=bool)
    first[1:] = ~same
    group = np.cumsum(first) - 1
    many = np.zeros(int(first.sum()), dtype=bool)
    many[group[1:][twice]] = True
    return k[first], many
