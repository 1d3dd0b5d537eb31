"""Substring dedup by difference-cover anchors (word windows).

A window is ``window`` consecutive words of one document. Every word covered by a window
that also starts in a document with a smaller doc_id is removed; windows are judged on the
input.

Method: with a difference cover D modulo v, two positions always have a shift below v that
brings both into D. So hashing runs of ``window - v + 1`` words only at positions of D gives
two equal windows a common anchor. Anchors that occur in two documents are found through a
packed key exchange; the windows round them (the extension to full length) are compared by
128 bits of hash, keeping per window the smallest doc_id.

Defined cases: null text has no words; a null doc_id orders after all others; rows repeated
with the same doc_id are the same document and don't remove each other; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    NO_ID,
    SEQ_A,
    SEQ_B,
    chunked,
    compact,
    copy_mask,
    cover,
    ids_of,
    in_sorted,
    key_buckets,
    later_copies,
    null_ids,
    text_buffers,
    token_spans,
    window_ok,
    word_hashes,
)
from .repeats import LISTS, PACKED, own_repeats, pack_keys, shared_keys, split_buckets

WINDOW = 13
ITEM = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8")])
SIDE = "chunk long, kind int, doc_id long, blob binary"


def difference_cover(v: int) -> np.ndarray:
    """Residues whose pairwise differences reach every residue modulo v: the nonzero squares
    where they do (v = 7), else 0..s-1 and the multiples of s = ceil(sqrt(v))."""
    squares = np.unique(np.arange(1, v) ** 2 % v) if v > 2 else np.array([0])
    if len(np.unique((squares[:, None] - squares[None, :]) % v)) == v:
        return squares
    s = math.isqrt(v - 1) + 1
    return np.unique(np.concatenate([np.arange(min(s, v)), np.arange(0, v, s)]))


def _period(window: int) -> int:
    return max(1, (window + 1) // 2)


def _words(buf, bounds):
    starts, ends, doc = token_spans(buf, bounds)
    return starts, ends, doc, word_hashes(buf, starts, ends)


def _anchors(words, doc, window):
    """(positions, hashes) of the runs at cover positions; positions count from each text's start."""
    v = _period(window)
    size = window - v + 1
    keys = SEQ_A.windows(SEQ_A.prefix(words), size)
    begin = np.searchsorted(doc, doc[: len(keys)], "left") if len(keys) else np.zeros(0, np.int64)
    place = (np.arange(len(keys)) - begin) % v
    at = np.flatnonzero(window_ok(doc, size) & np.isin(place, difference_cover(v)))
    return at, keys[at]


def _split_side(side: pa.Table):
    """Copies and packed lists sent back to a chunk."""
    copies, blobs = set(), []
    for kind, doc, blob in zip(*(side.column(c).to_pylist() for c in ("kind", "doc_id", "blob"))):
        if kind == 0:
            copies.add((NO_ID if doc is None else doc, blob))
        else:
            blobs.append(blob)
    return copies, blobs


def _runs(docs: pa.Table, copies: set, skip: bool = True):
    """For each run of texts: row positions, ids, bytes, bounds; exact later copies left out."""
    rows = np.arange(docs.num_rows)
    if skip and copies:
        rows = np.flatnonzero(~copy_mask(docs, copies))
        docs = docs.take(pa.array(rows))
    ids = ids_of(docs)
    for lo, hi, buf, bounds in text_buffers(docs.column("text")):
        yield rows[lo:hi], ids[lo:hi], buf, bounds


def _send_anchors(window, buckets):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pack_keys(0, np.zeros(0, np.uint64), np.zeros(0, bool), 1)
        copies, _ = _split_side(side)
        keys, owner = [], []
        for _, ids, buf, bounds in _runs(docs, copies):
            _, _, doc, words = _words(buf, bounds)
            at, k = _anchors(words, doc, window)
            keys.append(k)
            owner.append(ids[doc[at]])
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        return pack_keys(docs.column("chunk")[0].as_py(), *own_repeats(keys, owner), buckets)

    return run


def _least(items: np.ndarray) -> np.ndarray:
    """One item per window hash, with the smallest doc."""
    items = items[np.lexsort((items["doc"], items["b"], items["a"]))]
    first = np.ones(len(items), dtype=bool)
    first[1:] = (items["a"][1:] != items["a"][:-1]) | (items["b"][1:] != items["b"][:-1])
    return items[first]


def _items(words, doc, ids, window, at=None) -> np.ndarray:
    a = SEQ_A.windows(SEQ_A.prefix(words), window)
    b = SEQ_B.windows(SEQ_B.prefix(words), window)
    if at is None:
        at = np.flatnonzero(window_ok(doc, window))
    out = np.empty(len(at), ITEM)
    out["a"], out["b"], out["doc"] = a[at], b[at].astype(np.uint32), ids[doc[at]]
    return out


def _send_windows(window, buckets):
    reach = _period(window)

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        ps, blobs, chunk = [], [], 0
        if docs.num_rows and side.num_rows:
            chunk = docs.column("chunk")[0].as_py()
            copies, lists = _split_side(side)
            shared = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in lists])) if lists else np.zeros(0, np.uint64)
            found = []
            for _, ids, buf, bounds in _runs(docs, copies) if len(shared) else ():
                _, _, doc, words = _words(buf, bounds)
                at, keys = _anchors(words, doc, window)
                at = at[in_sorted(keys & ~np.uint64(1), shared)]
                ok = window_ok(doc, window)
                near = np.zeros(len(ok) + 1, dtype=bool)
                for shift in range(reach):
                    near[np.minimum(np.maximum(at - shift, 0), len(ok))] = True
                found.append(_least(_items(words, doc, ids, window, np.flatnonzero(near[:-1] & ok))))
            items = _least(np.concatenate(found)) if found else np.zeros(0, ITEM)
            for p, part in split_buckets(items["a"], buckets):
                ps.append(p)
                blobs.append(items[part].tobytes())
        return pa.table(
            {
                "p": pa.array(ps, pa.int32()),
                "chunk": pa.array([chunk] * len(ps), pa.int64()),
                "keys": pa.array(blobs, pa.binary()),
            }
        )

    return run


def _smallest(table: pa.Table) -> pa.Table:
    """Per chunk the windows that a smaller doc_id of another chunk has, with that doc_id."""
    blobs = table.column("keys").to_pylist()
    chunks = table.column("chunk").to_numpy()
    items = np.concatenate([np.frombuffer(b, ITEM) for b in blobs])
    owner = np.repeat(np.arange(len(blobs)), [len(b) // ITEM.itemsize for b in blobs])
    order = np.lexsort((items["doc"], items["b"], items["a"]))
    items, owner = items[order], owner[order]
    first = np.ones(len(items), dtype=bool)
    first[1:] = (items["a"][1:] != items["a"][:-1]) | (items["b"][1:] != items["b"][:-1])
    least = items["doc"][first][np.cumsum(first) - 1]
    on = least < items["doc"]
    out, who = items[on].copy(), owner[on]
    out["doc"] = least[on]
    order = np.argsort(who, kind="stable")
    out, who = out[order], who[order]
    parts = [x for x in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1) if len(x)]
    return pa.table(
        {
            "chunk": pa.array([int(chunks[who[x[0]]]) for x in parts], pa.int64()),
            "keys": pa.array([out[x].tobytes() for x in parts], pa.binary()),
        }
    )


def _remove(window):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        copies, lists = _split_side(side)
        known = _least(np.concatenate([np.frombuffer(b, ITEM) for b in lists])) if lists else np.zeros(0, ITEM)
        copied = copy_mask(docs, copies)
        parts = list(_runs(docs, copies, skip=False))
        # The smallest doc of each window within this chunk, then with other chunks.
        per_run = []
        for rows, ids, buf, bounds in parts:
            starts, ends, doc, words = _words(buf, bounds)
            per_run.append((starts, ends, doc, np.flatnonzero(window_ok(doc, window)), _items(words, doc, ids, window)))
        every = np.concatenate([x[4] for x in per_run]) if per_run else np.zeros(0, ITEM)
        every = _least(np.concatenate([every, known]))
        out_id, out_n, out_gone, out_text = [], [], [], []
        for (rows, ids, buf, bounds), (starts, ends, doc, at, items) in zip(parts, per_run):
            n_docs = len(bounds) - 1
            place = np.searchsorted(every["a"], items["a"])
            for _ in range(8):  # equal first hashes, other second ones: next entry
                off = every["b"][np.minimum(place, len(every) - 1)] != items["b"] if len(every) else np.zeros(0, bool)
                if not off.any():
                    break
                place[off] += 1
            hit = every["doc"][place] < items["doc"] if len(items) else np.zeros(0, bool)
            hit |= copied[rows][doc[at]]
            gone = cover(at[hit], at[hit] + window, len(starts))
            n_words = np.bincount(doc, minlength=n_docs)
            n_gone = np.bincount(doc[gone], minlength=n_docs)
            s, e, d = starts[~gone], ends[~gone], doc[~gone]
            last = np.ones(len(s), dtype=bool)
            last[:-1] = d[1:] != d[:-1]
            out = buf.copy()
            out[e[~last]] = 0x20
            keep = cover(s, e + ~last, len(buf))
            out_id.append(ids)
            out_n.append(n_words)
            out_gone.append(n_gone)
            out_text.append(compact(out, keep, bounds))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        text = pa.chunked_array(out_text, pa.large_binary()).combine_chunks().cast(pa.binary())
        return pa.table(
            {
                "doc_id": null_ids(cat(out_id)),
                "n_words": pa.array(cat(out_n), pa.int64()),
                "n_removed": pa.array(cat(out_gone), pa.int64()),
                "kept_text": text.cast(pa.string()),
            }
        )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): kept words joined by one space."""
    buckets = key_buckets(docs)
    dealt = chunked(docs, id_col, text_col)
    copies = later_copies(docs, id_col, text_col).selectExpr("chunk", "0 kind", "doc_id", "tk blob")

    def beside(lists: DataFrame | None) -> DataFrame:
        if lists is None:
            return copies
        return copies.unionAll(lists.selectExpr("chunk", "1 kind", "cast(null as long) doc_id", "keys blob"))

    def each(side: DataFrame, fn, schema: str) -> DataFrame:
        return dealt.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(fn, schema)

    anchors = shared_keys(each(beside(None), _send_anchors(window, buckets), PACKED))
    windows = each(beside(anchors), _send_windows(window, buckets), PACKED)
    smaller = windows.groupBy("p").applyInArrow(_smallest, LISTS)
    return each(beside(smaller), _remove(window), "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
