"""Suffix-array dedup with a run-length index: long byte matches over the whole corpus.

A byte is removed if a ``length``-byte string covering it also starts earlier (smaller
doc_id, or earlier in the same document). Strings are judged on the input, overlaps count
and matches never cross documents.

Method: every string of ``length`` bytes has one anchor, the least hashed ``GRAM``-byte
substring (leftmost of equals). Neighbouring strings with one anchor form a *context*.
Anchors that occur twice anywhere come from a packed key exchange. Their contexts are
aggregated to distinct ones with their earliest place; the distinct contexts of an anchor,
dealt by anchor, are indexed with a run-compressed Burrows-Wheeler transform with sampled
run ends, and streaming its matching statistics gives the strings that occur in several
contexts, of which all but the earliest are marked. Anchors with more than ``MOST_CONTEXTS``
distinct contexts (the edges of a passage that very many documents share) would not fit one
task: their strings are compared by 128-bit hashes in a partially aggregated shuffle, which
marks the same strings.

Defined cases: null text is empty; a null doc_id orders after all others; rows repeated with
one doc_id and text don't remove each other; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    BYTES,
    BYTES_B,
    NO_ID,
    chunked,
    compact,
    copy_mask,
    cover,
    ids_of,
    in_sorted,
    key_buckets,
    later_copies,
    null_ids,
    sizes,
    text_buffers,
)
from .repeats import PACKED, own_repeats, pack_keys, shared_keys
from .runlength_index import RunLengthIndex

LENGTH = 100
GRAM = 40
MOST_CONTEXTS = 20_000
INDEXES = 16  # built one after the other in a partition, to keep each small
SIDE = "chunk long, kind int, doc long, pos long, c1 long, c2 long, mask long, blob binary"
FOUND = "ak long, c1 long, c2 long, doc long, pos long, len long, chunk long"
MASKS = "c1 long, c2 long, mask long"
BODIES = "p long, ak long, c1 long, c2 long, doc long, pos long, body binary"
_U = np.uint64


def _sliding_min(v: np.ndarray, size: int) -> np.ndarray:
    out, have = v, 1
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(v) - size + 1], out[size - have :]) if have < size else out


class Contexts:
    """Contexts of one run of texts: first and last string start, anchor key, owner."""

    def __init__(self, buf, bounds, length, gram):
        self.buf, self.bounds, self.length = buf, bounds, length
        lens = np.diff(bounds)
        self.prefix = BYTES.prefix(buf)
        self.lo = self.hi = self.doc = np.zeros(0, np.int64)
        self.key = np.zeros(0, _U)
        long = lens >= length
        if not long.any():
            return
        grams = BYTES.windows(self.prefix, gram)
        packed = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=_U)
        least = _sliding_min(packed, length - gram + 1)
        valid = np.flatnonzero(cover(bounds[:-1][long], bounds[1:][long] - length + 1, len(least)))
        at = (least[valid] & _U(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(valid), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)
        first = np.flatnonzero(new)
        self.lo = valid[first]
        self.hi = valid[np.concatenate([first[1:], [len(valid)]]) - 1]
        self.key = grams[at[first]] & ~_U(1)
        self.doc = np.searchsorted(bounds, self.lo, "right") - 1

    def pick(self, on):
        self.lo, self.hi, self.key, self.doc = self.lo[on], self.hi[on], self.key[on], self.doc[on]

    def hashes(self):
        end = self.hi + self.length
        second = BYTES_B.prefix(self.buf)
        return BYTES.spans(self.prefix, self.lo, end), BYTES_B.spans(second, self.lo, end)

    def places(self):
        return self.lo - self.bounds[self.doc]


def _runs(docs: pa.Table, copies: set):
    rows = np.arange(docs.num_rows)
    if copies:
        rows = np.flatnonzero(~copy_mask(docs, copies))
        docs = docs.take(pa.array(rows))
    ids = ids_of(docs)
    for lo, hi, buf, bounds in text_buffers(docs.column("text")):
        yield rows[lo:hi], ids[lo:hi], buf, bounds


def _side_copies(side: pa.Table) -> set:
    t = side.filter(pc.equal(side.column("kind"), 0)) if side.num_rows else side
    return {(NO_ID if d is None else d, b) for d, b in zip(t.column("doc").to_pylist(), t.column("blob").to_pylist())}


def _send_anchors(length, gram, buckets):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pack_keys(0, np.zeros(0, _U), np.zeros(0, bool), 1)
        keys = [np.zeros(0, _U)]
        for _, _, buf, bounds in _runs(docs, _side_copies(side)):
            keys.append(Contexts(buf, bounds, length, gram).key)
        return pack_keys(docs.column("chunk")[0].as_py(), *own_repeats(np.concatenate(keys)), buckets)

    return run


def _earliest(c1, c2, doc, pos):
    """Order by context then place, and the first row of each context in that order."""
    order = np.lexsort((pos, doc, c2, c1))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])
    return order, new


def _send_contexts(length, gram):
    names = ("ak", "c1", "c2", "doc", "pos", "len")
    schema = pa.schema([(x, pa.int64()) for x in (*names, "chunk")])

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        lists = [b for k, b in zip(side.column("kind").to_pylist(), side.column("blob").to_pylist()) if k == 1]
        if not docs.num_rows or not lists:
            return schema.empty_table()
        shared = np.sort(np.concatenate([np.frombuffer(b, _U) for b in lists]))
        cols = {x: [] for x in names}
        for _, ids, buf, bounds in _runs(docs, _side_copies(side)):
            c = Contexts(buf, bounds, length, gram)
            c.pick(in_sorted(c.key, shared))
            for name, value in zip(names, (c.key, *c.hashes(), ids[c.doc], c.places(), c.hi + length - c.lo)):
                cols[name].append(value)
        if not cols["ak"]:
            return schema.empty_table()
        v = {k: np.concatenate(x) for k, x in cols.items()}
        order, new = _earliest(v["c1"], v["c2"], v["doc"], v["pos"])
        pick = order[new]
        out = {k: pa.array(v[k][pick].view(np.int64)) for k in names}
        return pa.table(out | {"chunk": pa.array(np.full(len(pick), docs.column("chunk")[0].as_py()))}, schema=schema)

    return run


def _send_bodies(buckets, most):
    """The bytes of the asked-for contexts; the hash tells texts of one doc_id apart.
    Contexts of an anchor with more than ``most`` are dealt apart, to buckets of their own."""
    schema = pa.schema(
        [("p", pa.int64())] + [(x, pa.int64()) for x in ("ak", "c1", "c2", "doc", "pos")] + [("body", pa.binary())]
    )

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        if not docs.num_rows or not side.num_rows:
            return schema.empty_table()
        ask = {x: side.column(x).to_numpy() for x in ("doc", "pos", "c1", "c2", "ak", "len", "count")}
        order = np.argsort(ask["doc"], kind="stable")
        ask = {k: v[order] for k, v in ask.items()}
        rows, bodies, seen = [], [], np.zeros(len(order), dtype=bool)
        for _, ids, buf, bounds in _runs(docs, set()):
            lo, hi = np.searchsorted(ask["doc"], ids, "left"), np.searchsorted(ask["doc"], ids, "right")
            doc = np.repeat(np.arange(len(ids)), hi - lo)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[doc]
            start = bounds[doc] + ask["pos"][at]
            end = start + ask["len"][at]
            ok = ~seen[at] & (end <= bounds[doc + 1])
            at, start, end = at[ok], start[ok], end[ok]
            ok = BYTES.spans(BYTES.prefix(buf), start, end) == ask["c1"][at].view(_U)
            at, start, end = at[ok], start[ok], end[ok]
            _, once = np.unique(at, return_index=True)
            at, start, end = at[once], start[once], end[once]
            seen[at] = True
            rows.append(at)
            bodies += [buf[i:j].tobytes() for i, j in zip(start.tolist(), end.tolist())]
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        out = {x: pa.array(ask[x][at]) for x in ("ak", "c1", "c2", "doc", "pos")}
        p = bucket_numbers(ask["ak"][at], ask["c1"][at], ask["count"][at] > most, buckets)
        return pa.table({"p": pa.array(p)} | out | {"body": pa.array(bodies, pa.binary())}, schema=schema)

    return run


def bucket_numbers(anchor: np.ndarray, context: np.ndarray, apart: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each context: below ``buckets`` by its anchor, else (apart) from there on by
    itself, over 64 times as many."""
    p = ((anchor.view(_U) >> _U(24)) % _U(buckets)).astype(np.int64)
    alone = buckets + ((context.view(_U) >> _U(24)) % _U(buckets * 64)).astype(np.int64)
    return np.where(apart, alone, p)


def _body_arrays(table: pa.Table):
    arr = table.column("body").combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    arr = arr.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    return np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def _string_starts(off, length):
    """Context, start offset in it and start in the joined bytes of every string."""
    count = np.diff(off) - length + 1
    ctx = np.repeat(np.arange(len(count)), count)
    shift = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    return ctx, shift, off[:-1][ctx] + shift, count


def _index(length, buckets):
    """Masks (one bit for each string of a context) of strings that occur earlier in another."""

    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pc.less(table.column("p"), buckets))
        ak = table.column("ak").to_numpy()
        _, inverse, count = np.unique(ak, return_inverse=True, return_counts=True)
        table = table.take(pa.array(np.flatnonzero(count[inverse] > 1)))
        masks = np.zeros(table.num_rows, _U)
        if table.num_rows:
            data, off = _body_arrays(table)
            ctx, shift, at, count = _string_starts(off, length)
            label = RunLengthIndex(data, off[1:]).classes(at, length)
            doc, pos = table.column("doc").to_numpy()[ctx], table.column("pos").to_numpy()[ctx] + shift
            order = np.lexsort((pos, doc, label))
            later = np.zeros(len(order), dtype=bool)
            later[1:] = label[order][1:] == label[order][:-1]
            # equal places of one document (repeated rows) are the same string
            same = (doc[order][1:] == doc[order][:-1]) & (pos[order][1:] == pos[order][:-1])
            later[1:] &= ~same | later[:-1]
            mark = np.zeros(len(order), dtype=bool)
            mark[order] = later
            bits = np.where(mark, _U(1) << shift.astype(_U), _U(0))
            masks = np.bitwise_or.reduceat(bits, np.cumsum(count) - count)
        on = masks != 0
        out = {x: table.column(x).to_numpy()[on] for x in ("c1", "c2")}
        return pa.table(out | {"mask": masks[on].view(np.int64)})

    return run


def _strings(length, buckets):
    """Rows for each string of the contexts of anchors too frequent for one task."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.greater_equal(table.column("p"), buckets))
            if not table.num_rows:
                continue
            data, off = _body_arrays(table)
            ctx, shift, at, _ = _string_starts(off, length)
            out = {
                "w1": BYTES.spans(BYTES.prefix(data), at, at + length).view(np.int64),
                "w2": BYTES_B.spans(BYTES_B.prefix(data), at, at + length).view(np.int64),
                "doc": table.column("doc").to_numpy()[ctx],
                "pos": table.column("pos").to_numpy()[ctx] + shift,
                "c1": table.column("c1").to_numpy()[ctx],
                "c2": table.column("c2").to_numpy()[ctx],
                "bit": (_U(1) << shift.astype(_U)).view(np.int64),
            }
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})

    return run


def _remove(length, gram):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        copies = _side_copies(side)
        copied = copy_mask(docs, copies)
        listed = side.filter(pc.equal(side.column("kind"), 1)) if side.num_rows else side
        col = lambda c: listed.column(c).to_numpy()
        k1, k2 = col("c1").view(_U), col("c2").view(_U)
        order = np.lexsort((k2, k1))
        k1, k2, kd, kp, km = k1[order], k2[order], col("doc")[order], col("pos")[order], col("mask").view(_U)[order]
        parts = []
        for rows, ids, buf, bounds in _runs(docs, set()):
            c = Contexts(buf, bounds, length, gram)
            parts.append((rows, ids, buf, bounds, c, *c.hashes()))
        cat = lambda xs, kind=np.int64: np.concatenate(xs) if xs else np.zeros(0, kind)
        c1, c2 = cat([x[5] for x in parts], _U), cat([x[6] for x in parts], _U)
        doc = cat([x[1][x[4].doc] for x in parts])
        pos = cat([x[4].places() for x in parts])
        order, new = _earliest(c1, c2, doc, pos)
        lead = order[new][np.cumsum(new) - 1] if len(order) else order
        whole = np.zeros(len(order), dtype=bool)
        whole[order] = (doc[order] != doc[lead]) | (pos[order] != pos[lead])
        mask = np.zeros(len(order), dtype=_U)
        if len(k1):
            at = np.searchsorted(k1, c1)
            for _ in range(8):
                i = np.minimum(at, len(k1) - 1)
                off = (k1[i] == c1) & (k2[i] != c2) & (at < len(k1) - 1)
                if not off.any():
                    break
                at[off] += 1
            i = np.minimum(at, len(k1) - 1)
            hit = (k1[i] == c1) & (k2[i] == c2)
            here = hit & (kd[i] == doc) & (kp[i] == pos)
            whole = np.where(hit, ~here, whole)
            mask = np.where(here, km[i], _U(0))
        out = {x: [] for x in ("doc_id", "n_bytes", "n_removed", "n_spans")}
        kept, done = [], 0
        for rows, ids, buf, bounds, c, _, _ in parts:
            n, w, m = len(buf), whole[done : done + len(c.lo)], mask[done : done + len(c.lo)]
            done += len(c.lo)
            starts, ends = [c.lo[w]], [c.hi[w] + length]
            some = np.flatnonzero(m)
            if len(some):
                bits = ((m[some, None] >> np.arange(64, dtype=_U)) & _U(1)).astype(bool)
                i, shift = np.nonzero(bits)
                starts.append(c.lo[some[i]] + shift)
                ends.append(c.lo[some[i]] + shift + length)
            lens = np.diff(bounds)
            gone_docs = copied[rows] & (lens >= length)
            starts.append(bounds[:-1][gone_docs])
            ends.append(bounds[1:][gone_docs])
            gone = cover(np.concatenate(starts), np.concatenate(ends), n)
            total = np.concatenate([[0], np.cumsum(gone)])
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            edge = bounds[:-1][lens > 0]
            first[edge] = gone[edge]
            spans = np.concatenate([[0], np.cumsum(first)])
            out["doc_id"].append(ids)
            out["n_bytes"].append(lens)
            out["n_removed"].append(np.diff(total[bounds]))
            out["n_spans"].append(np.diff(spans[bounds]))
            kept.append(compact(buf, ~gone, bounds))
        cols = {k: pa.array(cat(v), pa.int64()) for k, v in out.items()}
        cols["doc_id"] = null_ids(cat(out["doc_id"]))
        cols["kept"] = pa.chunked_array(kept, pa.large_binary()).combine_chunks().cast(pa.binary())
        return pa.table(cols)

    return run


def suffix_dedup(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    most_contexts: int = MOST_CONTEXTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is binary, as cuts may fall inside
    a character. A context holds length - gram + 1 strings at most, so this is 64 or less."""
    if not 0 < gram <= length or length - gram >= 64:
        raise ValueError("gram must be within 63 bytes of length")
    parts, _ = sizes(docs)
    groups = parts * INDEXES
    dealt = chunked(docs, id_col, text_col)
    none = "cast(null as long)"
    copies = later_copies(docs, id_col, text_col).selectExpr(
        "chunk", "0 kind", "doc_id doc", f"{none} pos", f"{none} c1", f"{none} c2", f"{none} mask", "tk blob"
    )

    def each(side: DataFrame, fn, schema: str) -> DataFrame:
        return dealt.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(fn, schema)

    anchors = shared_keys(each(copies, _send_anchors(length, gram, key_buckets(docs)), PACKED))
    lists = anchors.selectExpr(
        "chunk", "1 kind", f"{none} doc", f"{none} pos", f"{none} c1", f"{none} c2", f"{none} mask", "keys blob"
    )
    found = each(copies.unionAll(lists), _send_contexts(length, gram), FOUND)
    found = found.where("c1 is not null and c2 is not null")
    # A context occurs at most once for each chunk here, so its group is small.
    same = Window.partitionBy("c1", "c2")
    found = found.withColumn("first", F.min(F.struct("doc", "pos")).over(same))
    found = found.withColumn("n", F.count(F.lit(1)).over(same))
    # These conditions hold for every row: all readers below then ask for the same columns and
    # have no other conditions to push down, so they share one exchange.
    found = found.where("chunk >= 0 and len > 0 and ak is not null")
    distinct = found.where(F.struct("doc", "pos") == F.col("first")).drop("first", "n")
    count = distinct.groupBy("ak").count().where("count > 1")
    asked = distinct.join(count, "ak")
    asked = asked.select("chunk", "doc", "pos", "c1", "c2", "ak", "len", "count")
    bodies = each(asked, _send_bodies(groups, most_contexts), BODIES).repartition(parts, "p")
    masks = bodies.groupBy("p").applyInArrow(_index(length, groups), MASKS)
    strings = bodies.mapInArrow(
        _strings(length, groups), "w1 long, w2 long, doc long, pos long, c1 long, c2 long, bit long"
    )
    earliest = strings.groupBy("w1", "w2").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    late = strings.join(earliest.where("n > 1").select("w1", "w2", "first"), ["w1", "w2"]).where(
        F.struct("doc", "pos") != F.col("first")
    )
    masks = masks.unionAll(late.groupBy("c1", "c2").agg(F.expr("bit_or(bit)").alias("mask")))
    back = (
        found.join(masks, ["c1", "c2"], "left")
        .where("n > 1 or mask is not null")
        .selectExpr(
            "chunk", "1 kind", "first.doc", "first.pos", "c1", "c2", "coalesce(mask, 0L) mask", "cast(null as binary) blob"
        )
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return each(copies.unionAll(back), _remove(length, gram), schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
