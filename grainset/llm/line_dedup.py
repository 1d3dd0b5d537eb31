"""Line dedup: exact copies and lines within one word edit, by deletion neighbourhoods.

A line is what ``\\n`` separates; it is compared as its sequence of words (ASCII lower case).
A line is removed if an earlier line (smaller doc_id, then line number) has the same words,
or if it has ``min_near_words`` or more words, is the first of its own words, and an earlier
line of that many words is within one inserted, deleted or replaced word. All lines are
judged on the input. Lines of fewer than ``min_words`` words stay.

Method: a line's variants are its hash with one word left out. Two lines of equal length
within a replacement share the variant at the replaced place; a line within an insertion of
another equals one of the longer one's variants. Equal keys are joined, each line with the
earliest other one, so a family of near copies gives a link for each line and no pairs; the
linked lines' words are compared again (edit distance). Before that, lines are left out that
share neither the first nor the second half with another line: of two lines one edit apart,
one half is untouched. Half keys and whole-line keys go through packed exchanges, reduced
within a chunk first.

Defined cases: a null text stays null; a null doc_id orders after all others; rows repeated
with one doc_id are the same lines and don't remove each other; a document may become empty
and stays as a row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    NO_ID,
    NOT_SPACE,
    SEQ_A,
    SEQ_B,
    chunked,
    compact,
    cover,
    ids_of,
    in_sorted,
    key_buckets,
    mix,
    null_ids,
    text_buffers,
    token_spans,
    word_hashes,
)
from .repeats import split_buckets
from .simhash_dedup import _lower

# Exact copies of any length, and one word edit from one word in four on (below, most such
# pairs meet by chance; figures in the README).
MIN_WORDS = 1
MIN_NEAR_WORDS = 4
EVERY_LINE = {"min_words": MIN_WORDS, "min_near_words": MIN_NEAR_WORDS}
HALVES, LINES, NEAR = 0, 1, 2
REPLACED, WHOLE, DELETED, WORDS = 0, 1, 2, 9
HALF = np.dtype([("key", "<u8"), ("a", "<u8")])
LINE = np.dtype([("a", "<u8"), ("b", "<u4"), ("doc", "<i8"), ("no", "<i4")])
SENT = "p int, kind int, chunk long, keys binary"
SIDE = "chunk long, kind int, keys binary"
VARIANTS = "key long, a long, kind int, doc long, no int, chunk long, words binary"
_U = np.uint64


class Lines:
    """Lines with a word of one run of texts: spans, word ranges, hashes, places."""

    def __init__(self, ids, buf, bounds):
        self.buf, self.bounds = buf, bounds
        lens = np.diff(bounds)
        stop = np.flatnonzero(buf == 10)
        some = np.flatnonzero(lens > 0)
        doc = np.concatenate([some, np.searchsorted(bounds, stop, "right") - 1])
        start = np.concatenate([bounds[:-1][some], stop + 1])
        order = np.lexsort((start, doc))
        self.doc, self.start = doc[order], start[order]
        last = np.ones(len(doc), dtype=bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        self.end = np.empty(len(doc), dtype=np.int64)
        self.end[:-1] = self.start[1:] - 1
        self.end[last] = bounds[self.doc[last] + 1]
        begin = np.searchsorted(self.doc, self.doc, "left")
        self.no = (np.arange(len(doc)) - begin).astype(np.int32)
        low = _lower[buf]
        starts, ends, _ = token_spans(low, bounds, NOT_SPACE)
        self.words = word_hashes(low, starts, ends)
        self.lo = np.searchsorted(starts, self.start, "left")
        self.hi = np.maximum(np.searchsorted(starts, self.end, "left"), self.lo)
        self.n = self.hi - self.lo
        self.pre = SEQ_A.prefix(self.words)
        self.a = SEQ_A.spans(self.pre, self.lo, self.hi)
        self.b = SEQ_B.spans(SEQ_B.prefix(self.words), self.lo, self.hi).astype(np.uint32)
        self.id = ids[self.doc]

    def halves(self, at):
        """Four half keys of the lines ``at``: as themselves, and as one word longer than another."""
        lo, hi, n = self.lo[at], self.hi[at], self.n[at]
        out = []
        for m in (n, n - 1):
            cut = m // 2
            for side, (i, j) in enumerate(((lo, lo + cut), (hi - (m - cut), hi))):
                out.append(mix(SEQ_A.spans(self.pre, i, j) + (2 * m + side).astype(_U)) & ~_U(1))
        return out

    def table(self, at) -> np.ndarray:
        out = np.empty(len(at), LINE)
        out["a"], out["b"], out["doc"], out["no"] = self.a[at], self.b[at], self.id[at], self.no[at]
        return out


def _first(items: np.ndarray) -> np.ndarray:
    """Positions of each line's earliest place, ordered by line."""
    order = np.lexsort((items["no"], items["doc"], items["b"], items["a"]))
    new = np.ones(len(order), dtype=bool)
    s = items[order]
    new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
    return order[new]


def _runs(docs: pa.Table):
    ids = ids_of(docs)
    for lo, hi, buf, bounds in text_buffers(docs.column("text")):
        yield lo, hi, Lines(ids[lo:hi], buf, bounds)


def _send(min_words, min_near, buckets):
    def run(docs: pa.Table) -> pa.Table:
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
        lines, halves = [np.zeros(0, LINE)], [np.zeros(0, HALF)]
        for _, _, x in _runs(docs):
            at = np.flatnonzero(x.n >= min_words)
            lines.append(x.table(at))
            at = np.flatnonzero(x.n >= min_near)
            for key in x.halves(at):
                part = np.empty(len(at), HALF)
                part["key"], part["a"] = key, x.a[at]
                halves.append(part)
        lines = np.concatenate(lines)
        lines = lines[_first(lines)]
        halves = np.concatenate(halves)
        halves = halves[np.lexsort((halves["a"], halves["key"]))]
        new = np.ones(len(halves), dtype=bool)
        new[1:] = halves["key"][1:] != halves["key"][:-1]
        other = np.zeros(len(halves), dtype=bool)
        other[1:] = ~new[1:] & (halves["a"][1:] != halves["a"][:-1])
        many = np.zeros(int(new.sum()), dtype=bool)
        many[(np.cumsum(new) - 1)[other]] = True
        halves = halves[new]
        halves["key"] |= many.astype(_U)
        out = {"p": [], "kind": [], "keys": []}
        for kind, items, by in ((HALVES, halves, halves["key"]), (LINES, lines, lines["a"])):
            for p, part in split_buckets(by, buckets):
                out["p"].append(p)
                out["kind"].append(kind)
                out["keys"].append(items[part].tobytes())
        return pa.table(
            {
                "p": pa.array(out["p"], pa.int32()),
                "kind": pa.array(out["kind"], pa.int32()),
                "chunk": pa.array([chunk] * len(out["p"]), pa.int64()),
                "keys": pa.array(out["keys"], pa.binary()),
            }
        )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """For HALVES the keys that two different lines share; for LINES those whose first place
    is in another chunk, with that place; to each chunk its own."""
    kind = table.column("kind")[0].as_py()
    dtype = HALF if kind == HALVES else LINE
    blobs, chunks = table.column("keys").to_pylist(), table.column("chunk").to_numpy()
    items = np.concatenate([np.frombuffer(b, dtype) for b in blobs])
    owner = np.repeat(np.arange(len(blobs)), [len(b) // dtype.itemsize for b in blobs])
    if kind == HALVES:
        key = items["key"] >> _U(1)
        order = np.lexsort((items["a"], key))
        key, a, many, owner = key[order], items["a"][order], items["key"][order] & _U(1), owner[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        differ = np.zeros(len(key), dtype=bool)
        differ[1:] = ~new[1:] & (a[1:] != a[:-1])
        on = (np.bincount(group, weights=differ + many.astype(float)) > 0)[group]
        out, owner = (key[on] << _U(1)), owner[on]
    else:
        order = np.lexsort((items["no"], items["doc"], items["b"], items["a"]))
        items, owner = items[order], owner[order]
        new = np.ones(len(items), dtype=bool)
        new[1:] = (items["a"][1:] != items["a"][:-1]) | (items["b"][1:] != items["b"][:-1])
        first = items[new][np.cumsum(new) - 1]
        on = (first["doc"] != items["doc"]) | (first["no"] != items["no"])
        out, owner = first[on], owner[on]
    order = np.argsort(owner, kind="stable")
    out, owner = out[order], owner[order]
    parts = [x for x in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1) if len(x)]
    return pa.table(
        {
            "chunk": pa.array([int(chunks[owner[x[0]]]) for x in parts], pa.int64()),
            "kind": pa.array([kind] * len(parts), pa.int32()),
            "keys": pa.array([out[x].tobytes() for x in parts], pa.binary()),
        }
    )


def _blobs(side: pa.Table, kind: int, dtype) -> np.ndarray:
    part = side.filter(pc.equal(side.column("kind"), kind)) if side.num_rows else side
    return np.concatenate([np.zeros(0, dtype)] + [np.frombuffer(b, dtype) for b in part.column("keys").to_pylist()])


def _send_variants(min_near):
    names = [x.split()[0] for x in VARIANTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        shared = np.sort(_blobs(side, HALVES, _U)) if docs.num_rows else np.zeros(0, _U)
        elsewhere = np.sort(_blobs(side, LINES, LINE)["a"])  # lines whose first place is in another chunk
        if not len(shared):
            return schema.empty_table()
        chunk, done, out = docs.column("chunk")[0].as_py(), [], []
        parts = []
        for _, _, x in _runs(docs):
            at = np.flatnonzero(x.n >= min_near)
            hits = np.stack([in_sorted(k, shared) for k in x.halves(at)])
            on = hits.any(axis=0) & ~in_sorted(x.a[at], elsewhere)
            parts.append((x, at[on], hits[:, on]))
            done.append(x.table(at[on]))
        if not sum(len(d) for d in done):
            return schema.empty_table()
        keep = np.zeros(sum(len(d) for d in done), dtype=bool)
        keep[_first(np.concatenate(done))] = True
        base = 0
        for x, at, hits in parts:
            here = keep[base : base + len(at)]
            base += len(at)
            for i, same_head, same_tail, long_head, long_tail in zip(at[here].tolist(), *hits[:, here].tolist()):
                lo, hi, n = int(x.lo[i]), int(x.hi[i]), int(x.n[i])
                words = x.words[lo:hi]
                place = np.arange(n)
                # Hash of the line without word k: what stands before it and, moved up, after it.
                pre = SEQ_A.prefix(words)
                rest = (pre[n] - pre[place + 1]) * _U(SEQ_A.inv)
                cut = mix(pre[place] + rest)
                rows = [(x.a[i : i + 1], WHOLE)] if same_head or same_tail else []
                use = (place >= n // 2) & same_head | (place < n // 2) & same_tail
                if use.any():
                    rows.append((mix(cut[use] + (place[use].astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)), REPLACED))
                half = (n - 1) // 2
                use = (place >= half) & long_head | (place <= half) & long_tail
                if use.any() and n > min_near:
                    rows.append((np.unique(cut[use]), DELETED))
                out.append((x.a[i], x.id[i], x.no[i], rows, words.tobytes()))
        count = [sum(len(k) for k, _ in r[3]) + 1 for r in out]
        key = np.concatenate([np.concatenate([*[k for k, _ in r[3]], mix(np.array([r[0]]))]) for r in out])
        kind = np.concatenate([np.concatenate([*[np.full(len(k), t) for k, t in r[3]], [WORDS]]) for r in out])
        words = np.full(len(key), None, dtype=object)
        words[np.cumsum(count) - 1] = [r[4] for r in out]
        rep = lambda j, t: np.repeat(np.array([r[j] for r in out], dtype=t), count)
        cols = [
            pa.array(key.view(np.int64)),
            pa.array(rep(0, _U).view(np.int64)),
            pa.array(kind, pa.int32()),
            pa.array(rep(1, np.int64)),
            pa.array(rep(2, np.int32)),
            pa.array(np.full(len(key), chunk)),
            pa.array(words, pa.binary()),
        ]
        return pa.Table.from_arrays(cols, schema=schema)

    return run


def within_one(x: np.ndarray, y: np.ndarray) -> bool:
    """Edit distance of at most one item."""
    if len(x) > len(y):
        x, y = y, x
    n, m = len(x), len(y)
    if m - n > 1:
        return False
    head = int(np.argmin(np.append(x == y[:n], False)))
    tail = int(np.argmin(np.append((x == y[m - n :])[::-1], False)))
    return head + tail >= m - 1


def _verify(batches):
    for batch in batches:
        one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ok = [within_one(np.frombuffer(x, _U), np.frombuffer(y, _U)) for x, y in zip(one, two)]
        batch = batch.filter(pa.array(ok, pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["chunk", "a"])


def near_lines(variants: DataFrame) -> DataFrame:
    """(chunk, a): first occurrences that an earlier line is within one edit of, verified."""
    # A line is sent once, so this only puts its rows behind one exchange for the three readers
    # below; the conditions spare them each an inferred one, which would part them again.
    x = variants.where("key is not null and a is not null").groupBy("key", "a").agg(F.min(F.struct("kind", "doc", "no", "chunk", "words")).alias("o"))
    place = F.struct(F.col("o.doc").alias("doc"), F.col("o.no").alias("no"), F.col("a").alias("a"))
    least = lambda kind: F.min(F.when(F.col("o.kind") == kind, place))
    keys = x.where(F.col("o.kind") != WORDS).groupBy("key")
    best = keys.agg(
        least(REPLACED).alias("s"), least(WHOLE).alias("w"), least(DELETED).alias("d"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    kind = F.col("o.kind")
    partner = F.when(kind == REPLACED, F.col("s")).when(kind == DELETED, F.col("w")).otherwise(F.col("d"))
    linked = x.where(kind != WORDS).join(best, "key").withColumn("q", partner)
    before = F.struct("q.doc", "q.no") < F.struct("o.doc", "o.no")
    linked = linked.where(before).groupBy("a").agg(F.min("q").alias("q"), F.min("o.chunk").alias("chunk"))
    words = x.where(kind == WORDS).select(F.col("a").alias("w_a"), F.col("o.words").alias("words"))
    linked = linked.select("chunk", "a", F.col("q.a").alias("b")).join(words, F.col("a") == F.col("w_a")).drop("w_a")
    linked = linked.join(words.withColumnRenamed("words", "other"), F.col("b") == F.col("w_a"))
    return linked.select("chunk", "a", "words", "other").mapInArrow(_verify, "chunk long, a long")


def _remove(min_words, carry):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        known = _blobs(side, LINES, LINE)
        near = np.sort(_blobs(side, NEAR, np.dtype(">u8")).astype(_U))
        parts = list(_runs(docs))
        every = np.concatenate([np.zeros(0, LINE)] + [x.table(np.arange(len(x.a))) for _, _, x in parts])
        both = np.concatenate([every, known])
        order = np.lexsort((both["no"], both["doc"], both["b"], both["a"]))
        s = both[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])
        first = s[new][np.cumsum(new) - 1] if len(s) else s
        late = np.zeros(len(s), dtype=bool)
        late[order] = (first["doc"] != s["doc"]) | (first["no"] != s["no"])
        out = {"n_lines": [], "n_exact": [], "n_near": []}
        kept, base = [], 0
        for _, _, x in parts:
            m = len(x.a)
            exact = late[base : base + m] & (x.n >= min_words)
            close = ~exact & in_sorted(x.a, near) & (x.n >= min_words)
            base += m
            docs_n = len(x.bounds) - 1
            real = x.n > 0
            out["n_lines"].append(np.bincount(x.doc[real], minlength=docs_n))
            out["n_exact"].append(np.bincount(x.doc[exact], minlength=docs_n))
            out["n_near"].append(np.bincount(x.doc[close], minlength=docs_n))
            stay = ~(exact | close)
            start, end, doc = x.start[stay], x.end[stay], x.doc[stay]
            last = np.ones(len(start), dtype=bool)
            last[:-1] = doc[1:] != doc[:-1]
            end = end + ~last
            solid = end > start
            kept.append(compact(x.buf, cover(start[solid], end[solid], len(x.buf)), x.bounds))
        cols = {"doc_id": null_ids(ids_of(docs))}
        cols |= {k: pa.array(np.concatenate([np.zeros(0, np.int64), *v]), pa.int64()) for k, v in out.items()}
        text = pa.chunked_array(kept, pa.large_binary()).combine_chunks().cast(pa.binary()).cast(pa.string())
        gone = docs.column("text").is_null().combine_chunks()
        cols["text"] = pc.if_else(gone, pa.scalar(None, pa.string()), text)
        if carry:
            cols["rest"] = docs.column("rest")
        return pa.table(cols)

    return run


def line_dedup(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_near_words: int = MIN_NEAR_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """doc_id, n_lines (with a word), n_exact and n_near (removed), text (kept lines); with
    ``carry`` also ``rest``, a struct of the input row's other columns."""
    buckets = key_buckets(docs)
    dealt = chunked(docs, id_col, text_col, carry)

    def each(side: DataFrame, fn, schema) -> DataFrame:
        return dealt.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(fn, schema)

    sent = dealt.groupBy("chunk").applyInArrow(_send(min_words, min_near_words, buckets), SENT)
    lists = sent.groupBy("p", "kind").applyInArrow(_answer, SIDE).repartition("chunk")
    variants = each(lists, _send_variants(min_near_words), VARIANTS)
    near = near_lines(variants).groupBy("chunk", "a").count()
    big_endian = F.unhex(F.lpad(F.hex("a"), 16, "0"))
    near = near.select("chunk", F.lit(NEAR).alias("kind"), big_endian.alias("keys"))
    fields = [T.StructField(c, T.LongType()) for c in ("doc_id", "n_lines", "n_exact", "n_near")]
    fields.append(T.StructField("text", T.StringType()))
    if carry:
        fields.append(T.StructField("rest", dealt.schema["rest"].dataType))
    return each(lists.unionAll(near), _remove(min_words, carry), T.StructType(fields))


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), **EVERY_LINE)
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("kept_sha256"))
