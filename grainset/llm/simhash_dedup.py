"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprint: ASCII upper case lowered, words split at white space, ``shingle``-word shingles
(repeats included, words joined by a space; the whole sequence where there are fewer words),
XXH64 with seed 42; a bit is set if it is in over half the hashes. No words: zero.

Candidates: a fingerprint is cut into S = max(3, d + 1) segments. If two differ in at most d
bits, then some segment is equal and the next one (cyclically) differs in at most one bit:
otherwise each equal segment would be followed by two errors and S errors were needed. The
key is the equal segment and an index of the next one, decoded with the binary Golay code
[23, 12, 7]: all codewords within distance 4 of the word (1 or 6 of them). A word's nearest
codeword is within 3, so within 4 of any word one bit away, and the two share that index.
Equal keys are joined and verified by the Hamming distance. Keys that more than ``MOST``
distinct fingerprints share are resolved exactly without pairs: their members send all words
within distance 1, and members with a common word (so within two bits) link to the least.

Components of linked fingerprints come from alternating star contractions, each round
written to the checkpoint folder; only distinct fingerprints take part, so groups of copies
cost nothing.

Defined cases: null and empty texts have fingerprint zero, linked like any other; a null
doc_id is never the component's id unless no other exists; repeated rows repeat in the
result; an empty table gives an empty result; other columns are not read; a text over 1 MB is
read in parts that carry the last words over, so it takes a few bytes for each of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainset.session import reliable_checkpoint

from .common import PASS_BYTES, documents_frame, long_parts, text_buffers, token_spans

SHINGLE = 3
DISTANCE = 2
MOST = 64
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the [23, 12] code

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def long_fingerprint(raw: bytes, shingle: int, limit: int = PASS_BYTES) -> int:
    """The fingerprint of one text, read in parts of about ``limit`` bytes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    total, count, carried = np.zeros(64, dtype=np.int64), 0, []
    for part in long_parts(raw, limit):
        words = carried + part.lower().split()  # of bytes: ASCII letters and white space only
        n = max(len(words) - shingle + 1, 0)
        hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), 42) for i in range(n)), np.uint64, n)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        count += n
        carried = words[n:]
    if not count:
        return digest(b" ".join(carried), 42) if carried else 0
    return int(np.packbits(2 * total > count).view(np.uint64)[0])


def fingerprint_batch(column, shingle: int) -> np.ndarray:
    """uint64 fingerprints of a string column."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = [np.zeros(0, np.uint64)]
    for _, _, buf, bounds in text_buffers(column):
        n_docs = len(bounds) - 1
        if len(buf) > PASS_BYTES:  # one long text
            parts.append(np.array([long_fingerprint(buf.tobytes(), shingle)], dtype=np.uint64))
            continue
        buf = _lower[buf]
        starts, ends, doc = token_spans(buf, bounds)
        size = ends - starts
        to = np.cumsum(size + 1) - size - 1
        flat = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
        src = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(to, size) + src] = buf[np.repeat(starts, size) + src]
        words = np.bincount(doc, minlength=n_docs)
        first = np.concatenate([[0], np.cumsum(words)])
        take = np.minimum(words, shingle)
        count = np.where(words > 0, words - take + 1, 0)
        owner = np.repeat(np.arange(n_docs), count)
        at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        last = at + take[owner] - 1
        raw = flat.tobytes()
        spans = zip(to[at].tolist(), (to[last] + size[last]).tolist())
        hashes = np.fromiter((digest(raw[i:j], 42) for i, j in spans), np.uint64, len(at))
        out = np.zeros(n_docs, dtype=np.uint64)
        some = np.flatnonzero(count)
        if len(some):
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
            total = np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int64)
            out[some] = np.packbits(2 * total > count[some, None], axis=1).view(np.uint64).ravel()
        parts.append(out)
    return np.concatenate(parts)


def fingerprints(
    docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False
) -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed 64-bit number; if ``keyed`` also tk, the
    SHA-256 of the text (null for a null text)."""

    def run(batches):
        for batch in batches:
            fp = fingerprint_batch(batch.column(1), shingle).view(np.int64)
            tk = [batch.column(2)] if keyed else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *tk], names=["doc_id", "fp", "tk"][: 2 + keyed])

    frame = documents_frame(docs, id_col, text_col)
    if keyed:
        frame = frame.withColumn("tk", F.unhex(F.sha2("text", 256)))
    return frame.mapInArrow(run, "doc_id long, fp long" + ", tk binary" * keyed)


class Golay:
    """Syndrome tables of the [23, 12, 7] code."""

    def __init__(self):
        self.steps = np.zeros(23, dtype=np.int64)  # x^i modulo the generator
        r = 1
        for i in range(23):
            self.steps[i] = r
            r = (r << 1) ^ (GENERATOR if r & 0x400 else 0)
        self.near = np.full((2048, 6), -1, dtype=np.int64)
        one = 1 << np.arange(23)
        fill = np.zeros(2048, dtype=np.int64)
        patterns = [np.zeros(1, np.int64)]
        for _ in range(4):
            top = [int(p).bit_length() for p in patterns[-1]]
            patterns.append(np.concatenate([p | one[t:] for p, t in zip(patterns[-1], top)]))
        for group in patterns:
            for p, s in zip(group.tolist(), self.syndrome(group).tolist()):
                self.near[s, fill[s]] = p
                fill[s] += 1

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        for i in range(23):
            out ^= ((words >> i) & 1) * self.steps[i]
        return out

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) for every codeword within distance 4; the top 12 bits name it."""
        near = self.near[self.syndrome(words)]
        row, k = np.nonzero(near >= 0)
        return row, (words[row] ^ near[row, k]) >> 11


def _segments(distance: int) -> list[tuple[int, int]]:
    count = max(3, distance + 1)
    edge = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edge, edge[1:])]


def fuzzy_keys(fps: np.ndarray, distance: int, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each segment, it and the code indices of the next one."""
    seg = [((fps >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in _segments(distance)]
    rows, keys = [], []
    for i, exact in enumerate(seg):
        row, index = code.indices(seg[(i + 1) % len(seg)])
        rows.append(row)
        keys.append((np.int64(i) << 40) | (exact[row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(distance: int):
    def run(batches):
        code = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            row, key = fuzzy_keys(fps, distance, code)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64))], names=["key", "fp"])

    return run


def _emit_near(batches):
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        near = (fps[:, None] ^ flips[None, :]).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(fps, 65).view(np.int64))], names=["key", "fp"])


def links(distinct: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints ``fp`` that connect all pairs
    within ``distance`` bits (every such pair itself, except in overfull keys, where each
    member is linked to the least of those one flip round a common word)."""
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    keys = distinct.select("fp").mapInArrow(_emit_keys(distance), "key long, fp long")
    count = keys.groupBy("key").count().where("count > 1")
    full = count.where(F.col("count") > most).select("key")
    small = count.where(F.col("count") <= most).select("key")
    near = keys.join(small, "key")
    pairs = (
        near.withColumnRenamed("fp", "a")
        .join(near.withColumnRenamed("fp", "b"), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    crowd = keys.join(full, "key", "left_semi").select("fp").distinct()
    if distance < 2:  # a common word one flip away only proves two bits
        around = crowd.mapInArrow(_emit_near, "key long, fp long").where(
            F.bit_count(F.col("key").bitwiseXOR(F.col("fp"))) <= distance
        )
        met = around.join(crowd.withColumnRenamed("fp", "b"), F.col("key") == F.col("b")).select(F.col("fp").alias("a"), "b")
        met = met.where("a < b")
    else:
        around = crowd.mapInArrow(_emit_near, "key long, fp long")
        least = around.groupBy("key").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = around.join(least, "key").where("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes with a link.

    Alternating large-star and small-star contractions until the links stay the same."""
    edges = reliable_checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    known = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        edges = reliable_checkpoint(small)
        row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(u, v) % 1000003)")).first()
        if tuple(row) == known:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        known = tuple(row)


def simhash_dedup(
    docs: DataFrame,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id that
    links of at most ``distance`` differing bits reach."""
    marked = reliable_checkpoint(fingerprints(docs, shingle, id_col, text_col))
    least = _least(marked, F.col("doc_id"), distance, most).withColumnRenamed("least", "component_id")
    return marked.join(least, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame,
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One whole row of each component: smallest doc_id (null last), then smallest SHA-256 of
    the text (null text last). Of rows that repeat both, the one with the least hash of all
    columns stays, once."""
    marked = fingerprints(docs, shingle, id_col, text_col, keyed=True)
    marked = reliable_checkpoint(marked.groupBy("doc_id", "tk", "fp").agg(F.count(F.lit(1)).alias("n")))
    place = F.struct(F.isnull("doc_id"), "doc_id", F.isnull("tk"), "tk")
    found = marked.join(_least(marked, place, distance, most), "fp")
    doc, tk = docs[id_col].cast("long"), F.unhex(F.sha2(docs[text_col].cast("string"), 256))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias("key_id"), F.col("tk").alias("key_tk"))
        return rows.join(keys, doc.eqNullSafe(keys["key_id"]) & tk.eqNullSafe(keys["key_tk"]), how)

    out = among(docs, found.where(~place.eqNullSafe(F.col("least"))), "left_anti")
    if marked.where("n > 1").isEmpty():
        return out
    again = found.where(place.eqNullSafe(F.col("least")) & (F.col("n") > 1))
    row = F.struct(*[docs[c] for c in docs.columns])
    once = among(docs, again, "left_semi").groupBy(doc.alias("key_id"), tk.alias("key_tk"))
    once = once.agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return among(out, again, "left_anti").unionAll(once)


def _least(marked: DataFrame, value, distance: int, most: int) -> DataFrame:
    """(fp, least): the least value in the component of each fingerprint."""
    groups = marked.groupBy("fp").agg(F.min(value).alias("first"))
    roots = components(links(groups, distance, most))
    groups = groups.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = groups.groupBy("root").agg(F.min("first").alias("least"))
    return groups.join(least, "root").select("fp", "least")


def query(spark, sf_dir: str) -> DataFrame:
    out = simhash_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
