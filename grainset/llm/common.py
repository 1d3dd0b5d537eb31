"""Shared pieces of the text operators: chunked exchange, byte/word scanning, rolling hashes.

Text is processed as UTF-8 bytes with numpy inside Spark tasks; a *chunk* is a group of
documents that one task handles together. Chunks come from a hash of the document key, so
they are the same whenever a lost task is run again, and copies of one text are spread over
many chunks. Whatever a chunk sends to a shuffle is first reduced inside the chunk, so a key
that occurs in a third of all rows crosses the network at most once per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainset.session import estimated_bytes

# Raw text bytes a chunk should hold; text is taken as three times its Parquet size.
CHUNK_BYTES = 8 << 20
TEXT_PER_FILE_BYTE = 3
# Bytes handled by one numpy pass (arrays of eight bytes per text byte follow; the tables of
# powers double when a pass holds more than a power of two).
PASS_BYTES = (1 << 20) - 2
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
# Catalyst gives frames of unknown size about this many bytes; then the session decides.
NO_ESTIMATE = 1 << 60

_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Poly:
    """Polynomial hash modulo 2^64 over a sequence: any span's hash from prefix sums."""

    def __init__(self, seed: int):
        base = (0xD6E8FEB86659FD93 + 2 * seed * 0x9E3779B97F4A7C15) & _MASK | 5
        self.base = base
        self.inv = pow(base, -1, 1 << 64)
        self.table = _splitmix(256, seed)
        self._pow = self._inv = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._pow) <= n:
            size = 1 << max(12, math.ceil(math.log2(n + 2)))
            for name, b in (("_pow", self.base), ("_inv", self.inv)):
                a = np.full(size, b, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums for uint64 values, or for bytes through a random table."""
        self._grow(len(values))
        if values.dtype == np.uint8:
            values = self.table[values]
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self._pow[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self._inv[start])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hashes of every run of ``size`` consecutive values."""
        n = len(prefix) - 1 - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((prefix[size : size + n] - prefix[:n]) * self._inv[:n])


BYTES = Poly(11)
BYTES_B = Poly(23)
SEQ_A = Poly(37)
SEQ_B = Poly(53)

_sep = np.zeros(256, dtype=bool)
_sep[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~_sep
SPACES = [bytes([b]) for b in np.flatnonzero(_sep)]


def text_buffers(column, limit: int = PASS_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of whole texts of about ``limit`` bytes.

    Yields (first row, row after the last, bytes, text offsets); nulls count as empty. A
    text longer than the limit makes a run of its own.
    """
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_string())
    arr = arr.fill_null("").cast(pa.large_binary() if pa.types.is_binary(arr.type) else pa.large_string())
    if not len(arr):
        return
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(len(arr), max(hi, lo + 1))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def long_parts(raw: bytes, limit: int = PASS_BYTES) -> Iterator[bytes]:
    """A long text in parts of at most ``limit`` bytes that end behind white space, so that no
    word is cut; a word longer than that is a part by itself (with one blank behind it)."""
    lo = 0
    while lo < len(raw):
        hi = lo + limit
        if hi < len(raw):
            hi = max(raw.rfind(c, lo, hi) for c in SPACES) + 1
            if hi <= lo:
                ends = [e for e in (raw.find(c, lo + limit) for c in SPACES) if e >= 0]
                hi = min(ends, default=len(raw)) + 1
        yield raw[lo:hi]
        lo = hi


def token_spans(buf: np.ndarray, bounds: np.ndarray, member: np.ndarray = NOT_SPACE):
    """Maximal runs of member bytes inside each text: (starts, ends, text index)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = member[buf]
    before = np.empty(n, dtype=bool)
    before[1:] = inside[:-1]
    before[0] = False
    first = bounds[:-1]
    before[first[first < n]] = False
    after = np.empty(n, dtype=bool)
    after[:-1] = inside[1:]
    after[-1] = False
    after[bounds[1:] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return BYTES.spans(BYTES.prefix(buf), starts, ends)


def window_ok(owner: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` items lie within one owner."""
    n = len(owner) - size + 1
    return owner[:n] == owner[size - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Positions below n covered by any run [start, end)."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def compact(buf: np.ndarray, keep: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The kept bytes of every text as a binary column."""
    total = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    data = buf[keep]
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(total[bounds]), pa.py_buffer(np.ascontiguousarray(data))]
    )


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def sizes(df: DataFrame) -> tuple[int, int]:
    """(shuffle partitions, chunks): two chunks to a partition. A chunk sends a row to each
    key bucket, so there are fewer buckets than partitions (``key_buckets``)."""
    size = estimated_bytes(df) or 0
    raw = size * TEXT_PER_FILE_BYTE if size < NO_ESTIMATE else 0
    parts = max(shuffle_partitions(df), math.ceil(raw / (4 * CHUNK_BYTES)))
    return parts, parts * 2


def key_buckets(df: DataFrame) -> int:
    return max(1, sizes(df)[0] // 2)


def small_batches(df: DataFrame) -> DataFrame:
    """Texts are long, so 10,000 of them (Spark's default) make Arrow batches that several
    tasks and the Python workers of an executor can't hold at once; lower that setting."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_SETTING, "10000")) > BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df


def documents_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) by position of the first such column, whatever else the table holds."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Deal (doc_id, text, tk) by chunk. Every user of this frame reads the same exchange.

    ``tk`` is the SHA-256 of the text. A null doc_id is dealt by text and stays null. With
    ``carry``, column ``rest`` holds the row's other columns by position.
    """
    parts, chunks = sizes(docs)
    frame = small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if carry else []),
    )
    tk = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    frame = frame.withColumn("tk", tk).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tk"), F.lit(chunks)))
    return frame.repartition(parts, "chunk")


NO_ID = (1 << 63) - 1  # a null doc_id orders after every other


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, doc_id, tk) of the rows whose whole text a smaller doc_id also has."""
    _, chunks = sizes(docs)
    tk = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), tk.alias("tk"))
    first = ids.groupBy("tk").agg(
        F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    first = first.where("n > 1").select("tk", "first_id")
    rest = ids.join(first, "tk").where(F.coalesce("doc_id", F.lit(NO_ID)) > F.col("first_id"))
    return rest.select(F.pmod(F.xxhash64("doc_id", "tk"), F.lit(chunks)).alias("chunk"), "doc_id", "tk").distinct()


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(NO_ID).to_numpy().astype(np.int64)


def null_ids(ids) -> pa.Array:
    ids = np.asarray(ids, dtype=np.int64)
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def copy_mask(table: pa.Table, copies: set) -> np.ndarray:
    if not copies:
        return np.zeros(table.num_rows, dtype=bool)
    ids, tks = ids_of(table), table.column("tk").to_pylist()
    return np.fromiter(((int(i), k) in copies for i, k in zip(ids, tks)), bool, table.num_rows)


def from_binary(values, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(v, dtype=dtype) for v in values]) if len(values) else np.zeros(0, dtype)


def in_sorted(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values
