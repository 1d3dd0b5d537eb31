"""Quality rules: exact document statistics, hard base rules, and boosted trees.

Statistics come from one numpy pass over whole texts. The trees are fitted on the driver
from a bounded sample of labelled rows (``SAMPLE`` ids with the least hash; the third of the
documents whose crc32 leaves remainder 1 is never used, so it measures accuracy) and score
every document. Monotonic constraints: more symbols, repeated words, repeated lines or digits
never raise a document's score.

Defined cases: null text has no words and fails the base rules; repeated rows repeat in the
result; a null doc_id stays; labels with null or several values for a document count as given
(a null quality is left out); without labelled rows the trees keep every document; other
columns are not read; an empty table gives an empty result; a text over 1 MB is read in parts,
of which the hashes of words and lines are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit_forest
from .common import BYTES, NOT_SPACE, PASS_BYTES, SEQ_A, cover, documents_frame, long_parts, mix, text_buffers, token_spans, window_ok, word_hashes

SAMPLE = 20_000
FAIL_WORDS = 10
FAIL_REPEAT_PERCENT = 20
KEEP_SCORE = 0.5
REPEAT = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share",
            "digit_share", "upper_share", "stop_share", "line_words", "long_word_share")
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "digit_share")

_table = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
SYMBOLS = _table(b"#*$%&|<>")
DIGIT = _table(b"0123456789")
UPPER = _table(bytes(range(65, 91)))
STOPS = _table(b".!?")
LINE = ~_table(b"\n")


def _again(keys: np.ndarray):
    """Which keys occur twice or more, and which of them are not the first."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    later = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def statistics(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of the texts in a run, columns as COUNTS and FEATURES."""
    n = len(bounds) - 1
    starts, ends, doc = token_spans(buf, bounds)
    prefix = BYTES.prefix(buf)
    words = BYTES.spans(prefix, starts, ends)
    per_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds])
    n_words = np.bincount(doc, minlength=n)
    word_chars = per_doc(NOT_SPACE[buf] & ((buf & 0xC0) != 0x80))
    symbols = per_doc(SYMBOLS[buf])
    salt = mix(np.arange(n, dtype=np.uint64))
    windows = SEQ_A.windows(SEQ_A.prefix(words), REPEAT)
    at = np.flatnonzero(window_ok(doc, REPEAT))
    twice, _ = _again(windows[at] ^ salt[doc[at]])
    repeated = cover(at[twice], at[twice] + REPEAT, len(words))
    n_repeat = np.bincount(doc[repeated], minlength=n)
    l_start, l_end, l_doc = token_spans(buf, bounds, LINE)
    inside = np.concatenate([[0], np.cumsum(NOT_SPACE[buf])])
    has_word = inside[l_end] > inside[l_start]
    l_start, l_end, l_doc = l_start[has_word], l_end[has_word], l_doc[has_word]
    _, later = _again(BYTES.spans(prefix, l_start, l_end) ^ salt[l_doc])
    n_dup = np.bincount(l_doc[later], minlength=n)
    n_lines = np.bincount(l_doc, minlength=n)
    long_words = np.bincount(doc[(ends - starts) > 20], minlength=n)
    return _rows(n_words, word_chars, symbols, n_dup, n_repeat, n_lines, long_words,
                 per_doc(DIGIT[buf]), per_doc(UPPER[buf]), per_doc(STOPS[buf]))


def _rows(n_words, word_chars, symbols, n_dup, n_repeat, n_lines, long_words, digits, upper, stops):
    counts = np.stack([n_words, word_chars, symbols, n_dup, n_repeat], axis=1)
    w, c, lines = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    features = np.stack(
        [np.log1p(n_words), word_chars / w, symbols / c, n_dup / lines, n_repeat / w, digits / c,
         upper / c, stops / w, n_words / lines, long_words / w], axis=1
    )
    return counts, features


def long_statistics(raw: bytes, limit: int = PASS_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of one text, read in parts of about ``limit`` bytes."""
    import xxhash

    hashes, sums = [np.zeros(0, np.uint64)], np.zeros(6, dtype=np.int64)
    for part in long_parts(raw, limit):
        buf = np.frombuffer(part, dtype=np.uint8)
        starts, ends, _ = token_spans(buf, np.array([0, len(buf)]))
        chars = np.count_nonzero(NOT_SPACE[buf] & ((buf & 0xC0) != 0x80))
        tables = [np.count_nonzero(t[buf]) for t in (SYMBOLS, DIGIT, UPPER, STOPS)]
        sums += np.array([chars, np.count_nonzero(ends - starts > 20), *tables])
        if len(ends) == 1 and ends[0] - starts[0] >= limit:  # a word that fills a part: no table of its length
            hashes.append(np.array([xxhash.xxh64_intdigest(part[starts[0] : ends[0]])], dtype=np.uint64))
        else:
            hashes.append(word_hashes(buf, starts, ends))
    words = np.concatenate(hashes)
    twice, _ = _again(SEQ_A.windows(SEQ_A.prefix(words), REPEAT))
    at = np.flatnonzero(twice)
    n_repeat = np.count_nonzero(cover(at, at + REPEAT, len(words)))

    def lines():
        lo = 0
        while lo <= len(raw):
            hi = raw.find(b"\n", lo)
            hi = len(raw) if hi < 0 else hi
            line = raw[lo:hi]
            if line and not line.isspace():
                yield xxhash.xxh64_intdigest(line)
            lo = hi + 1

    line_hashes = np.fromiter(lines(), np.uint64)
    n_dup = len(line_hashes) - len(np.unique(line_hashes))
    chars, long_words, symbols, digits, upper, stops = sums
    one = [len(words), chars, symbols, n_dup, n_repeat, len(line_hashes), long_words, digits, upper, stops]
    return _rows(*[np.array([v], dtype=np.int64) for v in one])


def _apply(columns, forest: Forest | None):
    def run(batches):
        for batch in batches:
            counts, features = [np.zeros((0, len(COUNTS)), int)], [np.zeros((0, len(FEATURES)))]
            for _, _, buf, bounds in text_buffers(batch.column(1)):
                c, f = long_statistics(buf.tobytes()) if len(buf) > PASS_BYTES else statistics(buf, bounds)
                counts.append(c)
                features.append(f)
            counts, features = np.concatenate(counts), np.concatenate(features)
            out = [batch.column(0)]
            if forest is not None:
                out += [pa.array(counts[:, j], pa.int64()) for j in range(len(COUNTS))]
                out.append(pa.array(forest.score(features)))
            else:
                out += [pa.array(features[:, j]) for j in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *columns])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Trees from at most ``sample`` labelled rows outside the held-out third."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    rows = rows.where("quality is not null and label_id is not null")
    rows = rows.where(F.crc32(F.col("label_id").cast("string").cast("binary")) % 3 != 1)
    rows = rows.orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(sample)
    picked = documents_frame(docs, id_col, text_col).join(F.broadcast(rows), F.col("doc_id") == F.col("label_id"))
    picked = picked.select(F.col("quality").cast("long").alias("doc_id"), "text")
    got = picked.mapInArrow(_apply(FEATURES, None), "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas()
    x, y = got[list(FEATURES)].to_numpy(float), got["doc_id"].to_numpy(float)
    order = np.lexsort(x.T)  # the same trees whatever order the rows came in
    falling = {FEATURES.index(f): -1 for f in FALLING}
    if not len(y):
        return fit_forest(np.zeros((0, len(FEATURES))), y, falling, trees=1)
    return fit_forest(x[order], y[order], falling)


def quality(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, score, base_failed, kept for every row."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    out = documents_frame(docs, id_col, text_col).mapInArrow(_apply((*COUNTS, "score"), forest), schema)
    failed = (F.col("n_words") < FAIL_WORDS) | (100 * F.col("n_repeat_words") > FAIL_REPEAT_PERCENT * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= KEEP_SCORE))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
