"""Spelling variant grouping by composing finite-state machines.

1. Words are counted over whole texts (``word_counts``): maximal runs of Latin letters, A-Z in
   lower case; a task adds up its own words before the exchange. Words of ``LEAST_LENGTH`` code
   points and ``LEAST_COUNT`` occurrences are the vocabulary.
2. Near words differ by exactly one inserted, deleted or replaced code point, so they share the
   first or the last half. The pairs are cut into partitions by that shared part, that is, by
   the state in which the composition starts: ``(m, a, b)`` holds words of m code points and of
   one more, that begin with the same ``a`` and end with the same ``b`` code points. A partition
   of more than ``MOST_WORDS`` words is cut again by halves of what is free (``partitions``); a
   pair that two partitions share counts in the first of them only (``skip``).
3. In each partition the free middles become a minimised acceptor; it is composed with the
   one-edit transducer and itself again, and the accepted pairs are enumerated
   (``Acceptor.pairs``). A partition returns a row for each word: number of near words, best one.
4. A word's form is its near word of the largest count (ties: smallest in code-point order) if
   that count reaches ``RATIO`` times the word's own; forms are followed to the root by pointer
   doubling (counts at least double at each step, so there are few rounds and no circle).

``noise`` deletes a code point from the runs that its hash selects (off unless asked for).

Defined cases: null and empty texts have no words; a null doc_id writes as nothing in the hash;
repeated rows count each time; other columns are not read; an empty table gives no words. Long
texts are handled in passes cut between words, so only a single run of letters is held whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainset.session import broadcast_if_small, estimated_bytes, reliable_checkpoint

from .common import NO_ESTIMATE, PASS_BYTES, documents_frame, shuffle_partitions, text_buffers, token_spans
from .simhash_dedup import _lower

LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
NOISE = 97
MOST_WORDS = 4000
WORDS_HELD = 200_000
PARTITION_BYTES = 16 << 20

_letter = np.zeros(256, dtype=bool)
_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True


def _members(buf: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (0xC3 and the byte after it)."""
    inside = _letter[buf]
    inside[1:] |= buf[:-1] == 0xC3
    return inside


def _passes(buf: np.ndarray, bounds: np.ndarray):
    """(first text, bytes, bounds) of at most about a pass, cut between words."""
    if len(buf) <= 2 * PASS_BYTES:
        yield 0, buf, bounds
        return
    for d, (lo, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        while lo < end:
            hi = min(lo + PASS_BYTES, end)
            while hi < end:
                out = np.flatnonzero(~_members(buf[hi - 1 : hi + PASS_BYTES])[1:])
                if len(out):
                    hi += int(out[0])
                    break
                hi = min(hi + PASS_BYTES, end)
            yield d, buf[lo:hi], np.array([0, hi - lo])
            lo = hi


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _run_hashes(buf, starts, ends, owner, heads: list[bytes]) -> np.ndarray:
    """crc32 of each run's text's head and the run, a byte of all runs at a time."""
    first = np.array([zlib.crc32(h) for h in heads], dtype=np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    state, start, size = first[owner[order]], starts[order], size[order]
    longest = int(np.searchsorted(-size, -64, "left"))  # these one by one
    for j in range(int(size[longest]) if longest < len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))  # runs of more than j bytes
        part = state[longest:n]
        state[longest:n] = _CRC[(part ^ buf[start[longest:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:longest].tolist():
        out[k] = zlib.crc32(buf[starts[k] : ends[k]].tobytes(), zlib.crc32(heads[owner[k]]))
    return out


def _without(word: bytes, h: int) -> bytes:
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all texts."""

    def words_of(batch):
        ids = batch.column(0).to_pylist() if noise else []
        for lo, _, whole, whole_bounds in text_buffers(batch.column(1)):
            for d, buf, bounds in _passes(whole, whole_bounds):
                low, inside = _lower[buf], _members(buf)
                # A byte of its own between two texts: runs don't go on.
                cut = bounds[1:-1]
                spaced = np.insert(np.where(inside, low, np.uint8(32)), cut, np.uint8(32))
                words = spaced.tobytes().split()
                if noise and words:
                    marks = np.insert(inside, cut, False).astype(np.uint8)
                    begin = bounds + np.arange(len(bounds))
                    begin[-1] -= 1
                    starts, ends, owner = token_spans(marks, begin, np.array([False, True]))
                    heads = [f"{'' if i is None else i}:".encode() for i in ids[lo + d : lo + d + len(bounds) - 1]]
                    hashes = _run_hashes(spaced, starts, ends, owner, heads)
                    for k in np.flatnonzero(hashes % noise == 0).tolist():
                        words[k] = _without(words[k], int(hashes[k]))
                yield words

    def rows(counts):
        some = [(w, n) for w, n in counts.items() if len(w) >= LEAST_LENGTH]
        words, n = zip(*some) if some else ((), ())
        names = pa.array(words, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for words in words_of(batch):
                counts.update(words)
                if len(counts) > WORDS_HELD:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    frame = documents_frame(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return frame.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    return counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


ALL = 1 << 30  # "no prefix to skip"


def _keyed(frame: DataFrame) -> DataFrame:
    """Adds the key of a row's partition: its numbers and what its words share."""
    shared = F.expr("concat(substring(word, 1, a), '\\0', if(b = 0, '', right(word, b)))")
    return frame.withColumn("key", F.concat_ws(",", "m", "a", "b", "skip", shared))


def partitions(words: DataFrame, most: int = MOST_WORDS, least: int = 1) -> DataFrame:
    """(key, m, a, b, skip, word, n): each word in the partitions where its near words are; no
    word is shorter than ``least``."""
    size = F.length("word")
    classes = F.explode(F.when(size > least, F.array(size, size - 1)).otherwise(F.array(size))).alias("m")
    halves = F.array(
        F.struct(F.expr("m div 2").cast("int").alias("a"), F.lit(0).alias("b"), F.lit(ALL).alias("skip")),
        F.struct(F.lit(0).alias("a"), F.expr("m - m div 2").cast("int").alias("b"), F.expr("m div 2").cast("int").alias("skip")),
    )
    level = _keyed(words.select("word", "n", classes).select("word", "n", "m", F.inline(halves)))
    done = []
    while True:
        free = F.col("m") - F.col("a") - F.col("b")
        large = level.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(free).alias("free"))
        large = reliable_checkpoint(large.where((F.col("rows") > most) & (F.col("free") > 1)).select("key"))
        if large.isEmpty():
            break
        large = broadcast_if_small(large)
        done.append(level.join(large, "key", "left_anti"))
        half = F.expr("(m - a - b) div 2").cast("int")
        cut = F.array(
            F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("skip").alias("skip")),
            F.struct(
                F.col("a").alias("a"),
                F.expr("m - a - (m - a - b) div 2").cast("int").alias("b"),
                F.least("skip", F.col("a") + half).alias("skip"),
            ),
        )
        level = _keyed(level.join(large, "key", "left_semi").select("word", "n", "m", F.inline(cut)))
    for part in done:
        level = level.unionByName(part)
    return level


class Acceptor:
    """Minimised acceptor of words of one length and of the next, with a start state for each.

    States are numbered; equal right languages have one state, whose arcs are a dict. State 0
    accepts the empty word."""

    def __init__(self, short: list[str], long: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self._register: dict = {}
        self._common: dict = {}
        self.short, self.long = self._minimise(sorted(short)), self._minimise(sorted(long))

    def _minimise(self, words: list[str]) -> int | None:
        """Adds sorted words of one length; states are final once the next word leaves them."""
        if not words:
            return None
        size = len(words[0])
        path: list[dict[str, int]] = [{} for _ in range(size)]
        last = words[0]
        for word in words[1:]:
            same = 0
            while last[same] == word[same]:
                same += 1
            self._close(path, last, same)
            last = word
        self._close(path, last, -1)
        return self._state(path[0]) if size else 0

    def _close(self, path, word, same) -> None:
        state = 0
        for k in range(len(word) - 1, max(same, 0), -1):
            path[k][word[k]] = state
            state, path[k] = self._state(path[k]), {}
        if word:
            path[max(same, 0)][word[max(same, 0)]] = state

    def _state(self, arcs: dict) -> int:
        key = tuple(arcs.items())
        if key not in self._register:
            self._register[key] = len(self.arcs)
            self.arcs.append(arcs)
        return self._register[key]

    def common(self, p: int, q: int) -> tuple[str, ...]:
        """The words that both states accept (of a length that both have)."""
        if p == 0 or q == 0:
            return ("",) if p == q else ()
        key = (p, q) if p < q else (q, p)
        if key not in self._common:
            one, two = self.arcs[p], self.arcs[q]
            if len(one) > len(two):
                one, two = two, one
            self._common[key] = tuple(c + s for c, t in one.items() if c in two for s in self.common(t, two[c]))
        return self._common[key]

    def pairs(self):
        """(word, near word) once for each pair: words of the short length that differ by a
        replacement, and a short and a long one that differ by an insertion."""
        if self.short is None:
            return
        todo = [("", self.short, self.long)]
        while todo:
            head, p, q = todo.pop()
            arcs = self.arcs[p]
            if len(arcs) > 1:
                chars = list(arcs.items())
                for i, (c, s) in enumerate(chars):
                    for d, t in chars[i + 1 :]:
                        for tail in self.common(s, t):
                            yield head + c + tail, head + d + tail
            further = self.arcs[q] if q is not None else {}
            for c, t in further.items():
                for tail in self.common(p, t):
                    if tail[:1] != c:  # of equal places the last
                        yield head + tail, head + c + tail
            for c, s in arcs.items():
                todo.append((head + c, s, further.get(c)))


def _near_in(m: int, a: int, b: int, skip: int, words: list[str], counts: list[int]):
    """(word, near words, best count, best word) of a partition's words that have some."""
    middles: tuple[dict, dict] = ({}, {})
    for w, n in zip(words, counts):
        middles[len(w) > m][w[a : len(w) - b]] = n
    short, long = middles
    if not short or len(words) < 2:
        return []
    head, tail = words[0][:a], words[0][len(words[0]) - b :]
    found: dict = {}

    def add(word, other, n):
        got = found.get(word)
        if got is None:
            found[word] = [1, n, other]
        else:
            got[0] += 1
            if n > got[1] or n == got[1] and other < got[2]:
                got[1:] = n, other

    rest = skip - a
    for u, v in Acceptor(list(short), list(long)).pairs():
        if skip < ALL and u[:rest] == v[:rest]:
            continue  # they share the prefix too: counted there
        other = short if len(u) == len(v) else long
        add(u, v, other[v])
        add(v, u, short[u])
    return [(head + w + tail, k, n, head + o + tail) for w, (k, n, o) in found.items()]


def near_words(words: DataFrame, most: int = MOST_WORDS, least: int = 1) -> DataFrame:
    """(word, n_near, best_n, best): of every word with a near word."""

    def run(batches):
        key, held, counts, shape = None, [], [], None

        def close():
            return _near_in(*shape, held, counts) if shape else []

        def frame(rows):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["word", "n_near", "best_n", "best"]
            )

        for batch in batches:
            out = []
            for k, m, a, b, skip, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    out += close()
                    key, held, counts, shape = k, [], [], (m, a, b, skip)
                held.append(word)
                counts.append(n)
            yield frame(out)
        yield frame(close())

    rows = partitions(words, most, least).select("key", "m", "a", "b", "skip", "word", "n")
    size = estimated_bytes(words) or 0
    parts = max(shuffle_partitions(words), math.ceil(4 * size / PARTITION_BYTES) if size < NO_ESTIMATE else 0)
    dealt = rows.repartition(parts, "key").sortWithinPartitions("key")
    near = dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")
    near = near.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))).alias("best")
    )
    return near.select("word", "n_near", (-F.col("best.k")).alias("best_n"), F.col("best.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), forms followed to the last by pointer doubling."""
    step = reliable_checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        # A word whose root has no form is finished; the others take their root's root.
        nexts = broadcast_if_small(step.select(F.col("word").alias("root"), F.col("root").alias("next")))
        joined = reliable_checkpoint(step.join(nexts, "root", "left"))
        if joined.where("next is not null").isEmpty():
            return joined.select("word", "root")
        step = joined.select("word", F.coalesce("next", "root").alias("root"))


def spelling_groups(words: DataFrame, ratio: int = RATIO, most: int = MOST_WORDS, least: int = 1) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) whose words have at least
    ``least`` code points."""
    words = reliable_checkpoint(words.select("word", "n"))
    near = near_words(words, most, least)
    is_form = F.col("best_n") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word",
        F.when(is_form, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    out = reliable_checkpoint(out)
    last = roots(out.where("form is not null").select("word", "form"))
    out = out.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_groups(vocabulary(word_counts(docs, noise=NOISE)), least=LEAST_LENGTH)
