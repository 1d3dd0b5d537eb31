"""Benchmark decontamination by latent semantic retrieval.

1. Terms (words, ASCII lower case, hashed to ``TERMS`` slots) get inverse passage frequencies
   counted over every passage of every document.
2. A randomised SVD of the TF-IDF matrix of all benchmark passages and all passages of every
   document gives ``rank`` latent directions. The documents weigh as much as ``count_as`` of
   them would, whatever their number, so the directions don't leave the benchmark as a table
   grows. Its product runs over the passages in tasks, once; only term x direction blocks of
   fixed size reach the driver.
3. Every document is cut into overlapping windows of four sizes at steps of ``STEP`` words.
   Each window is projected and compared with all benchmark passages of about its size, in
   blocks. The cosine takes the lengths of the unprojected TF-IDF vectors, so what a window
   holds outside the latent space counts against it, and is relative to the passage's cosine
   with itself there; windows at or above ``cosine`` are candidates. A term counts once in
   each window, whatever stands before the window.
4. A candidate is verified on its words: the longest common subsequence with the passage must
   reach ``LCS`` of the passage's words; from ``PARAPHRASE`` on it also passes if the answer
   (the item's answer column, or else its last ``ANSWER_WORDS`` words) is found in order.

Items of fewer than ``LEAST_WORDS`` words (any text without blanks too) are searched as they
stand, word for word, by an Aho-Corasick automaton; one word may stand inside a longer one. Items
of fewer than ``SHORT_BYTES`` bytes are left out and counted (``Index.left_out``).

The benchmark is the stated query set and is broadcast; it must not exceed ``most_items``
(an error otherwise: run it in parts).

Defined cases: null or empty documents and items match nothing; a null doc_id or item_id
stays; repeated rows each get their matches; other columns are not read (``mark`` carries
them); an empty benchmark or table gives no matches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents_frame, small_batches, text_buffers, token_spans, word_hashes
from .simhash_dedup import _lower
from .toxicity import _letters

TERMS = 1 << 14
RANK = 64
EXTRA = 16
STEP = 8
BENCHMARK_WEIGHT = 100.0  # of a benchmark passage in the decomposition
SIZES = (2, 3, 5, 7)  # window sizes in steps
PASSAGE = 40
COUNT_AS = 2000  # documents; more weigh as much together, or they would drown the benchmark
COSINE = 0.3
LCS = 0.6
PARAPHRASE = 0.45
ANSWER_WORDS = 5
ANSWER = 0.8
LEAST_WORDS = 6
SHORT_BYTES = 12  # of an item with fewer words; shorter ones say too little to be searched
MOST_ITEMS = 1_000_000
BLOCK = 1024
SUMS = 64  # first sums of a block's partial matrices, each of every such task
LEAST_VALUE = 1e-6  # smaller eigenvalues, against the largest, are rounding
# Sizes of what numpy holds at once, whatever a text's length.
GROUPS_AT_ONCE = 1024
PASSAGES_IN_PRODUCT = 16384
WINDOWS_AT_ONCE = 4096
PASSAGES_AT_ONCE = 1024


def _words(buf, bounds):
    low = _lower[buf]
    starts, ends, doc = token_spans(low, bounds, _letters)
    return word_hashes(low, starts, ends), doc


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(17)).astype(np.int64) % TERMS


def _distinct(at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, term) of the passages that begin at the words ``at``, by passage: a term counts
    once in a passage, so a repeated word can't make up a likeness."""
    mark = np.zeros(len(slot), dtype=np.int64)
    mark[at[1:]] = 1
    both = np.sort(np.cumsum(mark) * TERMS + slot)
    both = both[_first(both)]
    return both // TERMS, both % TERMS


def _first(ordered: np.ndarray) -> np.ndarray:
    """Whether an ordered value is the first such."""
    return np.concatenate([np.ones(len(ordered[:1]), bool), ordered[1:] != ordered[:-1]])


def _sums(table: np.ndarray, slot: np.ndarray, group: np.ndarray):
    """(groups, sums of the table's rows of their slots), some groups at a time; ``group`` is
    ascending. Each step adds a row to every group that has one more, the longest groups first."""
    begin = np.flatnonzero(_first(group))
    count = np.diff(np.append(begin, len(group)))
    order = np.argsort(-count, kind="stable")
    for k in range(0, len(order), GROUPS_AT_ONCE):
        some = order[k : k + GROUPS_AT_ONCE]
        size, first = count[some], begin[some]
        total = table.take(slot[first], axis=0)
        for j in range(1, size[0]):
            n = np.count_nonzero(size > j)
            total[:n] += table.take(slot[first[:n] + j], axis=0)
        yield group[first], total


def _previous(slot: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Place of the same term before in the group, or -1."""
    n = len(slot)
    out = np.full(n, -1, dtype=np.int64)
    if n:
        # Sorted as one number, place last: much faster than a stable argsort.
        shift = n.bit_length()
        both = np.sort((group * TERMS + slot) << shift | np.arange(n))
        order = both & ((1 << shift) - 1)
        same = both[1:] >> shift == both[:-1] >> shift
        out[order[1:][same]] = order[:-1][same]
    return out


def _blocks(doc: np.ndarray, n_docs: int, step: int):
    """First word of each block of ``step`` words, and each text's first block."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    blocks = -(-count // step)
    owner = np.repeat(np.arange(n_docs), blocks)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    at = first[owner] + (np.arange(len(owner)) - begin[owner]) * step
    return at, owner, begin


def passage_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many 32-word passages of all documents hold each term slot; and their number."""

    def run(batches):
        total = np.zeros(TERMS + 1, dtype=np.int64)
        for batch in batches:
            for _, _, buf, bounds in text_buffers(batch.column(0)):
                words, doc = _words(buf, bounds)
                at, _, _ = _blocks(doc, len(bounds) - 1, 32)
                total[:TERMS] += np.bincount(_distinct(at, _slot(words))[1], minlength=TERMS)
                total[TERMS] += len(at)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, dtype=np.int64)
    for r in rows:
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def _add_products(total: np.ndarray, column, weights: np.ndarray, square: np.ndarray, right: np.ndarray) -> None:
    """Adds (columns x terms) a column's part of P'P times the probe, without the last factor idf:
    P has its passages' unit TF-IDF vectors times their weights, ``right`` is the probe times idf."""
    for lo, hi, buf, bounds in text_buffers(column):
        words, doc = _words(buf, bounds)
        at, owner, _ = _blocks(doc, hi - lo, PASSAGE)
        passage, slot = _distinct(at, _slot(words))
        norm = np.bincount(passage, weights=square[slot], minlength=len(at))
        scale = (weights[lo:hi][owner] ** 2 / np.maximum(norm, 1e-18)).astype(np.float32)
        cut = np.searchsorted(passage, np.arange(0, len(at) + PASSAGES_IN_PRODUCT, PASSAGES_IN_PRODUCT))
        for i, j in zip(cut, cut[1:]):
            base = passage[i : i + 1]
            dense = np.zeros((min(PASSAGES_IN_PRODUCT, len(at)), right.shape[1]), np.float32)
            for some, sums in _sums(right, slot[i:j], passage[i:j]):
                dense[some - base] = sums * scale[some, None]
            # The words by term, then a sum for each term and column.
            both = np.sort(slot[i:j] << 32 | (passage[i:j] - base))
            term, place = both >> 32, both & 0xFFFFFFFF
            begin = np.flatnonzero(_first(term))
            if len(begin):
                for row, values in zip(total, np.ascontiguousarray(dense.T)):
                    row[term[begin]] += np.add.reduceat(values.take(place), begin)


def _summed(frame: DataFrame, add_to, width: int) -> np.ndarray:
    """Sum (width x terms) of what the tasks add up, exchanged in blocks of a fixed size and
    summed in two steps, so that no task holds the blocks of all tasks."""

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros((width, TERMS))
        for batch in batches:
            add_to(total, batch.column(0), batch.column(1).to_numpy())
        cut = [i for i in range(0, TERMS, BLOCK) if total[:, i : i + BLOCK].any()]
        data = [total[:, i : i + BLOCK].astype(np.float32).tobytes() for i in cut]
        part = [TaskContext.get().partitionId() % SUMS] * len(cut)
        columns = [pa.array(cut, pa.int64()), pa.array(part, pa.int64()), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "part", "data"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width * BLOCK)
        for b in table.column("data"):
            total += np.frombuffer(b.as_buffer(), np.float32)
        return table.slice(0, 1).set_column(2, "data", pa.array([total.astype(np.float32).tobytes()], pa.binary()))

    kind = "at long, part long, data binary"
    some = frame.mapInArrow(run, kind).groupBy("at", "part").applyInArrow(add, kind)
    out = np.zeros((width, TERMS))
    for r in some.groupBy("at").applyInArrow(add, kind).collect():
        out[:, r["at"] : r["at"] + BLOCK] = np.frombuffer(bytes(r["data"]), np.float32).reshape(width, BLOCK)
    return out


def _product(passages: DataFrame, idf: np.ndarray, probe: np.ndarray) -> np.ndarray:
    """P'P times the probe for the weighted TF-IDF passages P, in one pass over them."""
    square, right = idf * idf, (probe * idf[:, None]).astype(np.float32)

    def add_to(total, column, weights):
        _add_products(total, column, weights, square, right)

    return idf[:, None] * _summed(passages, add_to, probe.shape[1]).T


def latent_directions(docs: DataFrame, benchmark: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """terms x rank: leading right singular vectors of the weighted TF-IDF passages P of both
    tables (text, weight). A random probe, turned to the benchmark by a first power step on its
    passages alone, then one pass over all: C = P'P times the probe, and C's approximation from
    that product (Nystrom)."""
    probe = np.random.default_rng(seed).standard_normal((TERMS, rank + EXTRA))
    turned = _product(benchmark, idf, probe)
    size = np.abs(turned).max()
    probe, _ = np.linalg.qr(turned / size + LEAST_VALUE * probe if size > 0 else probe)
    product = _product(docs.unionAll(benchmark), idf, probe)
    core = probe.T @ product
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > max(values[-1] * LEAST_VALUE, 0)
    half = product @ (vectors[:, kept] / np.sqrt(values[kept]))  # C is about half half'
    out = np.zeros((TERMS, rank))
    if kept.any():
        left = np.linalg.svd(half, full_matrices=False)[0][:, :rank]
        out[:, : left.shape[1]] = left
    return out


@dataclass
class Index:
    projection: np.ndarray  # terms x rank, weighted by idf, float32
    square: np.ndarray  # squared idf of the terms
    item: list  # of each benchmark passage
    words: list
    answers: list
    vectors: np.ndarray  # projected, of such length that a passage's product with itself is 1
    size: np.ndarray  # window size (in steps) each passage is compared with
    cosine: float
    candidates: int = 0
    short: dict = field(default_factory=dict)  # text of a short item (words with a blank between): its item_ids
    _machine: object = None
    left_out: int = 0  # items of fewer than SHORT_BYTES bytes, or none

    def search(self, column) -> list[list[dict]]:
        out = self._search(column)
        if self.short:
            for found, text in zip(out, column.to_pylist()):
                found += self._exact(text or "")
        return out

    def _exact(self, text: str) -> list[dict]:
        """Short items that stand in a text word for word; what is one word may stand inside one."""
        import ahocorasick

        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for words in self.short:
                self._machine.add_word(words, words)
            self._machine.make_automaton()
        plain, found = _plain(text), {}
        for end, words in self._machine.iter(plain):
            at = end + 1 - len(words)
            inside = " " not in words or (plain[at - 1 : at] in ("", " ") and plain[end + 1 : end + 2] in ("", " "))
            if inside and words not in found:
                found[words] = plain.count(" ", 0, at)
        match = {"cosine": 1.0, "lcs": 1.0, "answer": 1.0}
        return [
            {"item_id": item, "start_word": start, "n_words": words.count(" ") + 1, **match}
            for words, start in sorted(found.items()) for item in self.short[words]
        ]

    def _search(self, column) -> list[list[dict]]:
        out = []
        for lo, hi, buf, bounds in text_buffers(column):
            found: list[list[dict]] = [[] for _ in range(hi - lo)]
            words, doc = _words(buf, bounds)
            at, owner, begin = _blocks(doc, hi - lo, STEP)
            if len(at) and len(self.item):
                self._compare(words, doc, at, owner, begin, np.bincount(doc, minlength=hi - lo), found)
            out += found
        return out

    def _add(self, slot, block, sign, vectors, squares):
        """Adds words' projections and squares to those of their blocks (ascending)."""
        for some, sums in _sums(self.projection, slot, block):
            vectors[some] += sign * sums
        squares += sign * np.bincount(block, weights=self.square[slot], minlength=len(squares))

    def _windows(self, words, doc, at):
        """(size, vectors, squared lengths) of the windows from each block on, by rising size;
        both arrays are changed by the next size. A term counts at its first place in a window:
        a word does in the windows that begin after the block of its place before. So those
        whose place before is ``far`` blocks back count in a block as the window's first to
        its ``far``-th one."""
        slot = _slot(words)
        mark = np.zeros(len(words), dtype=np.int64)
        mark[at[1:]] = 1
        block = np.cumsum(mark)
        before = _previous(slot, doc)
        far = np.where(before < 0, SIZES[-1], block - block[before])
        text = doc[at]
        n, rank = len(at), self.projection.shape[1]
        vectors, squares = np.zeros((n, rank), np.float32), np.zeros(n)
        total, length = np.zeros((n, rank), np.float32), np.zeros(n)
        self._add(slot[far > 0], block[far > 0], 1, vectors, squares)
        for k in range(min(n, SIZES[-1])):
            if k:
                late = np.flatnonzero(far == k)
                self._add(slot[late], block[late], -1, vectors, squares)
            for i in range(0, n - k, WINDOWS_AT_ONCE):
                j = min(i + WINDOWS_AT_ONCE, n - k)
                off = i + np.flatnonzero(text[i + k : j + k] != text[i:j])  # the text ends before
                kept = total[off], length[off]
                total[i:j] += vectors[i + k : j + k]
                length[i:j] += squares[i + k : j + k]
                total[off], length[off] = kept
            if k + 1 in SIZES:
                yield k + 1, total, length
        for size in SIZES:
            if size > n:  # no text has as many blocks
                yield size, total, length

    def _compare(self, words, doc, at, owner, begin, count, found):
        ends = np.cumsum(count)
        best: dict = {}
        for size, total, length in self._windows(words, doc, at):
            which = np.flatnonzero(self.size == size)
            for k in range(0, len(at) if len(which) else 0, WINDOWS_AT_ONCE):
                norm = np.sqrt(np.maximum(length[k : k + WINDOWS_AT_ONCE], 1e-9)).astype(np.float32)
                for rows, cols, cosine in self._near(total[k : k + WINDOWS_AT_ONCE], norm, which):
                    for b, q, cos in zip((rows + k).tolist(), cols.tolist(), cosine.tolist()):
                        d = int(owner[b])
                        lo = max(int(at[b]) - STEP, int(ends[d] - count[d]))
                        hi = min(int(at[b]) + size * STEP + STEP, int(ends[d]))
                        got = self._verify(words[lo:hi].tolist(), q)
                        self.candidates += 1
                        if got and got[0] > best.get((d, q), (0.0,))[0]:
                            best[d, q] = (got[0], got[1], lo - int(ends[d] - count[d]), hi - lo, cos)
        for (d, q), (lcs, answer, start, n, cos) in sorted(best.items()):
            found[d].append({"item_id": self.item[q], "start_word": start, "n_words": n, "cosine": round(cos, 6), "lcs": lcs, "answer": answer})

    def _near(self, window, norm, which):
        """(windows, passages, cosines) at or above the threshold, by blocks of passages."""
        least = (self.cosine * norm)[:, None]
        for k in range(0, len(which), PASSAGES_AT_ONCE):
            part = which[k : k + PASSAGES_AT_ONCE]
            product = window @ self.vectors[part].T
            found = np.flatnonzero(product >= least)
            rows, cols = np.divmod(found, len(part))
            yield rows, part[cols], product.ravel()[found] / norm[rows]

    def _verify(self, window, q):
        """(share of the passage in the longest common subsequence, of the answer), or None."""
        passage, answer = self.words[q], self.answers[q]
        places: dict = {}
        for i, w in enumerate(window):
            places[w] = places.get(w, 0) | 1 << i
        if sum(w in places for w in passage) < PARAPHRASE * len(passage):
            return None
        share = _lcs(passage, places) / len(passage)
        if share < PARAPHRASE:
            return None
        kept = _lcs(answer, places) / max(len(answer), 1)
        return (share, kept) if share >= LCS or kept >= ANSWER else None


def _plain(text: str) -> str:
    """A text's words, ASCII in lower case, with a blank between."""
    buf, bounds = _single(text)
    if not len(buf):
        return ""
    low = _lower[buf]
    return b" ".join(np.where(_letters[low], low, np.uint8(32)).tobytes().split()).decode()


def _lcs(words, places: dict) -> int:
    """Longest common subsequence of a word list and a window given by its places (bit rows)."""
    row = 0
    for w in words:
        x = row | places.get(w, 0)
        row = x & ~(x - (row << 1 | 1))
    return bin(row).count("1")


def build_index(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = RANK,
    count_as: int = COUNT_AS,
    cosine: float = COSINE,
    most_items: int = MOST_ITEMS,
    item_col: str = "item_id",
    id_col: str = "doc_id",
    text_col: str = "text",
    answer_col: str | None = None,
) -> Index:
    frame = documents_frame(docs, id_col, text_col)
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    picked = benchmark.select(F.col(item_col).cast("long"), F.col("text").cast("string"), answer)
    items = picked.limit(most_items + 1).collect()
    if len(items) > most_items:
        raise ValueError(f"more than {most_items} benchmark items; run them in parts")
    items = sorted(items, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    df, passages = passage_frequencies(frame)
    idf = np.log((passages + 1) / (df + 0.5)).clip(0)
    weight = min(1.0, count_as / max(docs.count(), 1)) ** 0.5
    passage = frame.select("text", F.lit(weight).alias("weight"))
    wanted = benchmark.select(F.col("text").cast("string"), F.lit(BENCHMARK_WEIGHT).alias("weight"))
    directions = latent_directions(passage, wanted, idf, rank)
    projection = (directions * idf[:, None]).astype(np.float32)
    item, words, answers, short, left_out = [], [], [], {}, 0
    for item_id, text, answer in items:
        tokens = _words(*_single(text or ""))[0].tolist()
        tail = _words(*_single(answer))[0].tolist() if answer else tokens[-ANSWER_WORDS:]
        if len(tokens) < LEAST_WORDS:
            plain = _plain(text or "")
            if len(plain.encode()) >= SHORT_BYTES:
                short.setdefault(plain, []).append(item_id)
            else:
                left_out += 1
            continue
        for k in range(0, max(len(tokens) - PASSAGE // 2, 1), PASSAGE // 2) if len(tokens) > 56 else (0,):
            chunk = tokens[k : k + PASSAGE] if len(tokens) > 56 else tokens
            item.append(item_id)
            words.append(chunk)
            answers.append(tail)
    square = idf * idf
    vectors = np.zeros((len(words), rank), dtype=np.float32)
    for i, w in enumerate(words):
        slot = _slot(np.array(w, dtype=np.uint64))
        slot = np.unique(slot)
        v = projection[slot].sum(axis=0)
        vectors[i] = v / max(float(v @ v), 1e-9) * np.sqrt(square[slot].sum())
    lens = np.array([len(w) for w in words], dtype=np.int64)
    size = np.array([min((s for s in SIZES if s * STEP >= n), default=SIZES[-1]) for n in lens], dtype=np.int64)
    return Index(projection, square, item, words, answers, vectors, size, cosine, short=short, left_out=left_out)


def _single(text: str):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)], dtype=np.int64)


MATCH = pa.struct(
    [("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64())]
    + [(x, pa.float64()) for x in ("cosine", "lcs", "answer")]
)
MATCH_DDL = "item_id:long,start_word:long,n_words:long,cosine:double,lcs:double,answer:double"


def mark(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The rows as ``rest`` (a struct of all columns by position) with their ``matches``."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    frame = small_batches(docs).select(rest)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = pa.array(held.value.search(pc.struct_field(batch.column(0), [at])), pa.list_(MATCH))
            yield pa.RecordBatch.from_arrays([found, batch.column(0)], names=["matches", "rest"])

    kind = T.StructType.fromDDL(f"matches array<struct<{MATCH_DDL}>>")
    return frame.mapInArrow(run, kind.add("rest", frame.schema["rest"].dataType))


def matches(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, cosine, lcs, answer): verified matches, each
    item's passage with its best window in a document."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            found = pa.array(held.value.search(batch.column(1)), pa.list_(MATCH))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "matches"])

    out = documents_frame(docs, id_col, text_col).mapInArrow(run, f"doc_id long, matches array<struct<{MATCH_DDL}>>")
    return out.select("doc_id", F.inline("matches"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, build_index(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
