"""Cross-tokenizer alignment of a byte-level and a piece vocabulary.

Each text is encoded by both (without special tokens; their strings are plain text). The byte
ranges of the tokens are aligned batch by batch with ``pandas.merge_asof``, documents end to end:
each token's start finds the other side's token that covers it; the union of both directions is
all overlaps (links), and offsets where tokens of both sides end cut the text into groups.

Counts of linked id pairs over the corpus: a *chunk* is about ``CHUNK`` bytes of a task's texts.
It is written once as one row: its documents, their links as numbers of the chunk's distinct
pairs (packed), and these pairs with their counts. Only pairs leave the chunk: they are added up,
compared with the best pair of their piece (a table no longer than the vocabulary), and returned
to the chunk, which adds up its documents. A pair crosses the network once per chunk however
often it occurs, and no task holds more than a chunk.

Both vocabularies cut before a blank that stands between a character and one that is no white
space, so the ids of what lies between two such blanks are kept from batch to batch.

Defined cases: texts that are null, empty, or that one side does not give back (the bytes of its
tokens joined differ from a blank and the text) have no tokens; a null doc_id stays; repeated
rows each get a row and count each; other columns are not read; an empty table gives no rows.
Texts are aligned in parts of at most ``PART`` characters, cut where both sides cut; only a run
without such a place is held whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainset.session import reliable_checkpoint

from .common import documents_frame, in_sorted
from .piece_bpe import BLANK, Encoder, model_path, read_model, together, worker_encoder

BYTE_MODEL = "byte_bpe_50k.json"
CHUNK = 12 << 20
PART = 1 << 20
PASS = 2 << 20

_UNIT = re.compile(f"(?<=[^ {BLANK}]) (?=\\S)")
_SPACED = re.compile(" \\s")


def byte_alphabet() -> dict[str, int]:
    """The bytes that a byte-level vocabulary's characters stand for: printable Latin-1 ones for
    themselves, the others from 256 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner(Encoder):
    """Both encoders with what they keep, and the alignment of a batch."""

    def __init__(self, bytes_model: bytes, pieces_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        super().__init__(pieces_model)
        self.tokenizer = Tokenizer.from_str(bytes_model.decode())
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = json.loads(bytes_model)["model"]["vocab"]
        self.size_a, self.size_b = max(vocabulary.values()) + 1, self.model.size
        self.length_a = np.zeros(self.size_a, dtype=np.int64)
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes([alphabet[c] for c in token])
            self.length_a[i] = len(token)
        self.length_b = np.array([len(b) for b in self.model.bytes], dtype=np.int64)
        a, b = [str(i) for i in range(self.size_a)], [str(i) for i in range(self.size_b)]
        self.names = [x + c for x, c in [(i, ",") for i in a] + [(i, "|") for i in a] + [(i, ",") for i in b] + [(i, ";") for i in b]]
        self.odd: set[str] = set()

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        odd = text[0] == " " or text[-1] == " " or BLANK in text or _SPACED.search(text)
        return _UNIT.split(text) if odd else text.split(" ")

    def values(self, words, ids):
        """(ids of A, ids of B) of each word, as bytes."""
        out: list[bytes] = []
        for k in range(0, len(words), 4096):
            some, mine = words[k : k + 4096], ids[k : k + 4096]
            other = [e.ids for e in self.tokenizer.encode_batch_fast([" " + w for w in some], add_special_tokens=False)]
            whole = [(" " + w).encode() for w in some]
            flat = np.fromiter(chain.from_iterable(other), dtype=np.int32)
            cut = np.cumsum([0] + [len(i) for i in other])
            if not self._given_back(whole, flat, cut, mine):
                join, pick = b"".join, self.bytes_a.__getitem__
                for w, i, j, text in zip(some, other, mine, whole):
                    if join(map(pick, i)) != text or self.joined(j.tolist()) != text:
                        self.odd.add(w)
            data, cut = flat.tobytes(), (cut * 4).tolist()
            out += [data[i:j] for i, j in zip(cut, cut[1:])]
        return list(zip(out, super().values(words, ids)))

    def _given_back(self, whole: list[bytes], flat: np.ndarray, cut: np.ndarray, ids: list[np.ndarray]) -> bool:
        """Whether both sides' tokens give back all of the words: as one text, at the same places."""
        places = np.cumsum([0] + [len(w) for w in whole])
        other, cut_b = np.concatenate(ids), np.cumsum([0] + [len(i) for i in ids])
        for side, at, lengths, pieces in ((flat, cut, self.length_a, self.bytes_a), (other, cut_b, self.length_b, self.model.bytes)):
            if not np.array_equal(np.append(0, np.cumsum(lengths[side]))[at], places):
                return False
            if b"".join(map(pieces.__getitem__, side.tolist())) != b"".join(whole):
                return False
        return True

    def _forget(self, words: set) -> None:
        super()._forget(words)
        self.odd -= words

    def parts(self, texts: list[str]):
        """(text number, ids of A, ids of B) of each part in order, for texts with tokens."""
        for d, (words, both) in enumerate(self.texts(texts)):
            if not words or (self.odd and not self.odd.isdisjoint(words)):
                continue
            ids_a, ids_b = zip(*both)
            if len(texts[d]) + 1 < PART:
                a, b = (np.frombuffer(b"".join(x), dtype=np.int32) for x in (ids_a, ids_b))
                yield d, a, b, len(texts[d]) + 1
                continue
            lo = size = 0
            for hi, w in enumerate(words):
                size += len(w) + 1
                if size >= PART or hi + 1 == len(words):
                    a, b = (np.frombuffer(b"".join(x[lo : hi + 1]), dtype=np.int32) for x in (ids_a, ids_b))
                    yield d, a, b, size
                    lo, size = hi + 1, 0

    def align(self, texts: list[str]):
        """For each pass over some parts: (text numbers of the parts, numbers of A's and B's
        tokens and of groups, groups as text, each link's part, links as A << 32 | B)."""
        held, size = [], 0
        for part in self.parts(texts):
            held.append(part[:3])
            size += part[3]
            if size >= PASS:
                yield self._aligned(held)
                held, size = [], 0
        if held:
            yield self._aligned(held)

    def _aligned(self, parts):
        import pandas as pd

        docs = np.array([p[0] for p in parts], dtype=np.int64)
        sides = []
        for side, lengths in ((1, self.length_a), (2, self.length_b)):
            ids = np.concatenate([p[side] for p in parts])
            count = np.array([len(p[side]) for p in parts])
            end = np.cumsum(lengths[ids])
            sides.append((ids, count, np.repeat(np.arange(len(parts)), count), end - lengths[ids], end))
        (a, n_a, part_a, start_a, end_a), (b, n_b, part_b, start_b, end_b) = sides
        # Places go on from part to part, where tokens of both sides begin: no key is needed.
        left = pd.DataFrame({"at": start_a, "token": np.arange(len(a))}, copy=False)
        right = pd.DataFrame({"at": start_b, "token": np.arange(len(b))}, copy=False)
        over_a = pd.merge_asof(left[["at"]], right, on="at")["token"].to_numpy()
        over_b = pd.merge_asof(right[["at"]], left, on="at")["token"].to_numpy()
        new = start_a[over_b] != start_b  # equal starts are in both directions
        link_part = np.concatenate([part_a, part_b[new]])
        links = np.concatenate([a.astype(np.int64) << 32 | b[over_a], a[over_b[new]].astype(np.int64) << 32 | b[new]])
        last_a, last_b = in_sorted(end_a, end_b), in_sorted(end_b, end_a)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.flatnonzero(last_a) + 1, np.concatenate([[0], np.flatnonzero(last_b) + 1])
        code = np.empty(len(a) + len(b), dtype=np.int32)
        code[np.arange(len(a)) + upto_b[group_a]] = a + self.size_a * last_a
        code[np.arange(len(b)) + upto_a[group_b]] = b + 2 * self.size_a + self.size_b * last_b
        cut = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        name = self.names.__getitem__
        shown = ["".join(map(name, code[i:j].tolist()))[:-1] for i, j in zip(cut, cut[1:])]
        groups = np.bincount(part_a[last_a], minlength=len(parts))
        return docs, n_a, n_b, groups, shown, link_part, links


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    import zstandard

    planes = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CHUNK_SCHEMA = (
    "chunk long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>, "
    "places binary, times binary, pair array<long>, n array<long>"
)


def _chunk_row(aligner: Aligner, number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
    from hashlib import sha256

    count = np.zeros((4, len(texts)), dtype=np.int64)
    hashes: list = [None] * len(texts)
    keys, at, owner = [], [], []
    for docs, n_a, n_b, groups, shown, link_part, links in aligner.align(texts):
        for row, n in zip(count, (n_a, n_b, groups, np.bincount(link_part, minlength=len(docs)))):
            np.add.at(row, docs, n)
        for d, text in zip(docs.tolist(), shown):
            if hashes[d] is None:
                hashes[d] = sha256(text.encode())
            else:
                hashes[d].update(f";{text}".encode())
        key, place = np.unique(links, return_inverse=True)
        keys.append(key)
        at.append(place)
        owner.append(docs[link_part])
    pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    size = max(len(pairs), 1)
    # Each document's distinct pairs, by document and pair.
    codes = [o * size + np.searchsorted(pairs, k)[p] for o, k, p in zip(owner, keys, at)]
    code, times = np.unique(np.concatenate(codes), return_counts=True) if codes else (pairs, pairs)
    total = np.bincount(code % size, weights=times, minlength=len(pairs))[: len(pairs)].astype(np.int64)
    shas = [h.hexdigest() if h else "" for h in hashes]
    lists = [pa.array([ids], pa.list_(pa.int64())), *[pa.array([row], pa.list_(pa.int64())) for row in count]]
    blobs = [pa.array([_packed(np.diff(code, prepend=0))], pa.binary()), pa.array([_packed(times)], pa.binary())]
    last = [pa.array([x], pa.list_(pa.int64())) for x in (pairs, total)]
    columns = [pa.array([number], pa.int64()), *lists, pa.array([shas], pa.list_(pa.string())), *blobs, *last]
    names = ["chunk", "doc_id", *COUNTS, "groups_sha256", "places", "times", "pair", "n"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def aligned_chunks(
    docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A written row for each chunk (``CHUNK_SCHEMA``)."""
    a, b = read_model(docs.sparkSession, byte_path or model_path(BYTE_MODEL)), read_model(docs.sparkSession, piece_path)

    def run(batches):
        from pyspark import TaskContext

        aligner = worker_encoder(b.value, f"aligner {hash(a.value)}", lambda data: Aligner(a.value, data))
        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(together(batches, CHUNK)):
            texts = [t or "" for t in table.column(1).to_pylist()]
            yield _chunk_row(aligner, first + k, table.column(0).to_pylist(), texts)

    return reliable_checkpoint(documents_frame(docs, id_col, text_col).mapInArrow(run, CHUNK_SCHEMA))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair (A << 32 | B) in all texts, and whether no pair
    of the same B id has more."""
    pairs = chunks.select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("count"))
    pairs = reliable_checkpoint(pairs).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    # One row for each id of the vocabulary.
    most = F.broadcast(pairs.groupBy("b").agg(F.max("count").alias("most")))
    return pairs.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


RESULT = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], "n_best long", "count_sum long", "groups_sha256 string"])


def _document_rows(chunk: pa.Table, replies: pa.Table) -> pa.Table:
    lists = {c: chunk.column(c).combine_chunks().flatten() for c in ("doc_id", *COUNTS, "groups_sha256")}
    code, times = np.cumsum(_unpacked(chunk.column("places")[0].as_py())), _unpacked(chunk.column("times")[0].as_py())
    place = replies.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place], best[place] = replies.column("count").to_numpy(), replies.column("best").to_numpy()
    size, n = max(len(place), 1), len(lists["doc_id"])
    doc = code // size
    sums = []
    for value in (best, count):
        out = np.zeros(n, dtype=np.int64)
        np.add.at(out, doc, value[code % size] * times)
        sums.append(pa.array(out))
    return pa.table({**{c: lists[c] for c in ("doc_id", *COUNTS)}, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": lists["groups_sha256"]})


def alignment(
    docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row."""
    chunks = aligned_chunks(docs, byte_path, piece_path, id_col, text_col)
    asked = chunks.select("chunk", F.posexplode("pair").alias("place", "pair"))
    replies = asked.join(pair_counts(chunks), "pair").select(F.col("chunk").alias("to"), "place", "count", "best")
    held = chunks.drop("pair", "n")

    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        return _document_rows(chunk, replies)

    return held.groupBy("chunk").cogroup(replies.groupBy("to")).applyInArrow(run, RESULT)


def groups_and_links(
    docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, groups, links): the ids of each group as text, and each document's distinct
    linked pairs with how often each is linked."""
    a, b = read_model(docs.sparkSession, byte_path or model_path(BYTE_MODEL)), read_model(docs.sparkSession, piece_path)

    def run(batches):
        aligner = worker_encoder(b.value, f"aligner {hash(a.value)}", lambda data: Aligner(a.value, data))
        for table in together(batches):
            shown: list[list] = [[] for _ in range(table.num_rows)]
            links: list[dict] = [{} for _ in range(table.num_rows)]
            for numbers, _, _, _, groups, part, keys in aligner.align([t or "" for t in table.column(1).to_pylist()]):
                for d, text in zip(numbers.tolist(), groups):
                    shown[d].append(text)
                for d, key in zip(numbers[part].tolist(), keys.tolist()):
                    links[d][key] = links[d].get(key, 0) + 1
            rows = [[{"a": k >> 32, "b": k & 0xFFFFFFFF, "n": n} for k, n in d.items()] for d in links]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
            columns = [table.column(0), pa.array([";".join(s) for s in shown], pa.string()), pa.array(rows, kind)]
            yield from pa.Table.from_arrays(columns, names=["doc_id", "groups", "links"]).to_batches(200)

    schema = "doc_id long, groups string, links array<struct<a:int,b:int,n:long>>"
    return documents_frame(docs, id_col, text_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
