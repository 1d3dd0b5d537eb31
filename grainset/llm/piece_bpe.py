"""SentencePiece encoding and decoding with a merge-type (BPE) vocabulary.

The text is normalised as the model says (a blank becomes U+2581, one is put before the text).
No piece goes on after a word (checked when the model is read), so each word merges by itself,
and inside a word no pair is looked at that no piece holds side by side. The symbols are merged
by an agenda of adjacent pairs: the pair whose joined piece has the highest score first, the
leftmost of equals first, until no adjacent pair is a piece. What is left becomes ids; a
character without a piece becomes the ids of its UTF-8 bytes.

``Agenda`` keeps the pairs of all new words of a batch in buckets by score and merges a bucket
at once: within a segment only its leftmost pair, unless nothing that follows from a merge can
come before the bucket's other pairs (``Model.calm``); a segment of more than ``LONG`` symbols
goes through the same agenda as a heap. A worker keeps up to ``CACHE`` words with their ids.

``encode`` returns whole texts' ids, ``decode`` the text of any ids (bytes that are no UTF-8
become U+FFFD; the first piece loses the blank that encoding put there). ``digests`` does both
in one pass; with ``check`` the library encodes and decodes every word that the agenda merges
in the same Arrow batches, and ``agrees`` tells whether it got the same for all of a text's
words; ids and text are always the agenda's.

Defined cases: null and empty texts have no ids and decode to an empty text; a null doc_id
stays; repeated rows each get a row; other columns are not read; an empty table gives an empty
one. Words over ``WORD`` characters are not kept and merge in parts of ``ROUND`` characters, cut
where no piece reaches across; only a run without such a place is held whole (about 60 bytes a
character).
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, documents_frame, small_batches

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
LONG = 256
CACHE = 800_000
ROUND = 8 << 20
WORD = 1000
# Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes):
    """(number, value) of a protocol message's fields; 4-byte and nested values as bytes."""
    at, n = 0, len(data)

    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    while at < n:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """Pieces, scores and tables of a model file's bytes."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        kind, prefix, squeeze, escape, charsmap, suffix = 1, True, True, True, b"", False
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                kind, suffix = trainer.get(3, 1), bool(trainer.get(24, 0))
            elif number == 3:
                rule = dict(_fields(value))
                charsmap = rule.get(2, b"")
                prefix, squeeze, escape = (bool(rule.get(k, 1)) for k in (3, 4, 5))
        if kind != BPE:
            raise ValueError("not a merge-type vocabulary")
        if squeeze or not escape or not prefix or charsmap or suffix or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("the model's normalisation or its own symbols are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        named = {i: p for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_ids = {int(p[1:-1], 16): i for i, p in named.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        if len(self.byte_ids) not in (0, 256):
            raise ValueError("some bytes have no piece")
        # Bytes of each id: byte pieces stand for themselves, control pieces for nothing.
        self.bytes = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN
            else p.replace(BLANK, " ").encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self._pairs(scores)

    def _pairs(self, scores: list[float]) -> None:
        chars = sorted({c for p in self.ids for c in p})
        self.slot = np.zeros(0x110000, dtype=np.int32)
        self.slot[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = np.full(len(chars) + 1, -1, dtype=np.int32)
        for k, c in enumerate(chars, 1):
            self.single[k] = self.ids.get(c, -1)
        inside = np.zeros((len(chars) + 1, len(chars) + 1), dtype=bool)
        at = {c: k for k, c in enumerate(chars, 1)}
        keys, out = [], []
        size = len(self.pieces)
        for p, i in self.ids.items():
            for a, b in zip(p, p[1:]):
                inside[at[a], at[b]] = True
                if b == BLANK and a != BLANK:
                    raise ValueError("a piece goes on after a word: words can't be merged by themselves")
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * size + right)
                    out.append(i)
        self.inside = inside
        order = np.argsort(keys)
        self.key, self.joined = np.array(keys, dtype=np.int64)[order], np.array(out, dtype=np.int32)[order]
        # Classes of equal scores, best first.
        levels = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.level = np.full(size + 1, -1, dtype=np.int32)  # [-1] is "no piece"
        for i in self.ids.values():
            self.level[i] = levels[scores[i]]
        # A level is calm if no piece of the same or a better level begins or ends with its piece.
        self.calm = np.ones(len(levels), dtype=bool)
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    j = self.ids.get(part)
                    if j is not None and self.level[i] <= self.level[j]:
                        self.calm[self.level[j]] = False
        self.size = size
    def within(self, left: str, right: str) -> bool:
        """Whether some piece holds these characters side by side."""
        return bool(self.inside[self.slot[ord(left)], self.slot[ord(right)]])

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The joined piece of each pair, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (left >= 0) & (right >= 0), self.joined[at], -1)


class Agenda:
    """Merges the symbols of many segments."""

    def __init__(self, model: Model):
        self.model = model

    def run(self, sym: np.ndarray, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``sym`` holds single-character pieces (-1 without one) and ``wall`` the places (before
        a symbol) that no merge crosses, the first included. Returns the start of each symbol
        left, and its piece."""
        n = len(sym)
        sym = sym.astype(np.int32)
        first = np.flatnonzero(wall)
        size = np.diff(np.append(first, n))
        out = np.arange(n + 1, dtype=np.int32)  # start of the next symbol
        out += 1
        back = np.arange(-1, n, dtype=np.int32)  # start of the symbol that ends here
        live = np.ones(n, dtype=bool)
        late = np.repeat(size > LONG, size)
        for a, b in zip(first[size > LONG].tolist(), (first + size)[size > LONG].tolist()):
            self._heap(sym, live, a, b)
        want = np.full(n, -1, dtype=np.int32)
        pairs = np.flatnonzero(~(wall[1:] | late[1:])).astype(np.int32)
        want[pairs] = self.model.lookup(sym[pairs], sym[pairs + 1])
        pairs = pairs[want[pairs] >= 0]
        self._buckets(sym, live, out, back, want, wall, np.cumsum(wall, dtype=np.int32), pairs)
        left = np.flatnonzero(live)
        return left, sym[left]

    def _buckets(self, sym, live, out, back, want, wall, segment, pairs) -> None:
        level, calm, lookup, n = self.model.level, self.model.calm, self.model.lookup, len(sym)
        bucket: dict[int, list] = {}
        agenda: list[int] = []

        def push(at):
            lev = level[want[at]]
            if len(at) > 1:
                order = np.argsort(lev, kind="stable")
                at, lev = at[order], lev[order]
                cut = np.flatnonzero(lev[1:] != lev[:-1]) + 1
                groups = zip(lev[np.concatenate([[0], cut])].tolist(), np.split(at, cut)) if len(cut) else ((int(lev[0]), at),)
            else:
                groups = ((int(lev[0]), at),)
            for k, some in groups:
                if k in bucket:
                    bucket[k].append(some)
                else:
                    bucket[k] = [some]
                    heapq.heappush(agenda, k)

        if len(pairs):
            push(pairs)
        while agenda:
            k = heapq.heappop(agenda)
            some = bucket.pop(k)
            at = some[0] if len(some) == 1 else np.concatenate(some)
            at = at[level[want[at]] == k]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                twice = at[1:] == at[:-1]
                if twice.any():
                    at = at[np.concatenate([[True], ~twice])]
                if calm[k]:
                    chained = out[at[:-1]] == at[1:]
                    if chained.any():  # a b a: of pairs that share a symbol every second one
                        place = np.arange(len(at))
                        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), place, 0))
                        at = at[(place - begin) % 2 == 0]
                else:
                    alone = np.concatenate([[True], segment[at[1:]] != segment[at[:-1]]])
                    if not alone.all():
                        bucket[k] = [at[~alone]]
                        heapq.heappush(agenda, k)
                        at = at[alone]
            piece = want[at]
            mid = out[at]
            end = out[mid]
            sym[at] = piece
            live[mid] = False
            want[mid] = -1
            want[at] = -1
            out[at] = end
            back[end] = at
            inner = end < n
            inner[inner] = ~wall[end[inner]]
            right, after = at[inner], end[inner]
            want[right] = lookup(sym[right], sym[after])
            after = at[~wall[at]]
            before = back[after]
            want[before] = lookup(sym[before], sym[after])
            fresh = np.concatenate([right, before])
            fresh = fresh[want[fresh] >= 0]
            if len(fresh):
                push(fresh)

    def _heap(self, sym, live, lo: int, hi: int) -> None:
        """One long segment: all first pairs in order beside a heap of those that merges make."""
        model, n = self.model, hi - lo
        joined = model.lookup(sym[lo : hi - 1], sym[lo + 1 : hi])
        at = np.flatnonzero(joined >= 0)
        order = at[np.argsort(model.level[joined[at]], kind="stable")]
        firsts = iter(zip((model.level[joined[order]].astype(np.int64) << 40 | order).tolist(), joined[order].tolist()))
        table = dict(zip(model.key.tolist(), model.joined.tolist()))
        level, size = model.level.tolist(), model.size
        s, want = array("i", sym[lo:hi].tobytes()), array("i", np.append(joined, -1).astype(np.int32).tobytes())
        out, back = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap: list[int] = []
        ahead = next(firsts, None)
        mask = (1 << 40) - 1
        while ahead or heap:
            if ahead and (not heap or ahead[0] <= heap[0]):
                key = ahead[0]
                ahead = next(firsts, None)
            else:
                key = heapq.heappop(heap)
            i = key & mask
            if want[i] < 0 or level[want[i]] != key >> 40:
                continue
            mid = out[i]
            end = out[mid]
            s[i], want[mid], out[i], s[mid] = want[i], -1, end, -2
            want[i] = -1
            if end < n:
                back[end] = i
            for a, b in ((i, end), (back[i], i)):
                if a >= 0 and b < n and s[a] >= 0 and s[b] >= 0:
                    want[a] = piece = table.get(s[a] * size + s[b], -1)
                    if piece >= 0:
                        heapq.heappush(heap, level[piece] << 40 | a)
                elif a >= 0:
                    want[a] = -1
        done = np.frombuffer(s, dtype=np.int32)
        sym[lo:hi] = done
        live[lo:hi] = done != -2


class Encoder:
    """Encodes texts; keeps what ``values`` makes of words and their ids from batch to batch.

    A word is what stands between two blanks, with the blanks before it but one, so that its
    segment is a blank and the word."""

    def __init__(self, data: bytes):
        self.model = Model(data)
        self.agenda = Agenda(self.model)
        self.known: dict = {}

    def values(self, words: list[str], ids: list[np.ndarray]) -> list:
        return [i.tobytes() for i in ids]

    def texts(self, texts: list[str]):
        """Each text's words in order, and their values. The words are gone through twice, so
        only the new ones are held."""
        lo = size = 0
        for hi, text in enumerate(texts):
            size += len(text)
            if size >= ROUND or hi + 1 == len(texts):
                some = texts[lo : hi + 1]
                new: set = set()
                for t in some:
                    new.update(set(self._words(t)).difference(self.known))
                self._learn(new, some)
                for t in some:
                    words = self._words(t)
                    yield words, list(map(self.known.__getitem__, words))
                self._forget({w for w in new if len(w) > WORD})
                lo, size = hi + 1, 0

    def encode(self, texts: list[str]):
        """The ids of each text."""
        for _, values in self.texts(texts):
            yield np.frombuffer(b"".join(values), dtype=np.int32)

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        if "" in words or BLANK in text:
            words = [s[1:] for s in _BLANKS.findall(BLANK + text.replace(" ", BLANK))]
        return words

    def _learn(self, new: set, texts: list[str]) -> None:
        if len(self.known) + len(new) > CACHE:
            # Too many: only these texts' stay.
            used = set().union(*[self._words(t) for t in texts])
            self.known = {w: v for w, v in self.known.items() if w in used}
        words = [w for w in new if len(w) <= WORD]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        lo = 0
        while lo < len(words):  # up to the word that reaches ROUND
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + ROUND)) + 1
            some = words[lo:hi]
            self.known.update(zip(some, self.values(some, self._merge([BLANK + w.replace(" ", BLANK) for w in some]))))
            lo = hi
        if len(words) < len(new):
            for w in new:
                if len(w) > WORD:
                    self.known[w] = self.values([w], [self._long(w)])[0]

    def _forget(self, words: set) -> None:
        for w in words:
            self.known.pop(w, None)

    def _long(self, word: str) -> np.ndarray:
        """The ids of a word of any length, merged in parts."""
        text, lo, ids = BLANK + word.replace(" ", BLANK), 0, []
        while lo < len(text):
            hi = lo + ROUND
            while hi < len(text) and self.model.within(text[hi - 1], text[hi]):
                hi += 1
            ids += self._merge([text[lo:hi]])
            lo = hi
        return np.concatenate(ids)

    def _merge(self, segments: list[str]) -> list[np.ndarray]:
        """The ids of each segment."""
        model = self.model
        points = np.frombuffer("".join(segments).encode("utf-32-le"), dtype=np.uint32)
        begin = np.cumsum([0] + [len(s) for s in segments])
        slot = model.slot[points]
        wall = np.zeros(len(points), dtype=bool)
        wall[1:] = ~model.inside[slot[:-1], slot[1:]]
        wall[begin[:-1]] = True
        start, piece = self.agenda.run(model.single[slot], wall)
        lost = np.flatnonzero(piece < 0)
        if len(lost):  # characters without a piece
            chars = [chr(c).encode() for c in points[start[lost]].tolist()]
            ids = [[model.byte_ids[b] for b in c] if model.byte_ids else [model.unknown] for c in chars]
            piece[lost] = [c[0] for c in ids]
            more = [len(c) - 1 for c in ids]
            where = np.repeat(lost + 1, more)
            start = np.insert(start, where, np.repeat(start[lost], more))
            piece = np.insert(piece, where, [i for c in ids for i in c[1:]])
        cut = np.searchsorted(start, begin).tolist()
        piece = np.ascontiguousarray(piece, dtype=np.int32)
        return [piece[a:b] for a, b in zip(cut, cut[1:])]

    def joined(self, ids: list[int]) -> bytes:
        """The bytes of ids that stand anywhere in a text."""
        return b"".join([self.model.bytes[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        model = self.model
        runs: list[list[int]] = [[]]
        for i in ids:  # control pieces have no text, and bytes on their two sides don't meet
            if model.kinds[i] == CONTROL:
                runs.append([])
            else:
                runs[-1].append(i)
        runs = [r for r in runs if r]
        data = [self.joined(r) for r in runs]
        if runs and model.pieces[runs[0][0]].startswith(BLANK):  # encoding put it there
            data[0] = data[0][1:]
        return "".join(map(as_text, data))


def as_text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="surrogateescape").translate(_BROKEN)


_BLANKS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
# Each byte that is no part of UTF-8 by itself.
_BROKEN = {0xDC00 + b: "�" for b in range(128, 256)}

_workers: dict = {}


def worker_encoder(data: bytes, kind: str = "ids", make=None) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    key = (hash(data), kind)
    if key not in _workers:
        _workers.clear()
        _workers[key] = make(data) if make else Encoder(data)
    return _workers[key]


def read_model(spark, path: str | None):
    with open(path or model_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def together(batches, most: int = ROUND):
    """Arrow batches joined until they hold about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every row's whole text."""
    data = read_model(docs.sparkSession, path)

    def run(batches):
        encoder = worker_encoder(data.value)
        for table in together(batches):
            ids = list(encoder.encode([t or "" for t in table.column(1).to_pylist()]))
            offsets = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield from pa.table({"doc_id": table.column(0), "ids": column}).to_batches(BATCH_ROWS)

    return documents_frame(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(frame: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of every row's ids (null ids: empty)."""
    data = read_model(frame.sparkSession, path)

    def run(batches):
        encoder = worker_encoder(data.value)
        for batch in batches:
            texts = [encoder.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    some = small_batches(frame).select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return some.mapInArrow(run, "doc_id long, text string")


class _Digest(Encoder):
    """Keeps words' ids in decimal form and their decoded bytes; ``wrong`` has the words for
    which the library gets something else."""

    def __init__(self, data: bytes, check: bool):
        super().__init__(data)
        self.names = [str(k) for k in range(self.model.size)]
        self.shown: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=data)

    def values(self, words: list[str], ids: list[np.ndarray]) -> list:
        if len(self.shown) > CACHE:
            self.shown = {w: d for w, d in self.shown.items() if w in self.known}
        listed = [i.tolist() for i in ids]
        self.shown.update(zip(words, map(self.joined, listed)))
        if self.library:
            # Words with a blank between them are one text; one that ends with a blank would
            # take the next one's.
            plain = [k for k, w in enumerate(words) if w and w[-1] != BLANK]
            parts = [plain[k : k + 1000] for k in range(0, len(plain), 1000)]
            texts = [" ".join([words[k] for k in part]) for part in parts]
            for part, other in zip(parts, self.library.encode(texts, out_type="numpy", num_threads=1)):
                flat = np.concatenate([ids[k] for k in part])
                data = b"".join([self.shown[words[k]] for k in part])
                if not (np.array_equal(other, flat) and self.library.decode(flat) == as_text(data[1:])):
                    self._look(words, listed, part)
            self._look(words, listed, set(range(len(words))) - set(plain))
        names = self.names
        return [",".join([names[k] for k in i]) for i in listed]

    def _forget(self, words: set) -> None:
        super()._forget(words)
        for w in words:
            if len(w) > WORD:
                self.shown.pop(w, None)

    def _look(self, words, listed, which) -> None:
        for k in which:
            word, ids = words[k], listed[k]
            other = self.library.encode(word, num_threads=1) if word else [self.library.piece_to_id(BLANK)]
            if other != ids or self.library.decode(ids) != as_text(self.shown[word][1:]):
                self.wrong.add(word)


def digests(
    docs: DataFrame, path: str | None = None, check: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, agrees): encoded and decoded in one pass,
    so neither ids nor texts leave the task; ``agrees`` is null without ``check``."""
    data = read_model(docs.sparkSession, path)

    def run(batches):
        from hashlib import sha256

        encoder = worker_encoder(data.value, f"digest {check}", lambda d: _Digest(d, check))
        for table in together(batches):
            out: list[tuple] = []
            for words, ids in encoder.texts([t or "" for t in table.column(1).to_pylist()]):
                text = as_text(b"".join(map(encoder.shown.__getitem__, words))[1:])
                ids = ",".join(ids)
                hashes = [sha256(x.encode()).hexdigest() for x in (ids, text)]
                same = encoder.wrong.isdisjoint(words) if check else None
                out.append((ids.count(",") + 1 if ids else 0, *hashes, same))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
            yield from pa.Table.from_arrays([table.column(0), *columns], names=names).to_batches()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean"
    return documents_frame(docs, id_col, text_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
