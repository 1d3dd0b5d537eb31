"""Piece encoding, alignment of two vocabularies, spelling groups, against the libraries and
brute force, on made texts and on the given tables."""

import collections
import hashlib
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from grainset.llm import alignment, piece_bpe, spelling

SF = "/root/testdata/sf0.001"
PARTS = [
    "▁", " ", "  ", "a", "b", "the", "th", "é", "日本", "😀", "\x00", "\n", "\t", "　", " ", "​", ".", "://", "ing", "aaaa", "1",
    "Ω", "́", "'s", "on", "10", "\x1c", "\r\n", "<s>", "<|endoftext|>", "<0x0A>", "<unk>", "ã", "ß", "ſ", " \n", "\n ",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())


@pytest.fixture(scope="module")
def given():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


def made(n, longest, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS if rng.random() < 0.3 else PARTS[1:9]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def edge_rows(texts):
    return [(k, t) for k, t in enumerate(texts)] + [(None, None), (None, "x y"), (7, ""), (7, "x y"), (7, "x y")]


# ---------------------------------------------------------------- pieces


@pytest.mark.parametrize("long", [256, 4])
def test_ids_are_the_librarys(library, monkeypatch, long):
    monkeypatch.setattr(piece_bpe, "LONG", long)
    encoder = piece_bpe.Encoder(open(piece_bpe.model_path(), "rb").read())
    texts = made(800, 8) + made(300, 60) + made(20, 900) + ["a" * 3000, "ab" * 700 + "日" * 50, "the" * 900, " " * 500, "=" * 1200, "x" + " " * 40]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text), text[:50]
        assert encoder.decode(ids.tolist()) == library.decode(ids.tolist())


def test_any_ids_decode_as_in_the_library(library):
    encoder = piece_bpe.Encoder(open(piece_bpe.model_path(), "rb").read())
    rng = random.Random(5)
    for _ in range(1500):
        ids = [rng.choice([3 + rng.randrange(256), rng.randrange(32000), 28705, 259, 0, 1, 2]) for _ in range(rng.randint(0, 7))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_eviction_and_rounds_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE", 50)
    monkeypatch.setattr(piece_bpe, "ROUND", 300)
    monkeypatch.setattr(piece_bpe, "WORD", 6)
    encoder = piece_bpe.Encoder(open(piece_bpe.model_path(), "rb").read())
    texts = made(400, 30)
    assert [i.tolist() for i in encoder.encode(texts)] == library.encode(texts)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        piece_bpe.Model(b"\x12\x02\x18\x01")  # a unigram model


def test_digests_and_round_trip(spark, frame, library, given):
    for rows in (edge_rows(made(60, 30)), given):
        got = piece_bpe.digests(frame(rows)).collect()
        want = []
        for i, text in rows:
            ids = library.encode(text or "")
            want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    plain = piece_bpe.decode(piece_bpe.encode(frame([(1, "a  b\nc"), (2, None)])))
    assert sorted((r.doc_id, r.text) for r in plain.collect()) == [(1, "a  b\nc"), (2, "")]
    assert piece_bpe.digests(frame(edge_rows([])).where("false")).count() == 0


def test_the_check_sees_a_wrong_word(library):
    digest = piece_bpe._Digest(open(piece_bpe.model_path(), "rb").read(), True)
    digest.model.joined = digest.model.joined.copy()
    merge = digest._merge
    digest._merge = lambda segments: [ids[:-1] if "wrong" in s else ids for s, ids in zip(segments, merge(segments))]
    list(digest.texts(["all is right here", "this is wrong here"]))
    assert digest.wrong == {"wrong"}


# ---------------------------------------------------------------- alignment


def brute_alignment(rows, library):
    side = Tokenizer.from_file(piece_bpe.model_path(alignment.BYTE_MODEL))
    side.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def piece(i):
        p = library.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    docs, count = [], collections.Counter()
    for i, text in rows:
        text, whole = text or "", (" " + (text or "")).encode()
        a, b = side.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
        ta, tb = [bytes(alphabet[c] for c in side.id_to_token(x)) for x in a], [piece(x) for x in b]
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            docs.append((i, [], [], [], []))
            continue
        sa, sb = spans(ta), spans(tb)
        links = [(x, y) for x, (s, e) in zip(a, sa) for y, (u, v) in zip(b, sb) if s < v and u < e]
        groups, last = [], -1
        for end in sorted({e for _, e in sa} & {e for _, e in sb}):
            groups.append("|".join(",".join(str(x) for x, (_, e) in zip(ids, s) if last < e <= end) for ids, s in ((a, sa), (b, sb))))
            last = end
        count.update(links)
        docs.append((i, a, b, groups, links))
    top = collections.defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [
        (i, len(a), len(b), len(g), len(x), sum(count[k] == top[k[1]] for k in x), sum(count[k] for k in x), sha(";".join(g)) if a else "")
        for i, a, b, g, x in docs
    ]


def test_only_words_not_given_back_are_odd(monkeypatch):
    # Words are checked together first; a batch with an odd one is gone through word by word.
    aligner = alignment.Aligner(*(open(piece_bpe.model_path(*p), "rb").read() for p in ((alignment.BYTE_MODEL,), ())))
    checked = []
    whole = aligner._given_back
    monkeypatch.setattr(aligner, "_given_back", lambda *a: checked.append(whole(*a)) or checked[-1])
    assert [len(list(aligner.align([t]))) for t in ("the cat and naïve 日本 words", "the cat, odd ▁x words")] == [1, 0]
    assert checked == [True, False] and aligner.odd and all("▁" in w for w in aligner.odd)


def test_alignment_against_all_pairs(spark, frame, library, given, monkeypatch):
    short = [(i, t) for i, t in given if len(t) < 2500]
    for rows in (edge_rows(made(150, 30)), short):
        got = alignment.alignment(frame(rows)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_alignment(rows, library), key=str)
    assert alignment.alignment(frame(rows).where("false")).count() == 0


def test_parts_and_chunks_change_nothing(frame, library, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 40)
    monkeypatch.setattr(alignment, "PASS", 90)
    monkeypatch.setattr(piece_bpe, "ROUND", 200)
    rows = edge_rows([t.replace("\n", " x") for t in made(40, 60, seed=9)] + ["one two three " * 30])
    data = open(piece_bpe.model_path(alignment.BYTE_MODEL), "rb").read()
    aligner = alignment.Aligner(data, open(piece_bpe.model_path(), "rb").read())
    row = alignment._chunk_row(aligner, 1, [i for i, _ in rows], [t or "" for _, t in rows]).to_pylist()[0]
    want = brute_alignment(rows, library)
    assert [row[c] for c in ("n_a", "n_b", "n_groups", "n_links")] == [[w[k] for w in want] for k in (1, 2, 3, 4)]
    assert row["groups_sha256"] == [w[7] for w in want] and sum(row["n"]) == sum(w[4] for w in want)


def test_groups_and_links(frame):
    r = alignment.groups_and_links(frame([(1, "the cat")])).collect()[0]
    assert all("|" in g for g in r.groups.split(";")) and sum(x.n for x in r.links) >= 2


# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(counts):
    near = {w: {x for x in counts if x != w and abs(len(x) - len(w)) <= 1 and one_edit(w, x)} for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * counts[w]:
                form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=str)


def brute_counts(rows, noise):
    counts = collections.Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if noise and h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return counts


@pytest.mark.parametrize("most", [4000, 3])
def test_groups_against_all_pairs(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))): rng.randint(1, 60) for _ in range(400)}
    words |= {w + "x" * 4: n + 1 for w, n in list(words.items())[:100]} | {"prefix" * 3 + w: 2 for w in list(words)[:120]}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.spelling_groups(frame, most=most).collect()
    assert sorted(map(tuple, got), key=str) == brute_spelling(words)


@pytest.mark.parametrize("noise", [None, 97, 3])
def test_word_counts(frame, given, noise, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choice("aBcé÷× .") for _ in range(9000)) + "Z" * 300
    rows = given + edge_rows(made(100, 30)) + [(1, long), (1, long), (-5, "ÀÿÖ×÷ éáb Ωab")]
    monkeypatch.setattr(spelling, "PASS_BYTES", 700)
    got = spelling.word_counts(frame(rows), noise=noise).collect()
    want = {w: n for w, n in brute_counts(rows, noise).items() if len(w.encode()) >= spelling.LEAST_LENGTH}
    assert {r.word: r.n for r in got} == want


def test_query_on_the_given_table(spark, given):
    counts = {w: n for w, n in brute_counts(given, spelling.NOISE).items() if n >= 3 and len(w) >= 5}
    got = [tuple(r) for r in spelling.query(spark, SF).collect()]
    assert sorted(got, key=str) == brute_spelling(counts)


def test_no_words(spark, frame):
    assert spelling.spelling_groups(spelling.vocabulary(spelling.word_counts(frame([(1, None), (2, "")])))).count() == 0
    one = spark.createDataFrame([("alone", 5)], "word string, n long")
    assert [tuple(r) for r in spelling.spelling_groups(one).collect()] == [("alone", None, "alone", 5, 0, None)]
