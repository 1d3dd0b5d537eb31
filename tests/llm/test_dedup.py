"""Substring, suffix, line and SimHash dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from grainset.llm import line_dedup, simhash_dedup, substring_dedup, suffix_dedup
from grainset.llm.runlength_index import RunLengthIndex

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(words):
    """Nulls, empty and long texts, copies, near copies, a shared passage, runs of one byte."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "short line"), (4, "a" * 500), (5, "a" * 350 + "b" + "a" * 200)]
    for i in range(6, 60):
        parts = [text(rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), passage)
        rows.append((i, "\n".join(parts)))
    rows += [(100 + i, rows[20][1]) for i in range(12)]
    for i in range(120, 135):
        w = rows[25][1].split(" ")
        w[rng.randrange(len(w))] = rng.choice(words) + "é"
        rows.append((i, " ".join(w)))
    rows += [(200, text(20_000)), (201, "x\n" * 300), (None, rows[30][1]), (7, rows[7][1])]
    return rows


def keyed(rows):
    return [(2**62 if i is None else i, t or "") for i, t in rows]


def test_substring_dedup(corpus, frame):
    got = substring_dedup.substring_dedup(frame(corpus)).collect()
    first = {}
    for i, t in keyed(corpus):
        w = split_words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, t in keyed(corpus):
        w = split_words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    assert want == collections.Counter((2**62 if r[0] is None else r[0], *r[1:]) for r in got)


@pytest.mark.parametrize("most", [20_000, 1])
def test_suffix_dedup(corpus, frame, most):
    rows = [r for r in corpus if len(r[1] or "") < 5000]
    got = suffix_dedup.suffix_dedup(frame(rows), most_contexts=most).collect()
    seen, want = {}, collections.Counter()
    for i, t in keyed(rows):
        b = t.encode()
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            seen[s] = min(seen.get(s, (i, k)), (i, k))
    for i, t in keyed(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if seen[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept] += 1
    assert want == collections.Counter((2**62 if r[0] is None else r[0], *r[1:4], bytes(r[4])) for r in got)


def test_run_length_index():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 150, dtype=np.uint8)
    texts = [base[a:b] for a, b in ((0, 150), (10, 140), (0, 120), (30, 150))] + [rng.integers(97, 100, 130, dtype=np.uint8)]
    data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    index = RunLengthIndex(data, ends)
    assert index.runs < len(data) * 0.8
    at = np.concatenate([np.arange(e - len(t), e - 20 + 1) for t, e in zip(texts, ends)])
    label = index.classes(at, 20)
    by_label, by_text = {}, {}
    for p, x in zip(at.tolist(), label.tolist()):
        by_label.setdefault(x, set()).add(p)
        by_text.setdefault(data[p : p + 20].tobytes(), set()).add(p)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_text.values()))


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    return any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def test_line_dedup(corpus, frame):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(6)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(7, 11))] for _ in range(20)]
    rows = [r for r in corpus if r[0] != 200]
    for i in range(300, 420):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            p, k = rng.randrange(len(w)), rng.random()
            if k < 0.3:
                w[p] = rng.choice(vocab).upper()
            elif k < 0.5:
                del w[p]
            elif k < 0.7:
                w.insert(p, rng.choice(vocab))
            lines.append("  ".join(w) if rng.random() > 0.1 else "")
        rows.append((i, "\n".join(lines)))
    got = line_dedup.line_dedup(frame(rows), min_words=2, min_near_words=8, carry=True).collect()
    places = sorted({(i, k, tuple(split_words(x.translate(LOW))), x) for i, t in keyed(rows) for k, x in enumerate(t.split("\n"))})
    first = {}
    for i, k, w, _ in places:
        first.setdefault(w, (i, k))
    long = sorted((p, w) for w, p in first.items() if len(w) >= 8)
    close = {w for n, (_, w) in enumerate(long) if any(near(w, v) for _, v in long[:n])}
    want = collections.defaultdict(lambda: [0, 0, 0, []])
    for i, k, w, x in places:
        n = want[i]
        n[0] += bool(w)
        if len(w) >= 2 and first[w] != (i, k):
            n[1] += 1
        elif w in close:
            n[2] += 1
        else:
            n[3].append(x)
    assert close and len(got) == len(rows)
    for r in got:
        n = want[2**62 if r.doc_id is None else r.doc_id]
        assert (r.n_lines, r.n_exact, r.n_near, r.text or "") == (n[0], n[1], n[2], "\n".join(n[3])), r.doc_id
        assert r.rest.doc_id == r.doc_id and r.rest.chunk == "c"


def test_line_dedup_short_lines(spark, tmp_path, frame):
    rng = random.Random(17)
    vocab = [f"v{i}" for i in range(9)]
    rows = [
        (0, "Copyright 2019 Acme Inc.\nhttps://a.example/x\n----\n今日は天気がいい\none two three"),
        (1, "copyright  2020 Acme Inc.\nhttps://a.example/x\n----\n今日は天気がいい\none two four\n"),
        (2, "a b c d e f g\nCopyright 2019 2020 Acme Inc."),
        (3, "a b c d e f g h\nb c d e f g\nonly"),
        (4, None),
        (None, "only\na b c d x f g"),
    ]
    for i in range(10, 90):
        rows.append((i, "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 5)))))
    places = sorted({(i, k, tuple(split_words(x.translate(LOW))), x) for i, t in keyed(rows) for k, x in enumerate(t.split("\n"))})
    first = {}
    for i, k, w, _ in places:
        first.setdefault(w, (i, k))
    long = sorted((p, w) for w, p in first.items() if len(w) >= 4)
    close = {w for n, (_, w) in enumerate(long) if any(near(w, v) for _, v in long[:n])}
    want = collections.defaultdict(list)
    for i, k, w, x in places:
        want[i] += [x] if not w or (first[w] == (i, k) and w not in close) else []
    docs = frame(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got[1] == "one two four\n" and got[2] == "a b c d e f g" and got[3] == "only" and got[4] is None and got[None] == ""
    assert all((t or "") == "\n".join(want[2**62 if i is None else i]) for i, t in got.items())
    hashes = {r.doc_id: r.kept_sha256 for r in line_dedup.query(spark, str(tmp_path)).collect()}
    assert hashes == {i: t if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()}


def fingerprint(text):
    w = split_words((text or "").translate(LOW))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("most", [64, 1])
def test_simhash_dedup(corpus, frame, most):
    got = simhash_dedup.simhash_dedup(frame(corpus), most=most).collect()
    rows = sorted(keyed(corpus))
    fps = [fingerprint(t) for _, t in rows]
    root = brute_components(fps)
    want = collections.Counter((i, f, rows[r][0]) for (i, _), f, r in zip(rows, fps, root))
    big = lambda x: 2**62 if x is None else x
    assert want == collections.Counter((big(r.doc_id), r.fp % 2**64, big(r.component_id)) for r in got)


@pytest.mark.parametrize("most", [64, 1])
def test_links_connect_chains(spark, most):
    rng = random.Random(2)
    fps = set()
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):  # chains of two flipped bits
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash_dedup.links(distinct, most=most)
    roots = {r.node: r.root for r in simhash_dedup.components(edges).collect()}
    got = [roots.get(f, f) for f in fps]
    want = brute_components([f % 2**64 for f in fps])
    assert [got.index(g) for g in got] == [want.index(w) for w in want]


def test_golay_keys_share():
    code = simhash_dedup.Golay()
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    row, index = code.indices(words)
    keys = collections.defaultdict(set)
    for r, k in zip(row.tolist(), index.tolist()):
        keys[r].add(k)
    for b in range(23):
        row, index = code.indices(words ^ (1 << b))
        hit = {r for r, k in zip(row.tolist(), index.tolist()) if k in keys[r]}
        assert len(hit) == len(words)


@pytest.mark.parametrize(
    "operator",
    [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, line_dedup.line_dedup, simhash_dedup.simhash_dedup],
)
def test_empty_table(frame, operator):
    assert operator(frame([])).count() == 0


def test_one_row_of_each_component(spark, frame, words):
    rng = random.Random(21)
    a, b, c, d, e, f, g = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(7))
    rows = [(5, a), (None, a), (None, b), (None, c), (None, c.upper())]  # a copy and unique texts without id
    rows += [(7, d), (7, a), (7, e), (7, e), (8, e)]  # one id with three texts, a repeated row
    rows += [(None, f), (None, f), (9, None), (10, ""), (11, g)]
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.dedup_documents(spark, frame(rows), "").collect())
    least = min(c, c.upper(), key=lambda t: hashlib.sha256(t.encode()).digest())
    assert got == collections.Counter([(5, a), (None, b), (None, least), (7, d), (7, e), (None, f), (9, None), (11, g)])
    assert corpus_pipeline.dedup_documents(spark, frame([]), "").count() == 0
