"""Token counts, PII, quality, toxicity, decontamination, mixing and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grainset.llm import decontamination, mixing, pii, quality_rules, token_counts, toxicity
from grainset.llm.boosting import fit_forest


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        if 16 <= len(digits(m)) <= 19 and luhn(digits(m)):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(digits(m)) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans():
    rng, auto = random.Random(1), pii.automaton()
    for _ in range(20_000):
        t = "".join(rng.choice("1234567890.  -+()@a.b%é5") for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find_spans(t, auto) if s[0] in pii.BASE] == base_spans(t), t


def test_pii_kinds_and_nulls(frame):
    text = "see https://a.example/x?y=1, IBAN: DE89 3704 0044 0532 0130 00 and SSN 123-45-6789; account no. 12345678"
    rows = {r.doc_id: r for r in pii.digest_columns(pii.find_pii(frame([(1, text), (2, None), (None, "")]))).collect()}
    assert [rows[1][f"n_{k}"] for k in ("url", "iban", "ssn", "account")] == [1, 1, 1, 1]
    assert rows[2].spans == "" and rows[None].n_email == 0
    assert pii.find_pii(frame([])).count() == 0


def test_token_histogram(frame):
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(4)
    texts = [None, "", *(" ".join(rng.choice(["alpha", "beta ", "don't", "12", "é"]) for _ in range(rng.randint(0, 300))) for _ in range(60))]
    assert tiktoken
    counts = token_counts.token_counts(frame(list(enumerate(texts))))
    n = [r.n_tokens for r in counts.orderBy("doc_id").collect()]
    assert n[:2] == [0, 0]
    hist = token_counts.length_histogram(counts, block=16)
    for r in hist.collect():
        assert r.docs_within == sum(x <= r.n_tokens for x in n)
        assert r.docs_over == sum(x > r.n_tokens for x in n)
        assert r.tokens_within == sum(x for x in n if x <= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in n)
    for r in token_counts.limit_totals(hist, [0, 7, 100, 10**6]).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in n)
    assert token_counts.length_quantile(hist, 0.5).first()[0] == sorted(n)[(len(n) + 1) // 2 - 1]
    assert token_counts.length_histogram(token_counts.token_counts(frame([]))).count() == 0


def test_tokens_decode_to_the_text():
    with open(token_counts.RANKS, "rb") as f:
        encoder = token_counts._Counter(f.read(), token_counts.PATTERN).text
    for t in ("", "a  b\n\n c", "Ünï ☃ 12\x00"):
        assert encoder.decode(encoder.encode_ordinary(t)) == t


def test_monotone_forest():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) ^ (rng.random(3000) < 0.1)).astype(float)
    forest = fit_forest(x, y, {0: -1, 1: 1})
    assert ((forest.score(x) > 0.5) == (x[:, 0] < 0.6)).mean() > 0.97
    probe = np.repeat(rng.random((50, 3)), 40, axis=0)
    for j, sign in ((0, -1), (1, 1)):
        p = probe.copy()
        p[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(forest.score(p).reshape(50, 40), axis=1) >= -1e-12).all()


def test_quality(spark, frame, words):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(words) for _ in range(80)) + "."
    poor = lambda: " ".join(rng.choice(words) + "###" for _ in range(80))
    rows = [(i, poor() if i % 4 == 0 else good()) for i in range(300)]
    rows += [(1000, None), (1001, "one two"), (1002, "a b c d e " * 30), (1003, "x y\nx y\n\nx  y\n" + good())]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = frame(rows)
    got = {r.doc_id: r for r in quality_rules.quality(docs, quality_rules.train(docs, labels)).collect()}
    assert all(got[i].kept == (i % 4 != 0) for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1)
    assert got[1000].base_failed and got[1001].base_failed
    assert got[1002].n_repeat_words == 150 and got[1002].base_failed
    assert got[1003].n_dup_lines == 1 and got[0].n_symbols == 240
    nobody = quality_rules.train(docs, labels.limit(0))
    assert quality_rules.quality(docs, nobody).where("not base_failed and not kept").count() == 0


def test_toxicity(spark, frame, words):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["zzvile", "zzvilest", "yyfoul"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(bad)))
    rows += [(9001, None), (9002, ""), (None, "zzvile zzvile yyfoul")]
    table = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = frame(rows)
    model = toxicity.train(docs, table)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == int(i % 6 == 0) for i in held]) > 0.98
    assert got[9001].predicted == 0 and got[9002].score == got[9001].score and got[None].predicted == 1
    assert toxicity.mark(docs, model).where("score >= 0.7").select("rest.*").columns == docs.columns
    none = toxicity.train(docs, table.limit(0))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_lcs():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        places = {}
        for i, w in enumerate(b):
            places[w] = places.get(w, 0) | 1 << i
        assert decontamination._lcs(a, places) == lcs(a, b)


def test_decontamination(spark, frame, words):
    rng = random.Random(8)
    rare = [f"{w}{v}" for w in words for v in ("qu", "xo", "zi", "ka", "mu")]
    item = lambda n: [rng.choice(rare) for _ in range(n)]
    items = [item(n) for n in (10, 20, 30, 40, 50, 150)]
    prose = lambda n: [rng.choice(rare if rng.random() < 0.5 else words[:30]) for _ in range(n)]
    rows = [(i, " ".join(prose(rng.randint(5, 400)))) for i in range(150)]
    for k, it in enumerate(items):
        changed = [w if rng.random() > 0.2 else rng.choice(rare) for w in it]
        for kind, body in enumerate((it, changed)):
            w = prose(200)
            at = rng.randrange(150)
            rows.append((1000 + 10 * k + kind, " ".join(w[:at] + body + w[at:])))
    rows += [(5000, None), (5001, ""), (5002, " ".join(items[2]).upper())]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    docs = frame(rows)
    index = decontamination.build_index(docs, bench)
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, index).collect()}
    assert got == {(1000 + 10 * k + kind, k) for k in range(6) for kind in (0, 1)} | {(5002, 2)}
    assert decontamination.matches(docs, decontamination.build_index(docs, bench.limit(0))).count() == 0
    with pytest.raises(ValueError):
        decontamination.build_index(docs, bench, most_items=3)


def test_verbatim_after_reshuffled_copies(spark, frame, words):
    rng = random.Random(31)
    shuffled = lambda w: rng.sample(w, len(w))
    items = [rng.sample(words, n) for n in (15, 17, 20, 24, 32, 40)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(100)]
    for k, it in enumerate(items):
        parts = [shuffled(it) for _ in range(4)] + [it] + [shuffled(it) for _ in range(2)]
        rows.append((1000 + k, " ".join(w for p in parts for w in p)))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    docs = frame(rows)
    index = decontamination.build_index(docs, bench)
    got = {(r.doc_id, r.item_id): r.lcs for r in decontamination.matches(docs, index).collect()}
    assert got == {(1000 + k, k): 1.0 for k in range(6)}


def test_terms_count_once_in_each_window():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 40, 300).astype(np.uint64) << np.uint64(17)
    doc = np.repeat(np.arange(3), [10, 200, 90])
    projection, square = rng.random((decontamination.TERMS, 5)).astype(np.float32), rng.random(decontamination.TERMS)
    index = decontamination.Index(projection, square, [], [], [], np.zeros((0, 5)), np.zeros(0), 0.3)
    at, _, _ = decontamination._blocks(doc, 3, decontamination.STEP)
    ends = np.cumsum([10, 200, 90])
    seen = []
    for size, total, length in index._windows(words, doc, at):
        seen.append(size)
        for b, first in enumerate(at):
            slot = np.unique(decontamination._slot(words[first : min(first + size * decontamination.STEP, ends[doc[first]])]))
            assert np.allclose(total[b], projection[slot].sum(axis=0), atol=1e-4) and np.isclose(length[b], square[slot].sum())
    assert tuple(seen) == decontamination.SIZES


def test_mixing_rates(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(0, 500, 400)
    frame = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    plan = mixing.fit_prices(frame, ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2}, steps=40)
    rate = np.array([r[0] for r in frame.select(mixing.rates(F.col("p"), plan)).collect()])
    got = (rate * n) @ p
    assert (rate >= 0).all() and np.allclose(got / n.sum(), [0.5, 0.3, 0.2], atol=0.01)
    # the same steps in numpy
    r = z = np.ones(400)
    for price, beta in plan["steps"]:
        new = np.maximum(0, z - plan["step"] * (p @ np.array(price) + plan["pull"] * (z - 1)))
        r, z = new, new + beta * (new - r)
    assert np.allclose(r, rate)


def test_mixing_posteriors_and_edges(spark, frame):
    docs = spark.createDataFrame(
        [(i, "the thing with this " * 20 if i % 2 else "ñandú ó él qué " * 20, "en" if i % 2 else "es", 1) for i in range(60)]
        + [(100, None, "en", 1), (101, "", None, 1), (None, "the", "en", 1), (1, "the thing with this " * 20, "en", 1)],
        "doc_id long, text string, lang string, rate int",
    )
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = mixing.mixed(docs, labels, {"en/good": 0.7, "es/good": 0.3}, carry=True).collect()
    assert len(got) == 64
    assert all(r.domain == ("en/good" if r.doc_id % 2 else "es/good") for r in got if r.doc_id is not None and r.doc_id < 60)
    assert {r.n_tokens for r in got if r.doc_id in (100, 101)} == {0}
    assert got[0].rest.rate == 1
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_pipeline(spark, tmp_path, words):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, "\n".join(text(60) for _ in range(3)), "en", "s", 0) for i in range(120)]
    item = [w + "q" for w in rng.sample(words, 40)]
    rows += [(200, rows[3][1], "en", "s", 0), (201, text(80) + " " + " ".join(item) + " " + text(80), "en", "s", 0)]
    rows += [(202, None, "en", "s", 0), (203, "", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 200 loses all its lines to document 3 and joins the empty documents; 201 is contaminated
    assert got == set(range(120)) | {200}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
