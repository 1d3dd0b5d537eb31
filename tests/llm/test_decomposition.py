"""The latent directions come from all passages of the benchmark and of every document."""

import random

import numpy as np
import pyarrow as pa

from grainset.llm import decontamination as D


def dense(texts, idf):
    """Unit TF-IDF rows of the texts (each one passage), a term once, in plain numpy."""
    out = np.zeros((len(texts), D.TERMS))
    for row, text in zip(out, texts):
        slot = D._slot(D._words(*D._single(text))[0])
        row[slot] = idf[slot]
        row /= max(np.sqrt(row @ row), 1e-9)
    return out


def test_every_document_is_in_the_decomposition(spark, frame, words):
    rng = random.Random(3)
    items = [" ".join(rng.sample(words[:100], 20)) for _ in range(5)]
    texts = [" ".join(rng.sample(words[100:], 30)) for _ in range(40)]
    docs = frame([*enumerate(texts), (98, None), (99, "")])
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    kept = D.BENCHMARK_WEIGHT
    try:
        D.BENCHMARK_WEIGHT = 1.0
        index = D.build_index(docs.repartition(5), bench, count_as=4)
    finally:
        D.BENCHMARK_WEIGHT = kept
    idf = np.sqrt(index.square)
    # 45 passages, fewer than the rank: the directions hold each of them whole.
    some = idf > 0
    directions = np.zeros((D.TERMS, D.RANK))
    directions[some] = index.projection[some] / idf[some, None]
    passages = dense(items + texts, idf)
    held = np.sqrt(((passages @ directions) ** 2).sum(axis=1))
    assert held.min() > 0.99


def test_product_equals_plain_numpy(words, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(words) for _ in range(D.PASSAGE)) for _ in range(50)] + [None, ""]
    idf = np.random.default_rng(1).random(D.TERMS)
    probe = np.random.default_rng(2).standard_normal((D.TERMS, 6))
    weights = np.linspace(0.5, 2, len(texts))
    passages = dense([t or "" for t in texts], idf) * weights[:, None]
    want = passages.T @ (passages @ probe)
    monkeypatch.setattr(D, "GROUPS_AT_ONCE", 3)
    for most in (16384, 7):
        monkeypatch.setattr(D, "PASSAGES_IN_PRODUCT", most)
        got = np.zeros((6, D.TERMS))
        D._add_products(got, pa.array(texts), weights, idf * idf, (probe * idf[:, None]).astype(np.float32))
        assert np.abs(idf[:, None] * got.T - want).max() < 1e-4
