"""Cases at the edges of the text operators: short benchmark items, runs of white space, one
class of labels, other domains, many buckets, corpora with other columns."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from grainset.llm import decontamination, mixing, suffix_dedup, token_counts, toxicity


def test_short_items_are_searched_as_they_stand(spark, frame):
    docs = frame([
        (1, "so: what is the CAPITAL of - France? x"), (2, "the capital of francesca"), (3, "あの図書館で本を読む猫がいました。"),
        (4, None), (None, "capital of france"), (4, "capital of france"), (4, "capital of france"),
    ])
    items = [(10, "Capital of France?"), (11, "図書館で本を読む"), (12, "yes"), (13, None), (14, "capital of france")]
    index = decontamination.build_index(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id or 0, r.item_id, r.start_word) for r in decontamination.matches(docs, index).collect()))
    both = [(0, 10, 0), (0, 14, 0), (1, 10, 4), (1, 14, 4), (3, 11, 0)] + [(4, 10, 0)] * 2 + [(4, 14, 0)] * 2
    assert got == sorted(both) and index.left_out == 2


def test_white_space_runs_count_as_the_encoder_counts(monkeypatch):
    with open(token_counts.RANKS, "rb") as f:
        counter = token_counts._Counter(f.read(), token_counts.PATTERN)
    assert counter.count("a" + " " * 1_000_000 + "b") > 0 and counter.count("\n" * 2_000_000) > 0
    monkeypatch.setattr(token_counts, "LONG_RUN", 1)
    monkeypatch.setattr(token_counts, "_RUN", re.compile(f"{token_counts._SPACE}{{3,}}"))
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "word", "é", ".", "1", "'s", "   ", "\n\n\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert counter.count(text) == len(counter.text.encode_ordinary(text)), repr(text)


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_class_of_labels_is_the_score(spark, frame, toxic):
    docs = frame([(i, "some plain words") for i in range(20)] + [(None, None)])
    labels = spark.createDataFrame([(i, toxic) for i in range(20)], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
    assert len(scores) == 21 and np.allclose(scores, toxic, atol=1e-9)


def test_targets_come_from_the_labelled_domains(spark):
    rows = [(i, "the thing with this " * 20, "en") for i in range(30)] + [(i, "ja ei ole see siin " * 20, "et") for i in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    got = mixing.mixed(docs, labels).collect()
    assert {r.domain for r in got} == {"en/good", "et/good"} and all(r.rate > 0.5 for r in got)
    with pytest.raises(ValueError, match="no target"):
        mixing.mixed(docs, labels, {"fr/good": 1.0})
    out = mixing.derived_targets({"en/good": 80, "de/good": 20, "en/poor": 50})
    assert np.isclose(sum(out.values()), 1) and 1 < out["en/good"] / out["de/good"] < 4 and out["en/poor"] < 0.05


def test_bucket_numbers_at_ten_million_partitions():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 100_000)
    apart = rng.random(len(keys)) < 0.5
    p = suffix_dedup.bucket_numbers(keys, keys[::-1].copy(), apart, 10_000_000)
    assert (p[~apart] < 10_000_000).all() and (p[apart] >= 10_000_000).all() and (p >= 0).all()


def test_stages_with_other_columns(spark, tmp_path, words):
    rng = random.Random(3)
    rows = [(None if i % 9 == 0 else i, " ".join(rng.choice(words) for _ in range(40)), 0.5) for i in range(40)]
    docs = spark.createDataFrame(rows + [rows[1], (5, None, 0.1)], "doc_id long, text string, mix_rate double").selectExpr("*", "'en' as lang")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(f"item{i}" for i in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).columns == docs.columns
    lines = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and lines.count() == 42
    assert corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).count() == 42
    mixed = corpus_pipeline.mix_domains(spark, docs, str(tmp_path))
    assert mixed.columns[:4] == docs.columns and {"mix_rate_", "mix_domain"} <= set(mixed.columns)
    assert mixed.count() == 42 and mixed.where("mix_rate = 0.5").count() == 41
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
