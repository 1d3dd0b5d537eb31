import hashlib

import pytest
from pyspark.sql import functions as F

from grainset.functions.numbering import with_group_row_index, with_row_index
from grainset.operators import sampling as X


def test_row_index_matches_single_partition(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").repartition(7)
    got = with_row_index(e, [F.col("user_id"), F.col("ts"), F.col("event_id")], "i", num_partitions=5)
    got = {r["event_id"]: r["i"] for r in got.select("event_id", "i").collect()}
    rows = sorted((r["user_id"], r["ts"], r["event_id"]) for r in e.collect())
    assert all(got[eid] == i for i, (_, _, eid) in enumerate(rows))


def test_group_row_index(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "g int, v int")
    out = with_group_row_index(df, ["g"], [F.col("v")], "k").collect()
    for r in out:
        assert r["k"] == r["v"] // 3


def test_epochs_multiply_counts(spark):
    df = spark.range(10)
    assert X.with_epochs(df, 3).count() == 30
    for bad in (0, -1, 1.5, None, True):
        with pytest.raises(ValueError):
            X.with_epochs(df, bad)


def test_shuffles_preserve_multiset_and_differ_per_epoch(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.floor(F.col("id") / 20).alias("piece_id"))
    ep = X.with_epochs(df, 2)
    order = X.read_order(ep, ["k"], shuffle_pieces=True, shuffle_rows=True, seed=3)
    out = X.ordered_positions(ep, order).collect()
    assert sorted(r["position"] for r in out) == list(range(400))
    by_epoch = {e: [r["k"] for r in sorted(out, key=lambda r: r["position"]) if r["epoch"] == e] for e in (0, 1)}
    assert sorted(by_epoch[0]) == list(range(200)) and sorted(by_epoch[1]) == list(range(200))
    assert by_epoch[0] != by_epoch[1]
    # Rows of a piece stay together (piece order shuffled, rows shuffled inside pieces).
    pieces0 = [k // 20 for k in by_epoch[0]]
    assert all(pieces0[i] == pieces0[i - 1] or pieces0[i] not in pieces0[:i] for i in range(1, 200))
    # Unshuffled order is stable (piece, key).
    plain = X.ordered_positions(ep, X.read_order(ep, ["k"])).filter("epoch = 0").orderBy("position").collect()
    assert [r["k"] for r in plain] == list(range(200))


def _uniform(seed, d):
    h = hashlib.md5(f"{seed}|{d}".encode()).hexdigest()
    return int(h[:13], 16) / float(2 ** 52)


def test_weighted_mix_matches_sequential_rule(spark):
    a = spark.range(300).select(F.col("id").alias("v"))
    b = spark.range(200).select((F.col("id") + 1000).alias("v"))
    probs = [0.7, 0.3]
    out = X.weighted_mix([a, b], probs, [["v"], ["v"]], seed=11).orderBy("draw").collect()
    # Sequential reference rule with the same draws.
    cum = [0.7, 1.0]
    nxt = [0, 0]
    sizes = [300, 200]
    expect = []
    d = 0
    while True:
        u = _uniform(11, d)
        s = 0 if u < cum[0] else 1
        if nxt[s] >= sizes[s]:
            break
        expect.append((d, s, (nxt[s] if s == 0 else 1000 + nxt[s])))
        nxt[s] += 1
        d += 1
    assert [(r["draw"], r["source"], r["v"]) for r in out] == expect


def test_weighted_mix_proportions(spark):
    srcs = [spark.range(1000).select(F.lit(i).alias("f1"), F.col("id")) for i in range(3)]
    out = X.weighted_mix(srcs, [0.1, 0.5, 0.4], [["id"]] * 3, seed=1).orderBy("draw").limit(1000).collect()
    share = [sum(1 for r in out if r["f1"] == i) / len(out) for i in range(3)]
    assert abs(share[0] - 0.1) < 0.1 and abs(share[1] - 0.5) < 0.1 and abs(share[2] - 0.4) < 0.1
    with pytest.raises(ValueError):
        X.weighted_mix(srcs[:1], [1.0], [["id"]])


def test_zero_probability_source_never_ends_stream(spark):
    a = spark.range(50).select(F.col("id").alias("v"))
    b = spark.range(0).select(F.col("id").alias("v"))
    out = X.weighted_mix([a, b], [1.0, 0.0], [["v"], ["v"]], seed=2)
    assert out.count() == 50


def test_piece_positions_match_a_global_sort(spark):
    # Positions from the list of pieces equal the rank of the rows in the read order.
    df = spark.range(1000).select(F.col("id").alias("k"), F.floor(F.col("id") * 7 % 13).alias("piece_id")).repartition(5)
    for pieces, rows in ((False, False), (True, False), (True, True), (False, True)):
        got = X.piece_positions(df, ["k"], 3, shuffle_pieces=pieces, shuffle_rows=rows, seed=5)
        rep = X.with_epochs(df, 3)
        want = X.ordered_positions(rep, X.read_order(rep, ["k"], shuffle_pieces=pieces, shuffle_rows=rows, seed=5))
        key = lambda r: (r["epoch"], r["k"], r["piece_id"], r["position"])
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    with pytest.raises(ValueError):
        X.piece_positions(df, ["k"], 0)


def test_epochs_do_not_sort_rows_globally(spark):
    df = spark.range(1000).select("id", F.floor(F.col("id") / 10).alias("piece_id"))
    plan = X.piece_positions(df, ["id"], 3, shuffle_pieces=True)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_shuffled_batches_hold_every_row_once(spark):
    df = spark.range(1000).repartition(4)
    out = X.shuffled_batches(df, 64, ["id"], seed=3).collect()
    ids = [i for r in sorted(out, key=lambda r: r["batch_id"]) for i in r["id"]]
    assert sorted(ids) == list(range(1000)) and ids != list(range(1000))
    again = X.shuffled_batches(df.repartition(7), 64, ["id"], seed=3).collect()
    assert ids == [i for r in sorted(again, key=lambda r: r["batch_id"]) for i in r["id"]]


def test_mixed_sequences_must_share_a_spec(spark):
    from grainset.operators.sequences import NGram

    df = spark.range(5)
    a, b = NGram({0: ["id"], 1: ["id"]}, 1, "id"), NGram({0: ["id"]}, 1, "id")
    with pytest.raises(ValueError):
        X.weighted_mix([df, df], [0.5, 0.5], [["id"], ["id"]], specs=[a, b])
    X.weighted_mix([df, df], [0.5, 0.5], [["id"], ["id"]], specs=[a, a])


def test_capped_sample_and_quality(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    s = X.capped_sample(df, ["k"], 100, 3, seed=4).collect()
    assert len(s) == 300 and {r["k"] for r in s} == set(range(100))
    assert sorted(r["position"] for r in s if r["epoch"] == 2) == list(range(100))
    q = X.shuffle_quality(df, "k", runs=4, seed=1).first()
    assert 0 <= q["mean_abs_corr"] < 0.2


def test_hot_group_is_spread_over_tasks(spark):
    # One user holds a third of all rows: numbering must not put it in one task.
    n = 30000
    df = spark.range(n).select(F.col("id").alias("event_id"),
                               F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("user_id"))
    numbered = with_group_row_index(df, ["user_id"], [F.col("event_id")], "k", num_partitions=8)
    tasks = (numbered.filter("user_id = 0").select(F.spark_partition_id().alias("p")).distinct().count())
    assert tasks > 1
    hot = sorted(r["k"] for r in numbered.filter("user_id = 0").collect())
    assert hot == list(range(n // 3))
    # Sequences over the hot user are assembled in fixed-size buckets, not one task.
    from grainset.operators import sequences as SQ

    spec = SQ.NGram({0: ["event_id"], 1: ["event_id"]}, 10 ** 9, "event_id")
    seq = SQ.ngram(df.filter("user_id = 0"), spec, ["user_id"], ["event_id"], bucket_rows=1024)
    assert seq.count() == n // 3 - 1


def test_dense_group_rank(spark):
    from grainset.functions.numbering import with_dense_group_rank

    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("g"))
    out = with_dense_group_rank(df, "id", "g", "k", block_rows=300).collect()
    for g in (0, 1):
        ids = sorted(r["id"] for r in out if r["g"] == g)
        got = {r["id"]: r["k"] for r in out if r["g"] == g}
        assert [got[i] for i in ids] == list(range(len(ids)))


def test_shuffle_analysis_dataset(spark, tmp_dir):
    from grainset.sources.catalog import row_group_catalog
    from grainset.sources.synthetic import shuffle_analysis_dataset

    path = tmp_dir + "/shuf"
    df = shuffle_analysis_dataset(spark, path, num_rows=1000, row_group_size=100)
    assert df.count() == 1000
    cat = row_group_catalog(spark, path).collect()
    assert len(cat) == 10 and all(r["num_rows"] == 100 for r in cat)
    q = X.shuffle_quality(df, "id", runs=3, seed=2).first()
    assert q["mean_abs_corr"] < 0.2


def test_cleanup_numbering_tables(spark):
    from grainset.session import _tables, cleanup_checkpoints, ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    before = len(_tables)
    out = with_row_index(spark.range(100), [F.col("id")], "i")
    assert out.count() == 100 and len(_tables) > before
    assert cleanup_checkpoints(spark) >= 1 and not _tables
