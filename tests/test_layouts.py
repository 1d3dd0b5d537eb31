"""Shuffled sub-splits, collated batches, large sets, indexes with a state, ordered files,
resumed epochs, skeleton walks."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from grainset.operators import batches as B
from grainset.operators import predicates as P
from grainset.operators import rowgroups as RG
from grainset.operators import sampling as X
from grainset.operators import sequences as SQ
from grainset.plans.reader import DatasetSpec, read_dataset
from grainset.sources import metrics as M
from grainset.sources import writer as W


def test_parts_are_cut_from_the_shuffled_piece(spark):
    df = spark.range(100).select("id", (F.col("id") / 50).cast("int").alias("piece_id"))

    def parts(seed):
        rows = X.shuffled_parts(df, 3, ["id"], num_epochs=2, seed=seed).collect()
        return {(e, p, k): sorted(r.id for r in rows if (r.epoch, r.piece_id, r.part) == (e, p, k)) for e in (0, 1) for p in (0, 1) for k in range(3)}

    one, two = parts(1), parts(2)
    assert one != two and one[0, 0, 0] != one[1, 0, 0] and one == parts(1)
    for epoch in (0, 1):
        assert sorted(x for (e, _, _), ids in one.items() if e == epoch for x in ids) == list(range(100))
    # Parts are slices of the shuffled order, not of the physical one.
    assert one[0, 0, 0] != list(range(len(one[0, 0, 0])))


def test_reader_shuffles_before_the_split(spark, tmp_dir):
    path = tmp_dir + "/rows"
    spark.range(200).repartition(1).sortWithinPartitions("id").write.parquet(path)

    def read(seed, **more):
        spec = DatasetSpec("file://" + path, block_rows=50, row_key=["piece_id", "id"], shuffle_rows=True, shuffle_row_drop_partitions=3, seed=seed, **more)
        return read_dataset(spark, spec)

    rows = read(3, num_epochs=2).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(400))
    assert all(sorted(r.id for r in rows if r.epoch == e) == list(range(200)) for e in (0, 1))
    first = {r.id for r in rows if (r.epoch, r.piece_id, r.part) == (0, 0, 0)}
    assert first != set(range(len(first))) and first != {r.id for r in read(4).collect() if (r.piece_id, r.part) == (0, 0)}
    keyed = read(3, global_positions=False)
    keys = [c for c in keyed.columns if c.startswith("order_key")]
    assert [r.id for r in keyed.orderBy(*keys).collect()] == [r.id for r in rows if r.epoch == 0]


def test_collate_rebuilds_every_nesting(spark):
    rows = [
        (0, [{"a": 1, "d": Decimal("1.50")}, {"a": 2, "d": None}], {"x": 1, "y": 2}, [1.0, 2.0], "p"),
        (1, [{"a": 3, "d": Decimal("2.50")}], {"x": 3, "y": 4}, [3.0], "q"),
    ]
    kind = "i int, s array<struct<a int, d decimal(6,2)>>, m map<string,int>, t array<double>, w string"
    out = B.collate(B.batch_rows(spark.createDataFrame(rows, kind), 2, ["i"])).collect()[0]
    assert out.s == [(([1, 3]), [Decimal("1.50"), Decimal("2.50")])]  # as many steps as the shortest
    assert out.m == {"x": [1, 3], "y": [2, 4]}
    assert out.t == [[1.0, 2.0], [3.0]] and out.w == ["p", "q"]
    deep = spark.createDataFrame([(0, [[{"a": 1}], []])], "i int, s array<array<struct<a int>>>")
    assert B.collate(B.batch_rows(deep, 2, ["i"], ["s"])).collect()[0].s == [[([1],)], []]
    empty = spark.createDataFrame([(0, [])], "i int, s array<struct<a int>>")
    assert B.collate(B.batch_rows(empty, 2, ["i"], ["s"])).collect()[0].s == []
    lacking = spark.createDataFrame([(0, {"x": 1}), (1, {"y": 1})], "i int, m map<string,int>")
    with pytest.raises(Exception, match="lacks a key"):
        B.collate(B.batch_rows(lacking, 2, ["i"], ["m"])).collect()


def test_overlap_with_a_table(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (2, ["c"]), (3, []), (4, None), (5, [None, "z"])], "k int, a array<string>")
    wanted = spark.createDataFrame([("b",), ("z",), (None,), ("b",)], "v string")
    assert sorted(r.k for r in P.overlap_with(df, "a", wanted).collect()) == [1, 1, 5]
    assert P.overlap_with(df, "a", wanted.where("false")).count() == 0
    with pytest.raises(ValueError):
        P.overlap_with(df, "k", wanted)


def test_state_indexes_update_merge_and_look_up(spark, tmp_dir):
    df = spark.createDataFrame([(0, 1), (0, 5), (1, 10), (2, None)], "piece_id int, v int")
    ranges = RG.RangeIndexer("v_range", "v")
    index = RG.build_state_index(df, ranges)
    later = RG.build_state_index(spark.createDataFrame([(1, 2), (3, 40)], "piece_id int, v int"), ranges)
    merged = RG.merge_state_indexes(ranges, index, later)
    RG.write_state_index(merged, ranges, tmp_dir)

    def ask(low, high):
        return sorted(r.piece_id for r in RG.StateIndexSelector(ranges, (low, high), tmp_dir).pieces(df).collect())

    assert ask(3, 4) == [0, 1] and ask(6, 9) == [1] and ask(41, None) == [] and ask(None, 1) == [0] and ask(None, None) == [0, 1, 3]
    values = RG.build_indexes(df, [RG.SingleFieldIndexer("v", "v")])
    both = RG.IntersectIndexSelector([RG.SingleIndexSelector("v", [5, 10]), RG.StateIndexSelector(ranges, (6, 9), tmp_dir)])
    RG.check_index_names(values, both)
    assert [r.piece_id for r in both.pieces(values).collect()] == [1]
    many = RG.DistinctIndexer("v_many", "v")
    sketches = RG.merge_state_indexes(many, RG.build_state_index(df, many), RG.build_state_index(df, many))
    assert [r.piece_id for r in RG.StateIndexSelector(many, 2, sketches).pieces().collect()] == [0]


def test_files_keep_the_order(spark, tmp_dir):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("v"))
    W.write_in_order(df, tmp_dir + "/o", [F.desc("v"), F.asc("id")], 5)
    got = [(r.v, r.id) for r in W.read_in_order(spark, tmp_dir + "/o").orderBy("position").collect()]
    assert got == sorted(((i * 37 % 101, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    with pytest.raises(ValueError):
        W.write_in_order(df, tmp_dir + "/p", ["id"], 0)


def test_epochs_resume_and_replay_once(spark, tmp_dir):
    from grainset.streaming.epochs import epochs_to_table, infinite_epochs

    data = spark.range(20).withColumnRenamed("id", "k")
    stream = infinite_epochs(spark, data)
    path, state = tmp_dir + "/epochs", tmp_dir + "/state"
    assert epochs_to_table(stream, path, 2, state) == 2
    spark.range(3).selectExpr("id as k", "1 as epoch").write.mode("overwrite").parquet(path + "/batch=2")  # written, not committed
    epochs_to_table(stream, path, 4, state)
    rows = spark.read.parquet(path).groupBy("epoch").agg(F.count("*").alias("n"), F.countDistinct("k").alias("d")).collect()
    assert sorted((r.epoch, r.n, r.d) for r in rows) == [(e, 20, 20) for e in range(4)]


@pytest.mark.parametrize("seed", range(3))
def test_skeleton_walk_in_many_stretches(spark, monkeypatch, seed):
    """Tie runs over several buckets and stretches of two buckets."""
    monkeypatch.setattr(SQ, "WALK_BUCKETS", 2)
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(400):
        t += 0 if rng.random() < (0.6, 0.97, 0.2)[seed] else rng.randint(1, 4)
        rows.append((i, i // 150, t))
    df = spark.createDataFrame(rows, "id int, g int, t int")
    length = seed + 1
    spec = SQ.NGram({k: ["id"] for k in range(length)}, 3, "t", timestamp_overlap=False)
    got = sorted(r.t0.id for r in SQ.ngram_no_overlap(df, spec, ["g"], ["id"], bucket_rows=6).collect())
    want, end, scope = [], None, None
    for i in range(len(rows) - length + 1):
        window = rows[i : i + length]
        if window[0][1] != scope:
            end, scope = None, window[0][1]
        close = all(b[2] - a[2] <= 3 and a[1] == b[1] for a, b in zip(window, window[1:]))
        if close and (end is None or window[0][2] > end):
            want.append(i)
            end = window[-1][2]
    assert got == want


def test_repeated_measures_keep_the_last(spark):
    rows = [([("a", 1), ("b", 2), ("a", 3), (None, 4)],), ([],), (None,), ([("b", None), ("a", 1)],)]
    df = spark.createDataFrame(rows, "measures array<struct<metric string, value int>>")
    got = [r.m for r in df.select(M.measures_to_map().alias("m")).collect()]
    assert got == [{"a": 3, "b": 2}, {}, None, {"b": None, "a": 1}]


def test_floats_in_any_case(spark):
    df = spark.createDataFrame([("NaN",), ("Infinity",), ("1E3",), ("x",)], "v string")
    got = [r.f for r in df.select(M._float_text(F.col("v")).alias("f")).collect()]
    assert got[0] != got[0] and got[1:] == [float("inf"), 1000.0, None]
