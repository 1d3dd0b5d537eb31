import pytest
from pyspark.sql import functions as F

from grainset.operators import rowgroups as RG
from grainset.sources import catalog as CAT


def _write_multi_group(spark, path, n=20000, block=40000):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 7).alias("m"), F.concat(F.lit("s"), F.col("id")).alias("s"))
    df.coalesce(2).write.option("parquet.block.size", str(block)).parquet(path)


def test_catalog_and_attach_with_space_in_path(spark, tmp_dir):
    path = tmp_dir + "/data set"
    _write_multi_group(spark, path)
    cat = CAT.row_group_catalog(spark, path)
    rows = cat.collect()
    assert len(rows) > 2
    assert sorted(r["piece_id"] for r in rows) == list(range(len(rows)))
    assert sum(r["num_rows"] for r in rows) == 20000
    # piece ids follow (relative path, row group) order
    order = sorted(rows, key=lambda r: (r["rel_path"], r["row_group"]))
    assert [r["piece_id"] for r in order] == list(range(len(rows)))
    data = spark.read.parquet(path)
    tagged = CAT.attach_pieces(data, cat)
    assert tagged.count() == 20000  # no row lost in the join (path encoding)
    per_piece = {r["piece_id"]: r["count"] for r in tagged.groupBy("piece_id").count().collect()}
    assert per_piece == {r["piece_id"]: r["num_rows"] for r in rows}
    per_file = CAT.row_groups_per_file(cat).collect()
    assert sum(r["num_row_groups"] for r in per_file) == len(rows)


def _f1(spark):
    # F1-like: 100 ids, partition key p_{id // 10}: 10 pieces of 10 rows.
    rows = []
    for i in range(100):
        arr = None if i % 5 == 0 else ([] if i % 4 == 0 else [str(i), str(i + 1)])
        rows.append((i, i // 10, ["test_sensor"], arr, f"p_{i // 10}"))
    return spark.createDataFrame(rows, "id long, piece_id long, sensor_name array<string>, "
                                       "string_array_nullable array<string>, partition_key string")


def _index(df):
    return RG.build_indexes(df, [
        RG.SingleFieldIndexer("id_index", "id"),
        RG.SingleFieldIndexer("sensor_index", "sensor_name"),
        RG.SingleFieldIndexer("string_array_index", "string_array_nullable"),
        RG.SingleFieldIndexer("partition_index", "partition_key"),
    ])


def test_selector_golden_counts(spark):
    df = _f1(spark)
    idx = _index(df)
    sel = RG.SingleIndexSelector("id_index", [2, 18])
    assert RG.select_pieces(df, idx, sel).count() == 20
    assert RG.select_pieces(df, idx, RG.SingleIndexSelector("sensor_index", ["test_sensor"])).count() == 100
    inter = RG.IntersectIndexSelector([RG.SingleIndexSelector("id_index", [2, 18]),
                                       RG.SingleIndexSelector("sensor_index", ["test_sensor"])])
    assert RG.select_pieces(df, idx, inter).count() == 20
    uni = RG.UnionIndexSelector([RG.SingleIndexSelector("id_index", [2, 18]),
                                 RG.SingleIndexSelector("sensor_index", ["test_sensor"])])
    assert RG.select_pieces(df, idx, uni).count() == 100
    assert RG.select_pieces(df, idx, RG.SingleIndexSelector("string_array_index", ["100"])).count() == 10
    assert RG.select_pieces(df, idx, RG.SingleIndexSelector("partition_index", ["p_1"])).count() == 10
    assert RG.select_pieces(df, idx, RG.SingleIndexSelector("id_index", [12345])).count() == 0
    assert RG.select_pieces(df, idx, RG.UnionIndexSelector([])).count() == 0
    with pytest.raises(ValueError):
        RG.IntersectIndexSelector([])
    with pytest.raises(ValueError):
        RG.check_index_names(idx, RG.SingleIndexSelector("nope", [1]))


def test_not_null_index_and_report(spark):
    df = _f1(spark)
    idx = RG.build_indexes(df, [RG.FieldNotNullIndexer("arr_nn", "string_array_nullable")])
    row = RG.index_arrays(idx).collect()[0]
    assert row["value"] == "*" and row["piece_ids"] == list(range(10))
    rep = RG.index_report(_index(df)).filter("index_name = 'sensor_index'").collect()
    assert rep[0]["n_pieces"] == 10


def test_shards_partition_pieces(spark):
    df = _f1(spark)
    seen = []
    for k in range(3):
        seen += [r["id"] for r in RG.shard(df, k, 3, total_pieces=10).collect()]
    assert sorted(seen) == list(range(100))
    with pytest.raises(ValueError):
        RG.shard(df, 0, 11, total_pieces=10)
    with pytest.raises(ValueError):
        RG.shard(df, 0, 0)
    with pytest.raises(ValueError):
        RG.shard(df, "0", 2)


def test_subsplit_parts_partition_each_piece(spark):
    df = _f1(spark)
    out = RG.subsplit_parts(df, 3, ["id"]).collect()
    assert sorted(r["id"] for r in out) == list(range(100))
    for p in range(10):
        parts = sorted(r["part"] for r in out if r["piece_id"] == p)
        assert parts == [0] * 4 + [1] * 3 + [2] * 3  # floor(i / (10/3))
    over = RG.subsplit_parts(df, 3, ["id"], overlap=1).collect()
    assert len(over) == 100 + 10 * 2  # each boundary row is repeated in the earlier part


def test_attach_moves_no_rows_when_the_estimate_is_large(spark, tmp_dir, monkeypatch):
    import grainset.session as S

    path = tmp_dir + "/large estimate"
    _write_multi_group(spark, path)
    cat = CAT.row_group_catalog(spark, path)
    real, calls = S.estimated_bytes, []

    def first_is_huge(df):
        calls.append(1)
        return 1 << 50 if len(calls) == 1 else real(df)

    monkeypatch.setattr(S, "estimated_bytes", first_is_huge)
    out = CAT.attach_pieces(spark.read.parquet(path), cat)
    assert len(calls) == 2  # the file table was written and measured
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert out.count() == spark.read.parquet(path).count()


def test_path_hash_shards_follow_the_path_below_the_root(spark):
    df = spark.createDataFrame([(f"file:/a/d/part-{i}",) for i in range(40)], "p string")
    parts = [RG.shard_by_path_hash(df, k, 3, F.col("p")).count() for k in range(3)]
    assert sum(parts) == 40 and min(parts) > 0


def test_attach_binary_search_matches_linear(spark, tmp_dir):
    path = tmp_dir + "/many groups"
    spark.range(30000).select(F.col("id"), (F.col("id") * 7 % 13).alias("m")).coalesce(1).write.option(
        "parquet.block.size", "4096").parquet(path)
    cat = CAT.row_group_catalog(spark, path)
    g = CAT.max_groups_per_file(cat)
    assert g > 16
    data = spark.read.parquet(path)
    lin = {r["id"]: r["piece_id"] for r in CAT.attach_pieces(data, cat).select("id", "piece_id").collect()}
    bs = {r["id"]: r["piece_id"] for r in CAT.attach_pieces(data, cat, max_groups_per_file=g).select("id", "piece_id").collect()}
    assert lin == bs and len(bs) == 30000


def test_pieces_survive_odd_names_moves_and_appends(spark, tmp_path):
    import os
    import shutil

    from pyspark.errors import PySparkException

    from grainset.plans.reader import DatasetSpec, read_dataset
    from grainset.sources import writer as W

    path = str(tmp_path / "data set")
    spark.range(200).repartition(2).write.parquet(path)
    part = sorted(f for f in os.listdir(path) if f.startswith("part-"))[0]
    os.rename(f"{path}/{part}", f"{path}/part-odd")
    assert read_dataset(spark, DatasetSpec(f"file://{path}")).count() == 200
    W.stamp_metadata(spark, path)
    moved = str(tmp_path / "moved")
    shutil.copytree(path, moved)
    assert read_dataset(spark, DatasetSpec(f"file://{moved}")).count() == 200
    spark.range(50).write.mode("append").parquet(moved)
    with pytest.raises((ValueError, PySparkException), match="stale catalog"):
        read_dataset(spark, DatasetSpec(f"file://{moved}")).count()


def test_selector_values_match_by_type(spark):
    df = spark.sql("SELECT id DIV 10 AS piece_id, id % 2 = 0 AS b, CAST(id DIV 10 AS double) AS d, "
                   "9007199254740992L + id AS n FROM range(40)")
    idx = RG.build_indexes(df, [RG.SingleFieldIndexer(x, x) for x in ("b", "d", "n")])
    found = lambda name, *v: sorted(r[0] for r in RG.SingleIndexSelector(name, v).pieces(idx).collect())
    assert found("b", True) == [0, 1, 2, 3]
    assert found("d", 2) == found("d", 2.0) == [2]
    assert found("n", 9007199254740993) == [0] and found("n", 9007199254741002) == [1]
    assert found("d", "nothing") == []


def test_shards_deal_out_filtered_pieces(spark, tmp_path):
    from grainset.plans.reader import DatasetSpec, read_dataset

    path = str(tmp_path / "parts")
    spark.range(0, 40, 1, 4).selectExpr("id", "id DIV 10 AS p").write.partitionBy("p").parquet(path)
    read = lambda k, n: read_dataset(spark, DatasetSpec(
        f"file://{path}", fields=["id"], filters=[[("p", "in", {0, 2})]], cur_shard=k, shard_count=n))
    assert [read(k, 2).count() for k in (0, 1)] == [10, 10]
    with pytest.raises(ValueError):
        read(0, 4)


def test_postings_hold_the_pieces(spark):
    # Pieces around the edges of words, the sign bit (63) among them, one beyond 2^31.
    pieces = [0, 1, 62, 63, 64, 127, 128, 1 << 33]
    df = spark.createDataFrame([(p, v) for p in pieces for v in ("all", "low" if p < 64 else "high") for _ in (1, 2)],
                               "piece_id long, v string")
    index = RG.build_indexes(df, [RG.SingleFieldIndexer("v", "v")])
    assert index.where("value = 'low'").count() == 1 and index.where("value = 'all'").count() == 4
    listed = {r["value"]: r["piece_ids"] for r in RG.index_arrays(index).collect()}
    assert listed == {"all": pieces, "low": [0, 1, 62, 63], "high": [64, 127, 128, 1 << 33]}
    assert sorted((r.value, r.piece_id) for r in RG.index_pieces(index).collect()) == sorted(
        (v, p) for v, ps in listed.items() for p in ps)
    assert {r["value"]: r["n_pieces"] for r in RG.index_report(index).collect()} == {"all": 8, "low": 4, "high": 4}
    halves = [RG.build_indexes(df.where(c), [RG.SingleFieldIndexer("v", "v")]) for c in ("piece_id < 100", "piece_id >= 63")]
    assert sorted(RG.merge_indexes(*halves).collect()) == sorted(index.collect())


def test_selector_trees_are_one_aggregate(spark):
    df = spark.createDataFrame([(p, str(p % 3), p * 10) for p in range(200)] + [(None, "0", 1)], "piece_id long, v string, n long")
    index = RG.build_indexes(df.where("piece_id IS NOT NULL"), [RG.SingleFieldIndexer("v", "v")])
    ranges = RG.RangeIndexer("n", "n")
    state = RG.build_state_index(df.where("piece_id IS NOT NULL"), ranges)
    one = lambda *v: RG.SingleIndexSelector("v", v)
    band = RG.StateIndexSelector(ranges, (600, 1300), state)
    tree = RG.IntersectIndexSelector([RG.UnionIndexSelector([one("0"), one("1", "7"), RG.UnionIndexSelector([])]),
                                      RG.UnionIndexSelector([RG.IntersectIndexSelector([one("1"), band]), one("0")])])
    want = [p for p in range(200) if p % 3 == 0 or (p % 3 == 1 and 60 <= p <= 130)]
    assert sorted(r.piece_id for r in tree.pieces(index).collect()) == want
    assert sorted(r.piece_id for r in RG.select_pieces(df, index, tree).collect()) == want
    plan = tree.words(index)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert tree.words(index).where("bits = 0").count() == 0
    assert RG.IntersectIndexSelector([one("0"), one("1")]).words(index).count() == 0


def test_indexes_stored_as_rows_of_pieces_are_read(spark, tmp_dir):
    index = _index(_f1(spark))
    RG.write_indexes(index, tmp_dir + "/packed")
    RG.write_indexes(RG.index_pieces(index), tmp_dir + "/rows")
    packed, rows = (sorted(RG.read_indexes(spark, f"{tmp_dir}/{k}").collect()) for k in ("packed", "rows"))
    assert packed == rows == sorted(index.collect())
