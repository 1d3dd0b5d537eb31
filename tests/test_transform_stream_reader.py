import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainset.operators import predicates as P
from grainset.operators import rowgroups as RG
from grainset.operators.sequences import NGram
from grainset.operators.transform import TransformSpec, apply_transform, edit_field, transform_schema
from grainset.plans.reader import DatasetSpec, normalize_urls, read_dataset


def test_transform_schema_rules():
    st = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "c")])
    s1 = transform_schema(st, TransformSpec(removed_fields=["b", "zz"], edit_fields=[("a", "float64", (), False)]))
    assert s1.fieldNames() == ["c", "a"] and s1["a"].dataType == T.DoubleType()
    s2 = transform_schema(st, TransformSpec(selected_fields=["c", "a"]))
    assert s2.fieldNames() == ["c", "a"]
    with pytest.raises(ValueError):
        TransformSpec(removed_fields=["a"], selected_fields=["b"])


def test_batch_row_and_piece_transforms(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(10)], "id long, piece_id long, v double")

    def batch(pdf):
        pdf["v"] = pdf["v"] * 2
        return pdf

    out = apply_transform(df, TransformSpec(batch, removed_fields=["piece_id"]))
    assert out.columns == ["id", "v"] and sorted(r["v"] for r in out.collect()) == [2.0 * i for i in range(10)]

    def row(r):
        return {"id": r["id"], "piece_id": r["piece_id"], "m": np.full((2, 2), r["v"])}

    spec = TransformSpec(row, edit_fields=[edit_field("m", "float64", (2, 2))], removed_fields=["v"], mode="row")
    out = apply_transform(df, spec).collect()
    assert out[3]["m"]["shape"] == [2, 2] and out[3]["m"]["values"] == [3.0] * 4

    def bad(pdf):
        return pdf.assign(extra=1)

    with pytest.raises(Exception, match="do not match"):
        apply_transform(df, TransformSpec(bad)).collect()

    def per_piece(pdf):
        return pd.DataFrame({"piece_id": [pdf["piece_id"].iloc[0]], "n": [len(pdf)]})

    spec = TransformSpec(per_piece, removed_fields=["id", "v"], edit_fields=[edit_field("n", "int64")], mode="piece")
    got = {r["piece_id"]: r["n"] for r in apply_transform(df, spec).collect()}
    assert got == {0: 5, 1: 5}


def test_url_rules():
    assert normalize_urls("file:///a/b/") == ["file:///a/b"]
    with pytest.raises(ValueError):
        normalize_urls([])
    with pytest.raises(ValueError):
        normalize_urls(["file:///a", "hdfs://nn/a"])
    with pytest.raises(ValueError):
        normalize_urls("/no/scheme")


def test_read_dataset_plan(spark, tmp_dir):
    path = tmp_dir + "/ds"
    spark.range(400).select(F.col("id"), (F.col("id") % 5).alias("m")).coalesce(1).write.option(
        "parquet.block.size", "2048").parquet(path)
    url = "file://" + path
    base = read_dataset(spark, DatasetSpec(url, fields=["id", "m"], block_rows=50))
    assert base.count() == 400 and base.select("piece_id").distinct().count() == 8
    three = read_dataset(spark, DatasetSpec(url, fields=["id"], block_rows=50, num_epochs=3,
                                            shuffle_row_groups=True, shuffle_rows=True, seed=1))
    assert three.count() == 1200 and sorted(r["position"] for r in three.collect()) == list(range(1200))
    pred = read_dataset(spark, DatasetSpec(url, fields=["id", "m"], block_rows=50,
                                           predicate=P.in_set([0], "m"), cur_shard=1, shard_count=2))
    ids = [r["id"] for r in pred.collect()]
    assert all(i % 5 == 0 and (i // 50) % 2 == 1 for i in ids) and len(ids) == 40
    with pytest.raises(ValueError):
        read_dataset(spark, DatasetSpec(url, fields=["id"], block_rows=50, predicate=P.in_set([0], "m")))
    seq = read_dataset(spark, DatasetSpec(url, fields=["id"], block_rows=50,
                                          ngram=NGram({0: ["id"], 1: ["id"]}, 1, "id")))
    assert seq.count() == 8 * 49  # windows never cross a piece
    split = read_dataset(spark, DatasetSpec(url, fields=["id"], block_rows=50, shuffle_row_drop_partitions=5,
                                            ngram=NGram({0: ["id"], 1: ["id"]}, 1, "id")))
    assert split.select("t0.id").distinct().count() == 8 * 49  # overlap keeps every window
    rg = read_dataset(spark, DatasetSpec(url, fields=["id"]))
    assert rg.count() == 400 and rg.select("piece_id").distinct().count() > 1


def test_infinite_epochs_stream(spark, tmp_dir):
    from grainset.streaming.epochs import infinite_epochs, run_epochs

    data = spark.range(5).select(F.col("id").alias("k"))
    stream = infinite_epochs(spark, data, seed=3, order_cols=["k"])
    seen = []

    def sink(batch, batch_id):
        seen.append((batch_id, sorted(r["k"] for r in batch.collect()), {r["epoch"] for r in batch.collect()}))

    assert run_epochs(stream, sink, 3, tmp_dir + "/ckpt", timeout_s=120) == 3
    assert len(seen) == 3
    for bid, ks, eps in seen[:3]:
        assert ks == list(range(5)) and len(eps) == 1


def test_predicates_on_stream(spark, tmp_dir):
    src = tmp_dir + "/in"
    spark.range(20).select(F.col("id"), (F.col("id") % 4).alias("m")).write.parquet(src)
    stream = spark.readStream.schema("id long, m long").parquet(src)
    filtered = P.in_negate(P.in_set([0, 1], "m")).apply(stream)
    q = filtered.writeStream.format("memory").queryName("pred_stream").option(
        "checkpointLocation", tmp_dir + "/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.sql("select id from pred_stream").collect()) == [
        i for i in range(20) if i % 4 in (2, 3)]


def test_partitioned_read_and_shard_check(spark, tmp_dir):
    path = tmp_dir + "/part"
    spark.range(60).select(F.col("id"), (F.col("id") % 3).cast("string").alias("pk")).write.partitionBy("pk").parquet(path)
    url = "file://" + path
    out = read_dataset(spark, DatasetSpec(url, fields=["id"], predicate=P.in_set(["1"], "pk"),
                                          strict_predicate_fields=False))
    assert out.columns == ["position", "epoch", "piece_id", "id"]  # partition column not returned
    assert sorted(r["id"] for r in out.collect()) == [i for i in range(60) if i % 3 == 1]
    with pytest.raises(ValueError, match="shards"):
        read_dataset(spark, DatasetSpec(url, fields=["id"], cur_shard=0, shard_count=1000))
    from grainset.sources.schema import infer_fields

    names = [f.name for f in infer_fields(spark.read.parquet(path).schema, strict_compat=True, partition_columns=["pk"])]
    assert names == ["pk", "id"]


def test_selector_prunes_files(spark, tmp_dir, files_read):
    from grainset.sources import writer as W

    path = tmp_dir + "/sel ds"
    # range() with 4 partitions writes exactly one 1000-id block per file.
    spark.range(0, 4000, numPartitions=4).select(F.col("id"), F.floor(F.col("id") / 1000).alias("blk")).write.parquet(path)
    W.stamp_metadata(spark, path)
    W.build_dataset_indexes(spark, path, [RG.SingleFieldIndexer("blk_index", "blk")])
    url = "file://" + path
    spec = DatasetSpec(url, fields=["id", "blk"], selector=RG.SingleIndexSelector("blk_index", [2]),
                       index_path=path + "/_grainset/index")
    out = read_dataset(spark, spec)
    ids = sorted(r["id"] for r in out.collect())
    assert ids == list(range(2000, 3000))
    assert [r["id"] for r in sorted(out.collect(), key=lambda r: r["position"])] == ids  # physical order kept
    from grainset.plans.reader import in_files

    words = spec.selector.words(W.load_dataset_indexes(spark, path))
    files = RG.in_words(W.load_catalog(spark, path), words)
    assert files_read(in_files(spark.read.parquet(url), files)) == 1  # only the file holding block 2 is scanned


def test_golden_ngram_through_reader(spark, tmp_dir):
    path = tmp_dir + "/golden"
    ids = [0, 3, 8, 10, 11, 20, 23]
    # One file (one row group) per partition value, as in the reference fixture.
    spark.createDataFrame([(i, f"p_{i // 10}") for i in ids], "id long, partition_key string").coalesce(1).write.partitionBy(
        "partition_key").parquet(path)
    out = read_dataset(spark, DatasetSpec("file://" + path, fields=["id"], ngram=NGram({0: ["id"], 1: ["id"]}, 4, "id")))
    assert sorted((r["t0"]["id"], r["t1"]["id"]) for r in out.collect()) == [(0, 3), (10, 11), (20, 23)]


def test_ngram_scope_is_the_row_group(spark, tmp_dir):
    from grainset.sources.catalog import row_group_catalog

    path = tmp_dir + "/groups"
    spark.range(6000).coalesce(1).write.option("parquet.block.size", "8192").parquet(path)
    sizes = [r["num_rows"] for r in row_group_catalog(spark, path).collect()]
    assert len(sizes) > 1
    out = read_dataset(spark, DatasetSpec("file://" + path, fields=["id"], ngram=NGram({0: ["id"], 1: ["id"]}, 1, "id")))
    assert out.count() == sum(n - 1 for n in sizes)


def test_reader_without_global_positions(spark, tmp_dir):
    path = tmp_dir + "/nopos"
    spark.range(300).select(F.col("id")).coalesce(1).write.parquet(path)
    spec = DatasetSpec("file://" + path, fields=["id"], block_rows=50, num_epochs=2, shuffle_row_groups=True,
                       shuffle_rows=True, seed=3)
    with_pos = [r["id"] for r in read_dataset(spark, spec).orderBy("position").collect()]
    spec.global_positions = False
    keyed = read_dataset(spark, spec)
    keys = [c for c in keyed.columns if c.startswith("order_key")]
    assert [r["id"] for r in keyed.orderBy(*keys).collect()] == with_pos
    assert "ExistingRDD" not in keyed._jdf.queryExecution().executedPlan().toString()


def test_row_functions_see_exact_integers(spark):
    df = spark.createDataFrame([(9007199254740993, 1), (None, 2), (9007199254740995, 3)], "n long, k int")
    spec = TransformSpec(lambda r: {"k": r["k"], "n": r["n"], "s": repr(r["n"])},
                         edit_fields=[edit_field("s", "str", (), True)], mode="row")
    got = {r["k"]: (r["n"], r["s"]) for r in apply_transform(df, spec).collect()}
    assert got == {1: (9007199254740993, "9007199254740993"), 2: (None, "None"), 3: (9007199254740995, "9007199254740995")}
