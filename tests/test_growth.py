"""Catalogs of growing datasets, the record store, distributed running sums, file selection."""

import os

import pytest
from pyspark.sql import functions as F

from grainset.functions import numbering
from grainset.operators import sampling as X
from grainset.plans import reader as R
from grainset.sources import catalog as CAT
from grainset.sources import metrics as M
from grainset.sources import writer as W


def test_update_catalog_keeps_ids_and_reports_gone_files(spark, tmp_dir):
    path = os.path.join(tmp_dir, "grown")
    first = W.materialize_dataset(spark.range(100).repartition(3), path)
    before = {(r.rel_path, r.row_group): r.piece_id for r in first.collect()}
    assert W.update_catalog(spark, path) == W.CatalogUpdate(0, 0, 0)
    spark.range(100, 150).repartition(2).write.mode("append").parquet(path)
    assert W.update_catalog(spark, path) == W.CatalogUpdate(2, 2, 0)
    after = {(r.rel_path, r.row_group): r.piece_id for r in W.load_catalog(spark, path).collect()}
    assert before.items() <= after.items() and sorted(after.values()) == list(range(5))
    rows = R.read_dataset(spark, R.DatasetSpec(f"file://{path}"))
    assert sorted(r.id for r in rows.collect()) == list(range(150))
    # A file that is gone: an error that names it, or dropped; a new one can come with it.
    gone = min(before)[0]
    os.remove(os.path.join(path, gone))
    spark.range(150, 160).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="are gone.*" + gone[:20]):
        W.update_catalog(spark, path)
    assert W.update_catalog(spark, path, forget_missing=True) == W.CatalogUpdate(1, 1, 1)
    left = {(r.rel_path, r.row_group): r.piece_id for r in W.load_catalog(spark, path).collect()}
    assert len(left) == 5 and max(left.values()) == 5 and all(after.get(k, 5) == v for k, v in left.items())
    assert R.read_dataset(spark, R.DatasetSpec(f"file://{path}")).count() == spark.read.parquet(path).count()


def test_files_without_row_groups_are_not_new(spark, tmp_dir):
    # Spark's first task writes a file even if it has no rows, as for a split without a row group.
    path = os.path.join(tmp_dir, "grown")
    holes = lambda lo, hi: spark.range(lo, hi, 1, 4).where(F.col("id") >= (lo + hi) // 2)
    W.materialize_dataset(holes(0, 100), path)
    assert W.update_catalog(spark, path) == W.CatalogUpdate(0, 0, 0)
    holes(100, 200).write.mode("append").parquet(path)
    assert W.update_catalog(spark, path) == W.CatalogUpdate(2, 2, 0)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 6
    rows = R.read_dataset(spark, R.DatasetSpec(f"file://{path}"))
    assert sorted(r.id for r in rows.collect()) == [*range(50, 100), *range(150, 200)]
    # One that has rows still is.
    spark.range(200, 210).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="stale catalog.* 1 files are new"):
        R.read_dataset(spark, R.DatasetSpec(f"file://{path}"))


def test_record_store_runs(spark, tmp_dir):
    path = os.path.join(tmp_dir, "store")
    assert M.store_keys(spark, path).count() == 0
    rows = "commit_hash string, author string"
    M.write_record_store(spark.createDataFrame([("a", "x"), ("a", "w"), (None, "n"), ("b/c d", "é")], rows), path, run="one")
    got = {r.key: (r.run, r.value) for r in M.read_record_store(spark, path).collect()}
    assert got == {"a": ("one", '{"commit_hash":"a","author":"w"}'), "b/c d": ("one", '{"commit_hash":"b/c d","author":"é"}')}
    with pytest.raises(ValueError, match="already"):
        M.write_record_store(spark.createDataFrame([("z", "z")], rows), path, run="one")
    with pytest.raises(ValueError, match="run name"):
        M.write_record_store(spark.createDataFrame([("z", "z")], rows), path, run="a/b")
    # Documents of a run that never reached the manifest are not there, and it can run again.
    more = spark.createDataFrame([("a", "later"), ("d", None)], rows)
    os.makedirs(f"{path}/records/run=two/bucket=3")
    with open(f"{path}/records/run=two/bucket=3/part-half.txt", "w") as out:
        out.write('{"key":"half","value":"{}"}\n')
    assert M.read_record_store(spark, path).count() == 2
    M.write_record_store(more, path, run="two")
    got = {r.key: r.run for r in M.read_record_store(spark, path).collect()}
    assert got == {"a": "one", "b/c d": "one", "d": "two"}
    # A run that has nothing new, and an empty table.
    M.write_record_store(more, path, run="three")
    M.write_record_store(more.limit(0), path)
    assert M.read_record_store(spark, path).count() == 3


def test_running_sum_in_ranges_equals_one_task(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("v"))
    one = numbering.with_running_sum(df, ["k", "id"], "v", "s")
    many = numbering.with_running_sum(df, ["k", "id"], "v", "s", one_task_bytes=0)
    assert one.columns == many.columns
    want, total = [], 0
    for r in sorted(df.collect(), key=lambda r: (r.k, r.id)):
        want.append((r.id, total))
        total += r.v or 0
    for got in (one, many):
        assert sorted((r.id, r.s) for r in got.collect()) == sorted(want)
    assert numbering.with_running_sum(df.limit(0), ["k"], "v", "s", one_task_bytes=0).count() == 0


def test_capped_sample_by_range_sort(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"))
    a = X.capped_sample(df, ["id"], 300, 2, 5).collect()
    monkeypatch.setattr(X, "TOP_ROWS", 10)
    b = X.capped_sample(df, ["id"], 300, 2, 5).collect()
    assert sorted(a) == sorted(b) and len(a) == 600


def test_long_file_selections_are_not_listed(spark, tmp_dir, monkeypatch, files_read):
    path = os.path.join(tmp_dir, "many files")
    spark.range(400).withColumn("b", F.col("id") % 40).repartition("b").write.partitionBy("b").parquet(path)
    data = spark.read.parquet(path)
    catalog = R._catalog_for(spark, [f"file://{path}"])
    assert catalog.count() == 40
    few, none = catalog.where("piece_id IN (3, 4, 30)"), catalog.limit(0)
    for most in (10, 1):  # by name, then in ranges
        monkeypatch.setattr(R, "MOST_LISTED_FILES", most)
        scan = R.in_files(data, few)
        assert 3 <= files_read(scan) <= 40 and scan.count() >= 30
        assert files_read(R.in_files(data, none)) == 0
        # Whatever the ranges let through, the rows are those of the pieces.
        assert CAT.attach_pieces(scan, catalog).where("piece_id IN (3, 4, 30)").count() == 30
    monkeypatch.setattr(R, "MOST_LISTED_FILES", 10)
    assert files_read(R.in_files(data, few)) == 3
    monkeypatch.setattr(R, "MOST_LISTED_FILES", 1)
    monkeypatch.setattr(R, "FILE_RANGES", 8)
    ends = catalog.where("piece_id < 5 OR piece_id >= 35")
    assert 10 <= files_read(R.in_files(data, ends)) < 40  # ranges leave files out, too
