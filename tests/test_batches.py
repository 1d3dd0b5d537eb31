import pytest
from pyspark.sql import functions as F

from grainset.operators import batches as B


def test_batches_concat_back(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") * 2).alias("v"))
    b = B.batch_rows(df, 10, [F.col("id")], ["id", "v"]).orderBy("batch_id").collect()
    assert len(b) == 11 and b[-1]["batch_rows"] == 3  # short tail emitted
    flat = [x for r in b for x in r["id"]]
    assert flat == list(range(103))
    full = B.batch_rows(df, 10, [F.col("id")], ["id"], full_only=True).count()
    assert full == 10  # incomplete tail never emitted
    back = B.unbatch(B.batch_rows(df, 10, [F.col("id")], ["id", "v"]), ["id", "v"]).collect()
    assert sorted((r["id"], r["v"]) for r in back) == [(i, 2 * i) for i in range(103)]


def test_stack_matrix_requires_equal_lengths(spark):
    ok = spark.createDataFrame([(i, [float(i)] * 3) for i in range(4)], "id long, x array<double>")
    m = B.stack_matrix(B.batch_rows(ok, 2, [F.col("id")], ["x"]), "x").collect()
    assert all(r["x_shape"] == [2, 3] for r in m)
    bad = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "id long, x array<double>")
    with pytest.raises(Exception, match="must be equal"):
        B.stack_matrix(B.batch_rows(bad, 2, [F.col("id")], ["x"]), "x").collect()


def test_piece_batches_follow_row_groups(spark):
    df = spark.range(25).select(F.col("id"), F.floor(F.col("id") / 10).alias("piece_id"), (F.col("id") * 3).alias("v"))
    out = {r["piece_id"]: r for r in B.piece_batches(df, ["id", "v"], ["id"]).collect()}
    assert [out[p]["batch_rows"] for p in (0, 1, 2)] == [10, 10, 5]
    assert out[1]["id"] == list(range(10, 20)) and out[2]["v"] == [60, 63, 66, 69, 72]


def test_batches_with_map_columns(spark):
    df = spark.range(7).selectExpr("id", "map('k', id) m")
    rows = {r["batch_id"]: r["m"] for r in B.batch_rows(df, 3, ["id"]).collect()}
    assert rows[1] == [{"k": 3}, {"k": 4}, {"k": 5}]


def _pieces(positions, size, rows_per_batch):
    import pyarrow as pa

    from grainset.operators.batches import cut_runs

    made = [
        pa.RecordBatch.from_pydict({"p": pa.array(positions[i : i + rows_per_batch], pa.int64()), "x": [str(p) for p in positions[i : i + rows_per_batch]]})
        for i in range(0, len(positions), rows_per_batch)
    ]
    return [r for b in cut_runs(iter(made), size, ["x"]) for r in b.to_pylist()]


def test_runs_are_cut_at_batches_and_gaps():
    for per in (1, 2, 3, 7, 100):
        got = _pieces([3, 4, 5, 6, 7, 8, 20, 21, 0, 1, 2], 4, per)
        assert [(r["batch_id"], r["__first"], r["batch_rows"], r["x"]) for r in got] == [
            (0, 3, 1, ["3"]), (1, 4, 4, ["4", "5", "6", "7"]), (2, 8, 1, ["8"]), (5, 20, 2, ["20", "21"]), (0, 0, 3, ["0", "1", "2"])]
    assert _pieces([], 4, 3) == []


def test_batches_of_divided_runs_equal_grouped_rows(spark):
    from pyspark.sql import functions as F

    from grainset.operators import batches as B

    df = spark.range(1003).select(
        ((F.col("id") * 389) % 1003).alias("id"),
        F.when(F.col("id") % 3 > 0, F.array(F.col("id").cast("string"), F.lit(None))).alias("a"),
        F.create_map(F.lit("k"), F.col("id")).alias("m"),
        F.col("id").cast("decimal(12,3)").alias("d"),
        F.timestamp_seconds("id").alias("t"),
        F.struct(F.lit(None).cast("int").alias("n"), F.col("id").alias("i")).alias("s"),
    )
    for size in (1, 7, 64, 5000):
        got = {r.batch_id: r for r in B.batch_rows(df, size, ["id"]).collect()}
        placed = df.withColumn("p", F.col("id"))
        want = {r.batch_id: r for r in B.batch_rows(placed, size, [], position_col="p").collect()}
        assert got == want and len(got) == -(-1003 // size)
        assert B.batch_rows(df, size, ["id"], full_only=True).count() == 1003 // size
    assert B.batch_rows(df.limit(0), 4, ["id"]).count() == 0
    plan = B.batch_rows(df, 64, ["id"])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan
