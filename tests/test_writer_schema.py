import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainset.operators.projection import conform, convert_precision, insert_explicit_nulls, select_fields, tensor_ready
from grainset.sources import schema as S
from grainset.sources import synthetic as SY
from grainset.sources import writer as W

FIELDS = [
    S.Field("id", "int64"),
    S.Field("id2", "int32"),
    S.Field("u8", "uint8"),
    S.Field("flt", "float64"),
    S.Field("matrix", "float32", (4, 3, 2)),
    S.Field("vec", "uint16", (None,)),
    S.Field("dec", "decimal", (), decimal=(10, 9)),
    S.Field("name", "str", (), nullable=True),
]


def test_schema_metadata_roundtrip(spark, tmp_dir):
    df = SY.generate_rows(spark, FIELDS, 50, seed=3)
    path = tmp_dir + "/ds"
    cat = W.materialize_dataset(df, path, S.make_schema(FIELDS), row_group_size_mb=1)
    back = spark.read.parquet(path)
    assert S.stored_schema(back) == FIELDS
    assert W.load_declared_schema(spark, path) == S.make_schema(FIELDS)
    assert cat.agg(F.sum("num_rows")).first()[0] == 50
    # Synthetic values respect dtype ranges and unknown dims become 13.
    r = back.select(F.min("u8"), F.max("u8"), F.min("flt"), F.max("flt"), F.max(F.size("vec"))).first()
    assert 0 <= r[0] <= r[1] <= 255 and 0.0 <= r[2] <= r[3] < 1.0 and r[4] == 13
    assert back.select(F.size("matrix.values")).distinct().first()[0] == 24


def test_stored_schema_missing(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        S.stored_schema(df)


def test_scalar_type_rules():
    assert S.Field("a", "uint8").spark_type() == T.ShortType()
    assert S.Field("a", "uint16").spark_type() == T.IntegerType()
    with pytest.raises(ValueError):
        S.Field("a", "uint32").spark_type()
    assert S.Field("a", "uint32", (None,)).spark_type() == T.ArrayType(T.LongType(), True)
    # Equality ignores the codec.
    assert S.Field("a", "int8", (), "x") == S.Field("a", "int8", (), "y")


def test_tensor_compliance(spark):
    df = spark.createDataFrame(
        [([4, 3], list(range(12))), ([4, 2], list(range(8))), ([4, 3], list(range(11)))],
        "s array<int>, v array<int>",
    ).select(S.tensor(F.col("s"), F.col("v")).alias("t"))
    ok = [r[0] for r in df.select(S.tensor_compliant(F.col("t"), (None, 3))).collect()]
    assert ok == [True, False, False]
    with pytest.raises(Exception, match="comply"):
        df.select(S.check_tensor("t", (4, 3))).collect()


def test_npy_roundtrip(spark):
    arrs = [np.arange(6, dtype=np.float32).reshape(2, 3) * i for i in range(3)]
    blobs = []
    for a in arrs:
        b = io.BytesIO()
        np.save(b, a)
        blobs.append((bytearray(b.getvalue()),))
    df = spark.createDataFrame(blobs, "m binary")
    t = S.npy_to_tensor(df, "m", "float")
    rows = t.collect()
    assert rows[1]["m"]["shape"] == [2, 3] and rows[1]["m"]["values"][5] == 5.0
    back = S.tensor_to_npy(t, "m", "float32").collect()
    assert np.array_equal(np.load(io.BytesIO(back[2]["m"])), arrs[2])


def test_inferred_fields():
    st = T.StructType([
        T.StructField("a", T.IntegerType()), T.StructField("b", T.ArrayType(T.StringType())),
        T.StructField("c", T.StructType([T.StructField("x", T.IntegerType())])),
        T.StructField("d", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ])
    assert [f.name for f in S.infer_fields(st)] == ["a", "b", "c", "d"]
    assert [f.name for f in S.infer_fields(st, strict_compat=True)] == ["a", "b"]
    with pytest.raises(ValueError):
        S.infer_fields(st, omit_unsupported=False, strict_compat=True)


def test_copy_dataset(spark, tmp_dir):
    src = tmp_dir + "/src"
    spark.createDataFrame([(i, None if i % 3 == 0 else i, f"s{i}") for i in range(30)],
                          "id long, maybe long, s string").write.parquet(src)
    dst = tmp_dir + "/dst"
    W.copy_dataset(spark, src, dst, field_regex=["id", "may.*"], not_null_fields=["maybe"], partitions_count=2)
    out = spark.read.parquet(dst)
    assert sorted(out.columns) == ["id", "maybe"] and out.count() == 20
    with pytest.raises(Exception):
        W.copy_dataset(spark, src, dst, field_regex=["id"])  # exists, no overwrite
    W.copy_dataset(spark, src, dst, field_regex=["id"], overwrite_output=True)
    assert spark.read.parquet(dst).columns == ["id"]
    with pytest.raises(ValueError):
        W.copy_dataset(spark, src, tmp_dir + "/x", field_regex=["nomatch"])
    with pytest.raises(ValueError):
        W.copy_dataset(spark, src, tmp_dir + "/y", field_regex=["id"], not_null_fields=["maybe"])


def test_converter_cache_and_precision(spark, tmp_dir):
    spark.conf.set(W.CACHE_DIR_CONF, "file://" + tmp_dir + "/cache")
    df = spark.range(20).select(F.col("id"), (F.col("id") * 0.5).alias("d"), F.array(F.col("id").cast("double")).alias("a"))
    c1 = W.make_converter(df)
    c2 = W.make_converter(spark.range(20).select(F.col("id"), (F.col("id") * 0.5).alias("d"),
                                                 F.array(F.col("id").cast("double")).alias("a")))
    assert c1.cache_dir_url == c2.cache_dir_url and len(c1) == 20 and c1.file_urls
    c3 = W.make_converter(df, dtype="float64")
    assert c3.cache_dir_url != c1.cache_dir_url
    schema = c1.read(spark).schema
    assert schema["d"].dataType == T.FloatType() and schema["a"].dataType.elementType == T.FloatType()
    assert schema["id"].dataType == T.LongType()
    c1.delete(spark)
    assert not W.path_exists(spark, c1.cache_dir_url)
    with pytest.raises(RuntimeError):
        W.make_converter(df, compression_codec="weird")


def test_precision_and_tensor_ready(spark):
    import datetime as dt
    import decimal

    df = spark.createDataFrame(
        [(1, 2.5, [1.0], dt.datetime(2005, 2, 25, 3, 30), dt.date(2019, 1, 2), decimal.Decimal("1.500"), True)],
        "i int, d double, a array<double>, ts timestamp_ntz, dd date, dec decimal(10,3), b boolean",
    )
    c = convert_precision(df, "float32").schema
    assert c["d"].dataType == T.FloatType() and c["i"].dataType == T.IntegerType()
    with pytest.raises(ValueError):
        convert_precision(df, "float16")
    r = tensor_ready(df.drop("b"), "tf").first()
    assert r["ts"] == 1109302200 * 10**9 and r["dd"] == 17898 * 86400 * 10**9 and r["dec"] == "1.5"
    assert tensor_ready(df.select("b"), "torch").first()["b"] == 1
    with pytest.raises(TypeError):
        tensor_ready(spark.createDataFrame([("x",)], "s string"), "torch")
    with pytest.raises(Exception, match="null"):
        tensor_ready(spark.createDataFrame([(None,)], "x int"), "tf").collect()


def test_projection_rules(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, id2 int, other int, id_x int")
    assert select_fields(df, ["other", "id.*"]).columns == ["other", "id", "id2", "id_x"]
    assert select_fields(df, ["id"]).columns == ["id"]
    with pytest.raises(ValueError):
        select_fields(df, ["nothing_matches.*"])
    with pytest.raises(ValueError):
        select_fields(df, [3])
    schema = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("extra", T.StringType(), True)])
    filled = insert_explicit_nulls(df.select("id"), schema)
    assert filled.first()["extra"] is None
    with pytest.raises(ValueError):
        insert_explicit_nulls(df.select("other"), schema)
    with pytest.raises(Exception):
        conform(spark.createDataFrame([(None,)], "id int"), T.StructType([T.StructField("id", T.IntegerType(), False)])).collect()


def test_file_size_health(spark, tmp_dir):
    from grainset.sources.catalog import file_size_health

    spark.range(100).repartition(3).write.parquet(tmp_dir + "/small")
    h = file_size_health(spark, tmp_dir + "/small").first()
    assert h["n_files"] == 3 and h["too_small"]


def test_stored_indexes_survive_restamp(spark, tmp_dir):
    from grainset.operators import rowgroups as RG

    path = tmp_dir + "/idx"
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 13).alias("m"))
    W.materialize_dataset(df.coalesce(1), path, row_group_size_mb=None)
    with pytest.raises(ValueError):
        W.load_dataset_indexes(spark, path)
    W.build_dataset_indexes(spark, path, [RG.SingleFieldIndexer("m_index", "m")])
    W.stamp_metadata(spark, path)  # re-stamping keeps the stored index
    idx = W.load_dataset_indexes(spark, path)
    assert idx.filter("index_name = 'm_index'").count() == 13
    # The side folder is invisible to dataset reads.
    assert spark.read.parquet(path).count() == 2000


def test_converter_batches_and_metadata_report(spark, tmp_dir):
    from grainset.operators import rowgroups as RG

    spark.conf.set(W.CACHE_DIR_CONF, "file://" + tmp_dir + "/cache2")
    df = spark.range(70).select(F.col("id"), (F.col("id") * 1.0).alias("x"))
    conv = W.make_converter(df.coalesce(1))
    b = conv.batches(spark).orderBy("batch_id").collect()
    assert [r["batch_rows"] for r in b] == [32, 32, 6]
    assert sorted(x for r in b for x in r["id"]) == list(range(70))
    sb = conv.batches(spark, batch_size=10, shuffle=True, seed=1).collect()
    assert sorted(x for r in sb for x in r["id"]) == list(range(70))
    path = tmp_dir + "/meta"
    W.materialize_dataset(df, path)
    W.build_dataset_indexes(spark, path, [RG.SingleFieldIndexer("id_index", "id"),
                                          RG.SingleFieldIndexer("x_index", "x")])
    text, rep = W.metadata_report(spark, path, skip_indexes=["x_index"])
    assert "id" in text and rep.select("index_name").distinct().collect()[0][0] == "id_index"
    assert rep.count() == 70


def test_vectors_codec_and_expression_index(spark):
    from pyspark.ml.linalg import Vectors

    from grainset.operators import rowgroups as RG
    from grainset.operators.projection import ColumnCodec, vectors_to_arrays

    df = spark.createDataFrame([(0, Vectors.dense([1.0, 2.0]), Vectors.sparse(3, [1], [5.0]))], ["id", "v", "s"])
    arr = vectors_to_arrays(df, "float32")
    assert arr.schema["v"].dataType == T.ArrayType(T.FloatType(), False)
    r = arr.first()
    assert r["v"] == [1.0, 2.0] and r["s"] == [0.0, 5.0, 0.0]
    codec = ColumnCodec(lambda c: F.to_json(c), lambda c: F.from_json(c, "array<int>"), T.StringType())
    enc = codec.encode_df(spark.createDataFrame([([1, 2],)], "a array<int>"), "a")
    assert enc.schema["a"].dataType == T.StringType() and codec.decode_df(enc, "a").first()["a"] == [1, 2]
    rows = spark.createDataFrame([(0, "a b"), (1, "b"), (1, "c")], "piece_id long, text string")
    idx = RG.build_indexes(rows, [RG.ExpressionIndexer("words", F.split("text", " "))])
    got = {r["value"]: r["piece_ids"] for r in RG.index_arrays(idx).collect()}
    assert got == {"a": [0], "b": [0, 1], "c": [1]}


def test_columns_are_stored_and_read_by_codec_name(spark, tmp_dir):
    from grainset.operators.projection import CODECS, ColumnCodec, register_codec

    hexed = ColumnCodec(lambda c: F.hex(F.encode(c, "UTF-8")), lambda c: F.decode(F.unhex(c), "UTF-8"), T.StringType())
    register_codec("hex", hexed)
    try:
        schema = S.make_schema([S.Field("id", "int64"), S.Field("t", "str", codec="hex", nullable=True)])
        path = tmp_dir + "/codec"
        W.materialize_dataset(spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string"), path, schema)
        assert {r["t"] for r in spark.read.parquet(path).collect()} == {"6162", None}
        assert {(r["id"], r["t"]) for r in W.read_declared(spark, path).collect()} == {(1, "ab"), (2, None)}
    finally:
        CODECS.pop("hex")


def test_report_lists_piece_ids(spark, tmp_dir):
    from grainset.operators import rowgroups as RG

    path = tmp_dir + "/listed"
    spark.range(0, 40, numPartitions=2).write.parquet(path)
    W.stamp_metadata(spark, path)
    W.build_dataset_indexes(spark, path, [RG.FieldNotNullIndexer("all", "id")])
    assert W.metadata_report(spark, path, list_pieces=True)[1].first()["piece_ids"] == [0, 1]


def test_cli_copy_stamp_index_report(spark, tmp_dir, capsys):
    from grainset import cli

    src = tmp_dir + "/cli_src"
    spark.range(50).select(F.col("id"), (F.col("id") % 5).alias("m")).write.parquet(src)
    dst = tmp_dir + "/cli_dst"
    assert cli.main(["copy", src, dst, "--field-regex", "id", "m", "--partition-count", "2"]) == 0
    assert cli.main(["index", dst, "--field", "m"]) == 0
    assert cli.main(["report", dst, "--print-values"]) == 0
    out = capsys.readouterr().out
    assert "index m_index: 5 values" in out


@pytest.mark.parametrize("field, sql", [
    (S.Field("x", "uint8"), "300"),
    (S.Field("x", "uint8"), "-1"),
    (S.Field("x", "int8"), "300"),
    (S.Field("x", "int32"), "'seven'"),
    (S.Field("x", "uint16", (None,)), "array(1, 70000)"),
    (S.Field("x", "float32", (2,)), "array(1.0, 2.0, 3.0)"),
    (S.Field("x", "float32", (2, 2)), "struct(array(9) AS shape, array(1.0F) AS values)"),
])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_values_outside_the_declaration_are_refused(spark, field, sql, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="Field x"):
            conform(spark.sql(f"SELECT {sql} AS x"), S.make_schema([field])).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_restamping_keeps_the_declared_schema(spark, tmp_dir):
    path = tmp_dir + "/declared"
    fields = [S.Field("id", "int64"), S.Field("x", "uint16")]
    W.materialize_dataset(spark.sql("SELECT 1L AS id, 65535 AS x"), path, S.make_schema(fields))
    W.stamp_metadata(spark, path)
    assert S.fields_of(W.load_declared_schema(spark, path)) == fields
