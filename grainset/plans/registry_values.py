"""More registered queries: values, types, records, sequences on other time types, stored
and partitioned datasets. Same rules as ``registry``: whole driver tables, DuckDB SQL beside."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..operators import predicates as P
from ..operators import reports as R
from ..operators import rowgroups as RG
from ..operators import sequences as SQ
from ..operators.projection import ColumnCodec, conform, convert_precision, register_codec, tensor_ready, vectors_to_arrays
from ..operators.transform import TransformSpec, apply_transform, edit_field
from ..session import shared_table_path, table
from ..sources import metrics as M
from ..sources import schema as SC
from ..sources import writer as W
from .reader import DatasetSpec, read_dataset
from .registry import _BUCKET_SQL, _NG_SPEC, _PIECE_SQL, ND, ORACLE, _split_sql, events_metric_frame, events_pieces, register

# ---------------------------------------------------------------- types and values


@register(
    "tensor_ready_decimals",
    """SELECT l_orderkey, l_linenumber,
              rtrim(rtrim(CAST(CAST(l_extendedprice AS DECIMAL(14,4)) AS VARCHAR), '0'), '.') AS price,
              epoch_ns(CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP)) AS shipped
       FROM lineitem""",
)
def q_tensor_ready_decimals(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(14,4)").alias("price"),
        F.to_date("l_shipdate").alias("shipped"))
    return tensor_ready(li, "tf")


@register(
    "tensor_ready_booleans",
    """SELECT o_orderkey, CAST(o_totalprice > 150000 AS SMALLINT) AS big, o_totalprice FROM orders""",
)
def q_tensor_ready_booleans(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("big"), "o_totalprice")
    return tensor_ready(o, "torch")


@register(
    "precision_arrays",
    "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
)
def q_precision_arrays(spark, sf):
    return convert_precision(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "float64")


@register("vectors_to_arrays", "SELECT vec_id, embedding FROM embeddings")
def q_vectors_to_arrays(spark, sf):
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings")
    return vectors_to_arrays(e.select("vec_id", array_to_vector("embedding").alias("embedding")), "float32")


@register("npy_roundtrip", "SELECT vec_id, [8, 8] AS shape, embedding AS cells FROM embeddings")
def q_npy_roundtrip(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", SC.tensor(F.array(F.lit(8), F.lit(8)), F.col("embedding")).alias("m"))
    back = SC.npy_to_tensor(SC.tensor_to_npy(e, "m", "float32"), "m", "float")
    checked = back.select("vec_id", SC.check_tensor("m", (8, 8)).alias("m"))
    return checked.select("vec_id", F.col("m.shape").alias("shape"), F.col("m.values").alias("cells"))


@register(
    "conform_lineitem",
    """SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber, CAST(l_quantity AS SMALLINT) AS l_quantity,
              CAST(l_discount AS FLOAT) AS l_discount, l_returnflag, CAST(NULL AS VARCHAR) AS note FROM lineitem""",
)
def q_conform_lineitem(spark, sf):
    schema = SC.make_schema([
        SC.Field("l_orderkey", "int64"), SC.Field("l_linenumber", "uint8"), SC.Field("l_quantity", "uint8"),
        SC.Field("l_discount", "float32"), SC.Field("l_returnflag", "str"), SC.Field("note", "str", nullable=True)])
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber"), F.col("l_quantity").cast("int").alias("l_quantity"), F.col("l_discount").cast("float").alias("l_discount"),
        "l_returnflag")
    return conform(li, schema)


def _text_of(row):
    return {"event_id": row["event_id"], "text": str(row["big"])}


@register(
    "transform_row_exact",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'None'
                             ELSE CAST(9007199254740993 + event_id AS VARCHAR) END AS text FROM events""",
)
def q_transform_row_exact(spark, sf):
    big = F.when(F.col("event_id") % 3 != 0, F.col("event_id") + F.lit(9007199254740993))
    e = table(spark, sf, "events").select("event_id", big.alias("big"))
    spec = TransformSpec(_text_of, edit_fields=[edit_field("text", "str", (), True)], removed_fields=["big"], mode="row")
    return apply_transform(e, spec)


# ---------------------------------------------------------------- predicates


@register(
    "split_null_keys",
    "WITH e AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN coalesce(CAST(user_id AS VARCHAR), 'None') ELSE 'None' END AS k FROM events)\n"
    "SELECT event_id, CASE "
    + " ".join(f"WHEN {_split_sql('k', [0.5, 0.3, 0.2], i)} THEN {i}" for i in range(3))
    + " END AS part FROM e",
)
def q_split_null_keys(spark, sf):
    # Null keys belong to a subset too: the subsets hold the whole table.
    key = F.when(F.col("event_id") % 5 != 0, F.col("user_id"))
    e = table(spark, sf, "events").select("event_id", key.alias("k"))
    parts = [P.in_pseudorandom_split([0.5, 0.3, 0.2], i, "k").apply(e).select("event_id", F.lit(i).alias("part")) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register(
    "not_null_rows",
    """SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE l.quality IS NOT NULL AND d.source IS NOT NULL""",
)
def q_not_null_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    d = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return P.not_null(["quality", "source"]).apply(d)


def _margin(price, discount):
    return price * (1.0 - discount) > 40000.0


@register(
    "pred_vectorized",
    """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1.0 - l_discount) > 40000.0""",
)
def q_pred_vectorized(spark, sf):
    li = table(spark, sf, "lineitem")
    p = P.in_lambda(["l_extendedprice", "l_discount"], _margin, vectorized=True)
    return p.apply(li).select("l_orderkey", "l_linenumber")


def _odd(flags):
    return sum(flags) % 2 == 1


@register(
    "pred_reduce_custom",
    """SELECT l_orderkey, l_linenumber FROM lineitem
       WHERE (coalesce(l_returnflag = 'R', false)::INT + coalesce(l_linestatus = 'F', false)::INT
              + coalesce(l_quantity > 25, false)::INT) % 2 = 1""",
)
def q_pred_reduce_custom(spark, sf):
    ps = [P.in_set(["R"], "l_returnflag"), P.in_set(["F"], "l_linestatus"), P.in_lambda(["l_quantity"], lambda q: q > 25)]
    return P.in_reduce(ps, _odd, vectorized=True).apply(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- indexes on other types


@register(
    "index_report_types",
    """WITH d AS (SELECT doc_id // 50 AS piece_id, string_split(text, ' ') AS words, n_chars / 4.0 AS quarter, lang, source
                  FROM documents),
       e AS (SELECT 'words' AS index_name, unnest(words) AS value, piece_id FROM d
             UNION ALL SELECT 'quarter', CAST(CAST(quarter AS DOUBLE) AS VARCHAR), piece_id FROM d
             UNION ALL SELECT 'origin', concat(lang, ':', source), piece_id FROM d
             WHERE lang IS NOT NULL AND source IS NOT NULL)
       SELECT index_name, value, CAST(count(DISTINCT piece_id) AS INTEGER) AS n_pieces FROM e
       WHERE value IS NOT NULL GROUP BY 1, 2""",
)
def q_index_report_types(spark, sf):
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 50).cast("bigint").alias("piece_id"), F.split("text", " ", -1).alias("words"),
        (F.col("n_chars") / 4.0).cast("double").alias("quarter"), "lang", "source")
    index = RG.build_indexes(d, [
        RG.SingleFieldIndexer("words", "words"), RG.SingleFieldIndexer("quarter", "quarter"),
        RG.ExpressionIndexer("origin", F.concat(F.col("lang"), F.lit(":"), F.col("source")))])
    return RG.index_report(index)


# ---------------------------------------------------------------- records and reports


@register(
    "measures_last_wins",
    f"""SELECT {_PIECE_SQL} AS piece_id, event_type AS metric, arg_max(value, event_id) AS value
        FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2""",
)
def q_measures_last_wins(spark, sf):
    # The measures of a block (bounded) in event order; the last of a repeated name wins.
    e = events_pieces(spark, sf)
    per = e.groupBy("piece_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("metric"), "value"))).alias("measures"))
    return per.select("piece_id", F.explode(M.measures_to_map()).alias("metric", "value"))


_RECORD_SQL = """
    WITH e AS (SELECT event_id, event_type, ts, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT CAST(event_id AS VARCHAR) AS commit_hash, event_type AS author, date_trunc('second', ts) AS date,
           CASE WHEN k % 5 = 0 THEN 0 ELSE k END AS comment_lines, value AS comment_lines_density,
           CASE WHEN k % 3 = 0 THEN 0 ELSE event_id END AS total_changed_files_comments
    FROM e WHERE k % 7 <> 0 AND event_id % 11 <> 0"""


@register("clean_records", _RECORD_SQL)
def q_clean_records(spark, sf):
    # Records as the JSON source gives them: text metrics, some absent (0), some malformed
    # (the record goes), some without a metrics object (the record goes).
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    lines = F.when(k % 7 == 0, F.lit("n/a")).when(k % 5 != 0, k.cast("string"))
    metrics = F.struct(lines.alias("comment_lines"), F.col("value").cast("string").alias("comment_lines_density"))
    records = e.select(
        F.col("event_id").cast("string").alias("commit_hash"), F.col("event_type").alias("author"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("date"),
        F.when(F.col("event_id") % 11 != 0, metrics).alias("overall_comment_metrics"),
        F.when(k % 3 != 0, F.col("event_id").cast("string")).alias("total_changed_files_comments"),
        F.lit(True).alias("has_author"), F.lit(True).alias("has_metrics"), F.lit(True).alias("has_date"))
    return M.clean_metric_records(records).drop("date_text", "date_utc")


@register(
    "commit_lines",
    """SELECT CAST(event_id AS VARCHAR) AS commit_hash, event_type AS author, date_trunc('second', ts) AS date
       FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0""",
)
def q_commit_lines(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.concat(stamp, F.lit(" +0130")))
    line = F.when(F.col("event_id") % 13 == 0, F.concat(line, F.lit("|x"))).when(
        F.col("event_id") % 17 == 0, F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.lit("yesterday"))
    ).otherwise(F.concat(F.lit("  "), line))
    lines = table(spark, sf, "events").select(line.alias("value"))
    return M.parse_commit_lines(lines).select("commit_hash", "author", "date")


@register(
    "monthly_orders",
    f"""SELECT strftime(o_orderdate, '%Y-%m') AS year_month, round(avg(o_totalprice), {ND}) AS avg_o_totalprice
        FROM orders GROUP BY 1""",
)
def q_monthly_orders(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"), "o_totalprice")
    return R.period_means(o, ["o_totalprice"], "month", ndigits=ND)


@register(
    "daily_instants",
    f"SELECT CAST(ts AS DATE) AS day, round(avg(value), {ND}) AS avg_value FROM events GROUP BY 1",
)
def q_daily_instants(spark, sf):
    # Instants are reported by their UTC day whatever the session zone.
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    e = table(spark, sf, "events").select(F.timestamp_micros(micros).alias("t"), "value")
    return e.groupBy(dates.utc_day(F.col("t")).alias("day")).agg(F.round(F.avg("value"), ND).alias("avg_value"))


@register(
    "quarterly_by_customer",
    f"""WITH agg AS (SELECT o_custkey, date_trunc('quarter', o_orderdate)::DATE AS q,
                            round(avg(o_totalprice), {ND}) AS avg_o_totalprice FROM orders GROUP BY 1, 2),
        span AS (SELECT o_custkey, min(q) AS lo, max(q) AS hi FROM agg GROUP BY 1),
        cal AS (SELECT o_custkey, unnest(generate_series(lo, hi, INTERVAL 3 MONTH))::DATE AS q FROM span)
        SELECT cal.o_custkey, last_day(cal.q + INTERVAL 2 MONTH) AS quarter_end, agg.avg_o_totalprice
        FROM cal LEFT JOIN agg ON cal.q = agg.q AND cal.o_custkey = agg.o_custkey""",
)
def q_quarterly_by_customer(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"), "o_custkey", "o_totalprice")
    return R.quarterly_means(o, "o_totalprice", ndigits=ND, by=["o_custkey"])


@register(
    "daily_by_clerk_min2",
    """WITH s AS (SELECT concat_ws('/', CAST(o_custkey AS VARCHAR), o_orderpriority, o_orderstatus) AS author,
                         CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders),
       d AS (SELECT author, day, avg(v) AS v, count(*) AS n FROM s GROUP BY 1, 2),
       k AS (SELECT *, sum(n) OVER (PARTITION BY author) AS nr, count(*) OVER (PARTITION BY author) AS nd FROM d),
       n AS (SELECT author, day, v, CAST(row_number() OVER (PARTITION BY author ORDER BY day) - 1 AS INTEGER) AS x
             FROM k WHERE nr >= 2 AND nd >= 2),
       f AS (SELECT author, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept FROM n GROUP BY 1)
       SELECT n.author, day, x, round(v, 5) AS avg_value, round(intercept + slope * x, 5) AS trend,
              round(slope, 5) AS slope, round(intercept, 5) AS intercept
       FROM n JOIN f ON n.author = f.author""",
)
def q_daily_by_clerk_min2(spark, sf):
    # Many groups of one record or one day here: those are skipped.
    name = F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority", "o_orderstatus")
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("date"), name.alias("author"), "o_totalprice")
    return R.author_daily_trend(o, "o_totalprice", ndigits=5)


# ---------------------------------------------------------------- sequences


@register("ngram_unflatten", ORACLE["ngram_overlap"])
def q_ngram_unflatten(spark, sf):
    spec = SQ.NGram(_NG_SPEC, 21600, "ts")
    seq = SQ.ngram(table(spark, sf, "events"), spec, ["user_id"], ["ts", "event_id"])
    nested = SQ.unflatten_ngram(SQ.flatten_ngram(seq, spec), spec)
    return SQ.flatten_ngram(nested, spec)


def _no_overlap_sql(rows, scope, gap, limit, select):
    return f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (ORDER BY {scope}, t, id) - 1 AS g FROM ({rows})),
    w AS (SELECT a.{scope}, a.g, a.t AS t0, b.t AS t1, a.id AS e0, b.id AS e1
          FROM e a JOIN e b ON b.g = a.g + 1 AND b.{scope} = a.{scope} WHERE {gap} <= {limit}),
    chain({scope}, g, t1) AS (
        SELECT {scope}, min(g), arg_min(t1, g) FROM w GROUP BY {scope}
        UNION ALL
        SELECT c.{scope}, min(w2.g), arg_min(w2.t1, w2.g) FROM chain c JOIN w w2
          ON w2.{scope} = c.{scope} AND w2.t0 > c.t1 GROUP BY c.{scope})
    SELECT w.{scope}, w.g AS start_pos, {select} FROM chain c JOIN w ON w.g = c.g"""


@register(
    "ngram_no_overlap_nanos",
    _no_overlap_sql(f"SELECT event_id AS id, epoch_ns(ts) AS t, {_PIECE_SQL} AS piece_id FROM events", "piece_id",
                    "b.t - a.t", 600 * 10**9, "w.e0 AS event_id_0, w.t0 AS t_0, w.e1 AS event_id_1"),
)
def q_ngram_no_overlap_nanos(spark, sf):
    e = events_pieces(spark, sf).select("piece_id", "event_id", dates.epoch_nanos(F.col("ts"), "timestamp_ntz").alias("t"))
    spec = SQ.NGram({0: ["event_id", "t"], 1: ["event_id"]}, 600 * 10**9, "t", timestamp_overlap=False)
    return SQ.flatten_ngram(SQ.ngram_no_overlap(e, spec, ["piece_id"], ["t", "event_id"]), spec)


@register(
    "ngram_no_overlap_dates",
    _no_overlap_sql("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS t, o_custkey FROM orders", "o_custkey",
                    "b.t - a.t", 60, "w.e0 AS o_orderkey_0, w.t0 AS t_0, w.e1 AS o_orderkey_1"),
)
def q_ngram_no_overlap_dates(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("t"))
    spec = SQ.NGram({0: ["o_orderkey", "t"], 1: ["o_orderkey"]}, 60, "t", timestamp_overlap=False)
    return SQ.flatten_ngram(SQ.ngram_no_overlap(o, spec, ["o_custkey"], ["t", "o_orderkey"]), spec)


# ---------------------------------------------------------------- stored and partitioned datasets


def _uri(path: str) -> str:
    return path if urlparse(path).scheme else f"file://{path}"


def orders_by_priority(spark, sf) -> str:
    """URL of all orders as a dataset partitioned by priority, one file each."""
    path = shared_table_path(spark, "orders")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    o.repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    return _uri(path)


@register(
    "partition_predicate",
    """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def q_partition_predicate(spark, sf):
    spec = DatasetSpec(orders_by_priority(spark, sf), fields=["o_orderkey", "o_totalprice", "o_orderpriority"],
                       predicate=P.in_set(["1-URGENT", "5-LOW"], "o_orderpriority"))
    return read_dataset(spark, spec).select("o_orderkey", "o_totalprice", "o_orderpriority")


@register(
    "shard_after_filters",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def q_shard_after_filters(spark, sf):
    # Three pieces are left by the filters; shard 0 of 2 gets the first and the third.
    keep = [("o_orderpriority", "in", ["1-URGENT", "3-MEDIUM", "5-LOW"])]
    spec = DatasetSpec(orders_by_priority(spark, sf), fields=["o_orderkey", "o_totalprice"], filters=[keep],
                       cur_shard=0, shard_count=2)
    return read_dataset(spark, spec).select("o_orderkey", "o_totalprice")


@register(
    "read_two_urls",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('2-HIGH', '3-MEDIUM')""",
)
def q_read_two_urls(spark, sf):
    url = orders_by_priority(spark, sf)
    urls = [f"{url}/o_orderpriority=2-HIGH", f"{url}/o_orderpriority=3-MEDIUM/"]
    return read_dataset(spark, DatasetSpec(urls, fields=["o_orderkey", "o_orderstatus"])).select("o_orderkey", "o_orderstatus")


@register(
    "materialized_rows",
    """SELECT c_custkey, c_name, CAST(c_acctbal AS FLOAT) AS c_acctbal, (SELECT count(*) FROM customer) AS dataset_size
       FROM customer""",
)
def q_materialized_rows(spark, sf):
    # Written for training once, reused by the second call, read back.
    url = shared_table_path(spark, "cache")
    before = spark.conf.get(W.CACHE_DIR_CONF, None)
    spark.conf.set(W.CACHE_DIR_CONF, _uri(url))
    try:
        c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
        first, again = W.make_converter(c), W.make_converter(c)
    finally:
        spark.conf.unset(W.CACHE_DIR_CONF) if before is None else spark.conf.set(W.CACHE_DIR_CONF, before)
    if again.cache_dir_url != first.cache_dir_url:
        raise RuntimeError("the second call wrote the same data again")
    return again.read(spark).withColumn("dataset_size", F.lit(len(again)).cast("bigint"))


@register(
    "managed_write",
    """SELECT s_suppkey, s_name, CAST(s_nationkey AS SMALLINT) AS s_nationkey, 'uint8' AS declared FROM supplier""",
)
def q_managed_write(spark, sf):
    # Written with a declared schema, stamped, copied by name pattern, read by declaration.
    schema = SC.make_schema([SC.Field("s_suppkey", "int64"), SC.Field("s_name", "str"), SC.Field("s_nationkey", "uint8"),
                             SC.Field("s_acctbal", "float64")])
    first, copy = shared_table_path(spark, "supplier"), shared_table_path(spark, "copy")
    W.materialize_dataset(table(spark, sf, "supplier"), first, schema)
    W.copy_dataset(spark, first, copy, ["s_suppkey", "s_n.*"])
    declared = {f.name: f.dtype for f in SC.fields_of(W.load_declared_schema(spark, copy))}
    rows = read_dataset(spark, DatasetSpec(_uri(copy), fields=["s_suppkey", "s_name", "s_nationkey"]))
    return rows.select("s_suppkey", "s_name", "s_nationkey", F.lit(declared["s_nationkey"]).alias("declared"))


@register(
    "named_codec",
    """SELECT event_id, event_type, hex(event_type) AS stored FROM events""",
)
def q_named_codec(spark, sf):
    # A field declares its codec by name: stored in that form, decoded by the declared read.
    register_codec("hex", ColumnCodec(lambda c: F.hex(F.encode(c, "UTF-8")), lambda c: F.decode(F.unhex(c), "UTF-8"), T.StringType()))
    schema = SC.make_schema([SC.Field("event_id", "int64"), SC.Field("event_type", "str", codec="hex", nullable=True)])
    path = shared_table_path(spark, "codec")
    W.materialize_dataset(table(spark, sf, "events").select("event_id", "event_type"), path, schema)
    stored = spark.read.parquet(path).select("event_id", F.col("event_type").alias("stored"))
    return W.read_declared(spark, path).join(stored, "event_id")
