"""Metric-record sources and sinks (JSON documents, work lists, commit-log lines)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..operators.reports import utc_from_offset_text
from ..session import broadcast_if_small

# Metric values arrive as JSON strings ("3853") or numbers; read both as text.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("commit_hash", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField(
            "overall_comment_metrics",
            T.StructType(
                [
                    T.StructField("comment_lines", T.StringType()),
                    T.StructField("comment_lines_density", T.StringType()),
                ]
            ),
        ),
        T.StructField("total_changed_files_comments", T.StringType()),
        T.StructField("changed_files_metrics", T.MapType(T.StringType(), T.LongType())),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_metric_records(spark: SparkSession, json_dir: str) -> DataFrame:
    """One pretty-printed JSON object per ``*.json`` file; unreadable files skipped.

    Each file is read whole (one row per file) and parsed with ``from_json``; the key
    list tells an absent key from a key holding null, which the cleaning step needs.
    """
    text = spark.read.text(json_dir, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    return parse_metric_records(text.select(F.col("_metadata.file_path").alias("source_file"), "value"))


def parse_metric_records(text: DataFrame) -> DataFrame:
    """``value`` (one JSON document a row) as records; the other columns stay."""
    keys = F.json_object_keys(F.col("value"))
    schema = T.StructType([f for f in RECORD_SCHEMA.fields if f.name != "_corrupt_record"])
    rec = F.from_json(F.col("value"), schema)
    out = text.select(
        *[c for c in text.columns if c != "value"],
        rec.alias("__r"),
        F.array_contains(keys, "author").alias("has_author"),
        F.array_contains(keys, "overall_comment_metrics").alias("has_metrics"),
        F.array_contains(keys, "date").alias("has_date"),
        keys.isNotNull().alias("__valid"),
    ).filter("__valid")
    return out.select(*[c for c in text.columns if c != "value"], "__r.*", "has_author", "has_metrics", "has_date")


def _bound(df: DataFrame, *columns) -> DataFrame:
    """A select whose expressions are evaluated once for each row: a generator stands between
    them and what is made of them, where a plain projection would be merged and repeat them."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _int_text(c):
    """Python ``int(text)``: optional whitespace and sign, digits only."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def _float_text(c):
    t = F.trim(c)
    return F.when(t.rlike(r"(?i)^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|nan|infinity)$"),
                  t.try_cast("double"))


def clean_metric_records(records: DataFrame) -> DataFrame:
    """Flatten and clean: absent metric -> 0, absent total -> 0; a malformed metric,
    date, or an absent author / metrics object drops the whole record."""
    kept = ["commit_hash", "author", "date", "overall_comment_metrics", "total_changed_files_comments"]
    records = _bound(records, *kept, "has_author", "has_metrics", "has_date")
    m = F.col("overall_comment_metrics")
    lines_txt = m.getField("comment_lines")
    dens_txt = m.getField("comment_lines_density")
    lines = F.when(lines_txt.isNull(), F.lit(0).cast("bigint")).otherwise(_int_text(lines_txt))
    dens = F.when(dens_txt.isNull(), F.lit(0.0)).otherwise(_float_text(dens_txt))
    total_txt = F.col("total_changed_files_comments")
    total = F.when(total_txt.isNull(), F.lit(0).cast("bigint")).otherwise(_int_text(total_txt))
    out = _bound(
        records,
        "commit_hash",
        "author",
        F.col("date").alias("date_text"),
        dates.wall_clock(F.col("date")).alias("date"),
        utc_from_offset_text(F.col("date")).alias("date_utc"),
        lines.alias("comment_lines"),
        dens.alias("comment_lines_density"),
        total.alias("total_changed_files_comments"),
        "has_author",
        "has_metrics",
        "has_date",
        m.isNotNull().alias("__metrics_obj"),
        # A malformed value (not absent, not parseable) drops the row.
        ((lines_txt.isNull() | lines.isNotNull()) & (dens_txt.isNull() | dens.isNotNull())
         & (total_txt.isNull() | total.isNotNull())).alias("__ok_values"),
    )
    keep = (
        F.col("has_author") & F.col("has_metrics") & F.col("has_date") & F.col("date").isNotNull()
        & F.col("__ok_values") & F.col("__metrics_obj")
    )
    return out.filter(keep).drop("has_author", "has_metrics", "has_date", "__ok_values", "__metrics_obj")


def read_work_list(spark: SparkSession, path: str) -> DataFrame:
    """One key per line, stripped. A missing file gives an empty list."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], "key string")
    return spark.read.text(path).select(F.trim(F.col("value")).alias("key"))


def parse_commit_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """'hash|author|YYYY-MM-DD HH:MM:SS +ZZZZ' lines; rows without exactly 3 parts or a
    bad date are dropped. Keeps the local wall-clock and the UTC instant."""
    split = _bound(lines, F.split(F.trim(F.col(col)), r"\|").alias("parts"))
    parts = F.col("parts")
    read = _bound(split, parts, F.get(parts, F.lit(2)).alias("text"))
    text = F.col("text")
    iso = F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8),
        F.substring(text, 21, 3), F.lit(":"), F.substring(text, 24, 2),
    )
    ok = (F.size(parts) == 3) & text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} [+-]\d{4}$")
    dated = _bound(
        read.where(ok),
        F.get(parts, F.lit(0)).alias("commit_hash"), F.get(parts, F.lit(1)).alias("author"), iso.alias("date_text"))
    out = _bound(
        dated, "commit_hash", "author", dates.wall_clock(F.col("date_text")).alias("date"),
        utc_from_offset_text(F.col("date_text")).alias("date_utc"), "date_text")
    return out.filter(F.col("date").isNotNull())


def measures_to_map(measures_col: str = "measures", key: str = "metric", value: str = "value"):
    """Array of {metric, value} structs to a map; a repeated key keeps the last value, whatever
    the session's key policy. Entries without a key are left out."""
    named = F.filter(F.col(measures_col), lambda m: m[key].isNotNull())
    # Places by key, then the first and last place of each key, in the order of first places.
    places = F.array_sort(F.transform(named, lambda m, i: F.struct(m[key].alias("k"), i.alias("i"))))

    def ends(entries, places):
        other = lambda i, step: F.get(places, i + F.lit(step))["k"]
        firsts = F.filter(places, lambda p, i: ~other(i, -1).eqNullSafe(p["k"]))
        lasts = F.filter(places, lambda p, i: ~other(i, 1).eqNullSafe(p["k"]))
        spans = F.array_sort(F.zip_with(firsts, lasts, lambda a, b: F.struct(a["i"].alias("first"), b["i"].alias("last"))))
        return F.map_from_arrays(
            F.transform(spans, lambda s: F.get(entries, s["first"])[key]),
            F.transform(spans, lambda s: F.get(entries, s["last"])[value]),
        )

    held = F.array(F.struct(named.alias("e"), places.alias("p")))
    return F.get(F.transform(held, lambda h: ends(h["e"], h["p"])), F.lit(0))


def write_metric_records(df: DataFrame, path: str, key_col: str = "commit_hash", mode: str = "overwrite"):
    """One folder of JSON documents per key: for a handful of keys. Many keys go to
    ``write_record_store``, which has a bounded number of folders."""
    df.write.mode(mode).partitionBy(key_col).json(path)


def write_record_store(df: DataFrame, path: str, key_col: str = "commit_hash", run: str | None = None,
                       buckets: int = 64) -> None:
    """Adds one JSON document per key to the store at ``path``, skipping keys that it has.

    Documents go, one a line, to ``records/run=<run>/bucket=<hash of the key>``; after them the
    run's keys go to the manifest ``keys/run=<run>``. Readers see runs of the manifest only, so
    a run that stopped half-way leaves nothing behind and is simply run again under any name.
    Rows with a null key are left out; of rows that repeat a key the smallest document is kept.
    One writer at a time; a run name that is in the manifest is an error.
    """
    from .writer import path_exists

    spark, run, path = df.sparkSession, run or uuid.uuid4().hex, path.rstrip("/")
    if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
        raise ValueError(f"run name {run!r}: letters, digits, - and _ only")
    if path_exists(spark, f"{path}/keys/run={run}/_SUCCESS"):
        raise ValueError(f"run {run!r} is in the store at {path} already")
    key = F.col(key_col).cast("string")
    rows = df.where(key.isNotNull()).select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
    rows = pending_keys(rows, store_keys(spark, path))
    docs = rows.groupBy("key").agg(F.min("value").alias("value"))
    docs = docs.withColumn("bucket", F.pmod(F.crc32(F.col("key")), F.lit(buckets)).cast("int"))
    written = docs.select(F.to_json(F.struct("key", "value")).alias("value"), "bucket")
    records = f"{path}/records/run={run}"
    written.repartition("bucket").write.mode("overwrite").partitionBy("bucket").text(records)
    keys = spark.read.text(records).select(F.get_json_object("value", "$.key").alias("key"))
    keys.write.mode("overwrite").parquet(f"{path}/keys/run={run}")


def store_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key, run) of every document in the store's manifest; none without a store."""
    from .writer import path_exists

    keys = f"{path.rstrip('/')}/keys"
    if not path_exists(spark, keys):
        return spark.createDataFrame([], "key string, run string")
    return spark.read.schema("key string, run string").parquet(keys)


def read_record_store(spark: SparkSession, path: str) -> DataFrame:
    """(key, run, value) of every document that the manifest names; ``value`` is its JSON."""
    records = f"{path.rstrip('/')}/records"
    runs = store_keys(spark, path).select("run").distinct()
    text = spark.read.schema("value string, run string, bucket int").text(records).drop("bucket")
    text = text.join(broadcast_if_small(runs, measure=True), "run", "left_semi")
    doc = F.from_json("value", "key string, value string")
    return text.select(doc.alias("d"), "run").select("d.key", "run", "d.value")


def pending_keys(work: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    """Keys whose result does not exist yet (anti join)."""
    return work.join(done.select(key), key, "left_anti")
