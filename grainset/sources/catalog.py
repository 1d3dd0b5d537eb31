"""Row-group catalog: one row per Parquet row group, numbered as ``piece_id``.

Files are listed by Spark (``binaryFile`` with only path/length selected, so no
file content is read) and footers are read in parallel inside ``mapInPandas``
(one small task per batch of files). The catalog is metadata-sized: one row per
row group, never per data row.

Rows are attached to their row group with an equi-join on the file path against
a per-file table (one row per file with the sorted first-row offsets), so a file
with many row groups never multiplies rows in the join.
"""

from __future__ import annotations

import math
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, default_parallelism

CATALOG_SCHEMA = (
    "file_path string, rel_path string, row_group int, first_row bigint, num_rows bigint, "
    "total_byte_size bigint"
)


def _open_for_footer(uri: str):
    """Open a file URI with pyarrow's filesystem layer (local, HDFS, object stores)."""
    import pyarrow.fs as pafs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(unquote(parsed.path))
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _footer_rows(batches):
    import pyarrow.parquet as pq

    for pdf in batches:
        out = []
        for file_path, root in zip(pdf["file_path"], pdf["root"]):
            with _open_for_footer(file_path) as fh:
                md = pq.ParquetFile(fh).metadata
            fp, rp = unquote(urlparse(file_path).path), unquote(urlparse(root).path).rstrip("/") + "/"
            rel = fp[len(rp):] if fp.startswith(rp) else fp.lstrip("/")
            first = 0
            for g in range(md.num_row_groups):
                rg = md.row_group(g)
                out.append((file_path, rel, g, first, rg.num_rows, rg.total_byte_size))
                first += rg.num_rows
        yield pd.DataFrame(
            out, columns=["file_path", "rel_path", "row_group", "first_row", "num_rows", "total_byte_size"]
        )


def list_parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, length) of every file that a Parquet scan of ``path`` reads, whatever its
    name (hidden files and summary files are not; content is never read)."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listing = listing.where(~F.col("_metadata.file_name").rlike("^_(common_)?metadata"))
    return listing.select(F.col("_metadata.file_path").alias("file_path"), F.col("length"))


def _root_uri(spark: SparkSession, path: str) -> str:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    q = fs.makeQualified(jpath)
    if fs.getFileStatus(q).isFile():
        q = q.getParent()
    return q.toUri().toString().rstrip("/") + "/"


def row_group_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog ordered by (relative path, row group) with a dense 0-based ``piece_id``."""
    root = _root_uri(spark, path)
    files = list_parquet_files(spark, path).select("file_path", F.lit(root).alias("root"))
    files = files.repartition(default_parallelism(spark), "file_path")
    groups = files.mapInPandas(_footer_rows, CATALOG_SCHEMA)
    # Metadata-sized table (one row per row group): a global window is acceptable here.
    w = Window.orderBy("rel_path", "row_group")
    return groups.withColumn("piece_id", (F.row_number().over(w) - 1).cast("bigint"))


def compare_files(spark: SparkSession, path: str, stored: DataFrame) -> DataFrame:
    """One row per file of the dataset or of its stored catalog: ``rel_path`` (below the
    dataset), today's ``file_path`` (null: gone) and ``in_catalog`` (null: new)."""
    root = unquote(urlparse(_root_uri(spark, path)).path).rstrip("/") + "/"

    def relative(batches):
        for pdf in batches:
            full = [unquote(urlparse(u).path) for u in pdf["file_path"]]
            rel = [f[len(root):] if f.startswith(root) else f.lstrip("/") for f in full]
            yield pd.DataFrame({"file_path": pdf["file_path"], "rel_path": rel})

    now = list_parquet_files(spark, path).select("file_path").mapInPandas(relative, "file_path string, rel_path string")
    return stored.select("rel_path", F.lit(True).alias("in_catalog")).distinct().join(now, "rel_path", "full")


def _count_changes(files: DataFrame) -> tuple[int, int]:
    return tuple(files.agg(F.count(F.when(F.col("file_path").isNull(), 1)), F.count(F.when(F.col("in_catalog").isNull(), 1))).first())


def rebased_catalog(spark: SparkSession, path: str, stored: DataFrame) -> DataFrame:
    """A stored catalog with today's file paths: files are matched by their path below the
    dataset, so a copied or moved dataset keeps its catalog. Fails if the dataset holds other
    files with row groups than the catalog (metadata-sized: one row per file); Spark writes
    files without any where a task has no rows."""
    files = compare_files(spark, path, stored)
    missing, extra = _count_changes(files)
    if extra:  # a file without rows has no row group to catalog
        extra = appended_row_groups(spark, path, stored, files).agg(F.count_distinct("file_path")).first()[0]
    if missing or extra:
        raise ValueError(
            f"stale catalog at {path}: {missing} catalogued files are gone, {extra} files are new; "
            "bring it up to date with update_catalog or stamp the dataset again")
    return stored.drop("file_path").join(files.select("rel_path", "file_path"), "rel_path").select(*stored.columns)


def appended_row_groups(spark: SparkSession, path: str, stored: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Catalog rows of the files that ``stored`` lacks. Only their footers are read; their
    pieces are numbered behind the stored ones, in the order (relative path, row group)."""
    files = compare_files(spark, path, stored) if files is None else files
    new = files.where("in_catalog IS NULL").select("file_path", F.lit(_root_uri(spark, path)).alias("root"))
    groups = new.repartition(default_parallelism(spark), "file_path").mapInPandas(_footer_rows, CATALOG_SCHEMA)
    first = stored.agg(F.coalesce(F.max("piece_id") + 1, F.lit(0))).first()[0]
    w = Window.orderBy("rel_path", "row_group")  # one row per new row group
    return groups.withColumn("piece_id", (F.row_number().over(w) - 1 + F.lit(first)).cast("bigint"))


def row_groups_per_file(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("file_path", "rel_path").agg(F.count(F.lit(1)).alias("num_row_groups"))


def _file_table(catalog: DataFrame) -> DataFrame:
    """One row per file: sorted first-row offsets and the file's first piece id."""
    return catalog.groupBy("file_path").agg(
        F.array_sort(F.collect_list("first_row")).alias("__starts"),
        F.min("piece_id").alias("__base"),
    )


def attach_pieces(df: DataFrame, catalog: DataFrame, name: str = "piece_id",
                  max_groups_per_file: int | None = None) -> DataFrame:
    """Add the row-group ``piece_id`` to rows scanned from the catalogued dataset.

    ``df`` must come straight from ``spark.read.parquet`` of the same dataset (it uses
    the ``_metadata`` file path and row index of each row). The row group of a row is
    found in its file's sorted first-row offsets: by a linear count for few groups per
    file, or, when ``max_groups_per_file`` is given and large, by a binary search of
    ceil(log2(G)) steps (map-side, no shuffle).
    """
    files = broadcast_if_small(_file_table(catalog), measure=True)
    tagged = df.withColumn("__afp", F.col("_metadata.file_path")).withColumn("__ari", F.col("_metadata.row_index"))
    # A scanned file that the catalog lacks must not lose its rows silently.
    joined = tagged.join(files, tagged["__afp"] == files["file_path"], "left")
    unknown = F.raise_error(F.concat(F.lit("no row groups catalogued for file "), F.col("__afp")))
    joined = joined.withColumn("__base", F.coalesce(F.col("__base"), unknown.cast("bigint")))
    if max_groups_per_file is None or max_groups_per_file <= 16:
        ordinal = F.size(F.filter(F.col("__starts"), lambda s: s <= F.col("__ari"))) - F.lit(1)
        out = joined.withColumn(name, F.col("__base") + ordinal.cast("bigint"))
    else:
        # Largest i with starts[i] <= row index; starts[0] = 0, so i exists.
        out = joined.withColumn("__lo", F.lit(0)).withColumn("__hi", F.size("__starts") - 1)
        for _ in range(int(math.ceil(math.log2(max_groups_per_file))) + 1):
            mid = ((F.col("__lo") + F.col("__hi") + 1) / 2).cast("int")
            fits = F.try_element_at(F.col("__starts"), mid + 1) <= F.col("__ari")
            out = out.withColumn("__mid", mid).withColumn("__fit", F.coalesce(fits, F.lit(False)))
            out = out.withColumn("__lo", F.when(F.col("__fit"), F.col("__mid")).otherwise(F.col("__lo"))).withColumn(
                "__hi", F.when(F.col("__fit"), F.col("__hi")).otherwise(F.col("__mid") - 1))
        out = out.withColumn(name, F.col("__base") + F.col("__lo").cast("bigint")).drop(
            "__lo", "__hi", "__mid", "__fit")
    return out.drop("__afp", "__ari", "__starts", "__base", "file_path")


def max_groups_per_file(catalog: DataFrame) -> int:
    """Largest number of row groups in one file (a metadata-sized aggregate)."""
    return int(catalog.groupBy("file_path").count().agg(F.max("count")).first()[0] or 0)


def logical_blocks(block_col: Column, name: str = "piece_id") -> Column:
    """Piece id from a row key when files hold one row group (fixed-size logical blocks)."""
    return block_col.cast("bigint").alias(name)


def logical_blocks_by_row(df: DataFrame, block_rows: int, name: str = "piece_id") -> DataFrame:
    """Logical blocks of ``block_rows`` consecutive rows per file, numbered densely by
    (file path, block)."""
    tagged = df.withColumn("__lfp", F.col("_metadata.file_path")).withColumn(
        "__blk", F.floor(F.col("_metadata.row_index") / F.lit(block_rows)).cast("bigint")
    )
    per_file = tagged.groupBy("__lfp").agg(F.max("__blk").alias("__nb"))
    # One row per file.
    per_file = per_file.withColumn(
        "__base", F.sum(F.col("__nb") + 1).over(Window.orderBy("__lfp")) - (F.col("__nb") + 1)
    )
    per_file = broadcast_if_small(per_file, measure=True)
    out = tagged.join(per_file, "__lfp").withColumn(name, F.col("__base") + F.col("__blk"))
    return out.drop("__lfp", "__blk", "__nb", "__base")


def file_size_health(spark: SparkSession, path: str, min_median_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Upper median file size (element floor(n/2) of the sorted sizes) and a warning
    flag when it is below ``min_median_bytes`` and there is more than one file."""
    files = list_parquet_files(spark, path)
    # One row per file (metadata-sized).
    ranked = files.withColumn("__r", F.row_number().over(Window.orderBy("length", "file_path")) - 1)
    n = files.agg(F.count(F.lit(1)).alias("n_files"))
    med = ranked.crossJoin(F.broadcast(n)).filter(F.col("__r") == F.floor(F.col("n_files") / 2))
    return med.select(
        "n_files",
        F.col("length").alias("median_bytes"),
        ((F.col("n_files") > 1) & (F.col("length") < min_median_bytes)).alias("too_small"),
    )

