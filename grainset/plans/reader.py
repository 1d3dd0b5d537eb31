"""Configured dataset reads: a ``DatasetSpec`` turned into one DataFrame plan.

The operator order follows the reference reader: partition filters -> index
selection -> shard -> epochs and read order -> sub-split -> row predicate ->
transform -> sequences. Everything before the transform is declarative, so
Catalyst pushes filters and projections into the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import predicates as P
from ..operators import rowgroups as RG
from ..operators import sampling as X
from ..operators.projection import resolve_fields
from ..operators.sequences import NGram, ngram, ngram_no_overlap
from ..operators.transform import TransformSpec, apply_transform
from ..session import broadcast_if_small, reliable_checkpoint
from ..sources.catalog import attach_pieces, logical_blocks_by_row, max_groups_per_file, rebased_catalog, row_group_catalog


def normalize_urls(url_or_urls) -> list[str]:
    """Non-empty list of URLs sharing scheme and netloc; trailing '/' removed."""
    urls = url_or_urls if isinstance(url_or_urls, list) else [url_or_urls]
    if not urls:
        raise ValueError("no dataset URL given")
    out = []
    for u in urls:
        if not isinstance(u, str) or not u:
            raise ValueError("directory url must be a string")
        out.append(u[:-1] if u.endswith("/") else u)
    parsed = [urlparse(u) for u in out]
    for p, u in zip(parsed, out):
        if not p.scheme:
            raise ValueError(f"URL {u!r} has no scheme (e.g. file://, hdfs://, s3a://)")
    if any((p.scheme, p.netloc) != (parsed[0].scheme, parsed[0].netloc) for p in parsed):
        raise ValueError(f"the URLs {out} differ in scheme or host")
    return out


def _catalog_for(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Row-group catalog of the dataset: the stored one of a stamped dataset, else built
    from the footers once and checkpointed (it is used several times and must not be
    re-read, and its piece ids must stay fixed)."""
    from ..sources.writer import SIDE_DIR, path_exists

    if len(urls) == 1 and path_exists(spark, f"{urls[0]}/{SIDE_DIR}/catalog"):
        return reliable_checkpoint(rebased_catalog(spark, urls[0], spark.read.parquet(f"{urls[0]}/{SIDE_DIR}/catalog")))
    cats = [row_group_catalog(spark, u) for u in urls]
    cat = cats[0]
    for c in cats[1:]:
        cat = cat.unionByName(c)
    if len(cats) > 1:
        cat = cat.drop("piece_id").withColumn(
            "piece_id", (F.row_number().over(Window.orderBy("file_path", "row_group")) - 1).cast("bigint")
        )
    return reliable_checkpoint(cat)


def _selected_words(spark: SparkSession, spec) -> DataFrame:
    if not spec.index_path:
        raise ValueError("a selector needs index_path")
    index = RG.read_indexes(spark, spec.index_path)
    RG.check_index_names(index, spec.selector)
    return reliable_checkpoint(spec.selector.words(index))  # the index is read once for files and rows


@dataclass
class DatasetSpec:
    urls: object
    fields: list | None = None
    predicate: P.Predicate | None = None
    filters: list | None = None
    selector: RG.Selector | None = None
    index_path: str | None = None
    cur_shard: int | None = None
    shard_count: int | None = None
    num_epochs: int = 1
    shuffle_row_groups: bool = False
    shuffle_rows: bool = False
    shuffle_row_drop_partitions: int = 1
    seed: int = 0
    transform: TransformSpec | None = None
    ngram: NGram | None = None
    block_rows: int | None = None  # logical blocks instead of Parquet row groups
    row_key: list = field(default_factory=list)
    strict_predicate_fields: bool = True
    global_positions: bool = True  # False: return sort keys instead of numbering (no checkpoint)


MOST_LISTED_FILES = 10_000
FILE_RANGES = 256


def in_files(df: DataFrame, files: DataFrame) -> DataFrame:
    """``df``, a scan, cut to the files in ``files`` (file_path, as ``_metadata.file_path`` gives
    it): a filter on file metadata, by which Spark drops files when it lists them.

    Up to ``MOST_LISTED_FILES`` files are named in the filter. More are given as the ends of at
    most ``FILE_RANGES`` ranges of paths, whatever their number, searched as a tree; files between
    two selected ones may then stay, so the caller still drops rows by piece."""
    files = files.select("file_path").distinct()
    path = F.col("_metadata.file_path")
    paths = [r["file_path"] for r in files.limit(MOST_LISTED_FILES + 1).collect()]
    if len(paths) <= MOST_LISTED_FILES:
        return df.filter(path.isin(paths) if paths else F.lit(False))
    runs = files.repartitionByRange(FILE_RANGES, "file_path").groupBy(F.spark_partition_id().alias("run"))
    ends = sorted((r["low"], r["high"]) for r in runs.agg(F.min("file_path").alias("low"), F.max("file_path").alias("high")).collect())

    def within(runs):
        if len(runs) == 1:
            return (path >= runs[0][0]) & (path <= runs[0][1])
        half = len(runs) // 2
        return F.when(path <= runs[half - 1][1], within(runs[:half])).otherwise(within(runs[half:]))

    return df.filter(within(ends))


def read_dataset(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    urls = normalize_urls(spec.urls)
    df = spark.read.parquet(*urls)
    if spec.filters:
        df = df.filter(P.dnf_filter(spec.filters))
    row_key = spec.row_key or ["piece_id", "__fp", "__ri"]
    # Physical row order inside a piece: (file, row index), taken before any join.
    df = df.withColumn("__fp", F.col("_metadata.file_path")).withColumn("__ri", F.col("_metadata.row_index"))
    # Pieces: Parquet row groups from the footers, or logical row blocks.
    if spec.block_rows:
        df = logical_blocks_by_row(df, spec.block_rows)
        total_pieces = None
    else:
        cat = _catalog_for(spark, urls)
        if spec.selector is not None:
            words = _selected_words(spark, spec)
            df = in_files(df, RG.in_words(cat, words))
        df = attach_pieces(df, cat, max_groups_per_file=max_groups_per_file(cat))
        # The too-many-shards check uses the total row-group count (metadata-sized).
        total_pieces = cat.count() if spec.shard_count is not None else None
    if spec.selector is not None:
        if spec.block_rows:
            words = _selected_words(spark, spec)
        df = RG.in_words(df, words)
    if spec.shard_count is not None:
        if spec.filters:
            # Shards deal out the pieces that the filters leave, numbered anew.
            left = df.select("piece_id").distinct()
            numbered = left.withColumn("__ordinal", F.row_number().over(Window.orderBy("piece_id")) - 1)
            numbered = reliable_checkpoint(numbered)
            df = df.join(broadcast_if_small(numbered), "piece_id")
            df = RG.shard(df, spec.cur_shard, spec.shard_count, numbered.count(), "__ordinal").drop("__ordinal")
        else:
            df = RG.shard(df, spec.cur_shard, spec.shard_count, total_pieces)
    if spec.ngram is not None and spec.shuffle_row_drop_partitions > 1 and not spec.ngram.timestamp_overlap:
        raise NotImplementedError("windows without overlap cannot be cut from sub-splits: use one part")
    part_col, rank_col = None, None
    key = [c for c in row_key if c != "piece_id"]
    if spec.shuffle_row_drop_partitions > 1:
        overlap = (spec.ngram.length - 1) if spec.ngram is not None else 0
        if spec.shuffle_rows:  # shuffled inside the piece first, then cut
            rank_col = "__rank"
            df = X.shuffled_parts(df, spec.shuffle_row_drop_partitions, key, spec.num_epochs, spec.seed, overlap, index_name=rank_col)
        else:
            df = RG.subsplit_parts(df, spec.shuffle_row_drop_partitions, [F.col(c) for c in row_key], overlap=overlap)
        part_col = "part"
    # Row predicate, then projection (predicate fields must be in the selected view).
    columns = [c for c in df.columns if not c.startswith("__") and c not in ("piece_id", "epoch", "part")]
    selected = resolve_fields(columns, spec.fields) if spec.fields else columns
    if spec.predicate is not None:
        missing = spec.predicate.get_fields() - set(selected)
        if missing and spec.strict_predicate_fields:
            raise ValueError(f"Predicate fields {sorted(missing)} must be among the selected fields")
        df = df.filter(spec.predicate.to_column())
    shuffles = {"shuffle_pieces": spec.shuffle_row_groups, "shuffle_rows": spec.shuffle_rows, "seed": spec.seed}
    keep = ["epoch", "piece_id", *([part_col] if part_col else []), *selected]
    if not spec.global_positions:
        if rank_col is None:
            df = X.with_epochs(df, spec.num_epochs) if spec.num_epochs != 1 else df.withColumn("epoch", F.lit(0))
        if spec.ngram is not None or spec.transform is not None:
            raise ValueError("sequences and transforms need global_positions=True")
        # Sort keys only: sortWithinPartitions(order_key*) or a range write gives the order
        # without materialising a global numbering.
        order = X.read_order(df, key, "piece_id", "epoch", part_col=part_col, **shuffles)
        return df.select(*[k.alias(f"order_key{i}") for i, k in enumerate(order)], *keep)
    ordered = X.piece_positions(df, key, spec.num_epochs, part_col=part_col, rank_col=rank_col, **shuffles).select("position", *keep)
    if spec.transform is not None:
        ordered = apply_transform(ordered, spec.transform)
    if spec.ngram is not None:
        scope = ["epoch", "piece_id"] + ([part_col] if part_col else [])
        # Reader positions are dense and contiguous per scope: no second numbering pass.
        if spec.ngram.timestamp_overlap:
            return ngram(ordered, spec.ngram, scope, ["position"], position_col="position")
        return ngram_no_overlap(ordered, spec.ngram, scope, ["position"], position_col="position")
    return ordered
