"""Distributed prefix numbering: a global 0-based row index under an order.

No single-partition window: rows are range-partitioned on the order, each row is
tagged with (partition, position), the assignment is fixed by a reliable checkpoint,
and a per-partition count table (one row per partition, so its size is bounded by
the partition count, not by the data) is prefix-summed and broadcast back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT_BYTES, broadcast_if_small, default_parallelism, estimated_bytes, reliable_checkpoint

_MASK33 = (1 << 33) - 1


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def numbering_partitions(df: DataFrame) -> int:
    """Range partitions for numbering: about 256 MB each by Catalyst's size estimate,
    at least one per core (or the shuffle setting if smaller). Without a usable
    estimate, the session's shuffle partition count."""
    spark = df.sparkSession
    shuffle_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    est = estimated_bytes(df)
    # Plans over checkpoints or RDDs report the "unknown" sentinel (Long.MaxValue).
    if est is None or est >= (1 << 60):
        return shuffle_n
    cores = default_parallelism(spark)
    floor_n = min(cores, shuffle_n)
    return int(max(floor_n, -(-est // TARGET_PARTITION_BYTES)))


def _cols(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_row_index(df: DataFrame, order, name: str = "row_idx", num_partitions: int | None = None) -> DataFrame:
    """Add ``name``: 0-based position of the row in the total order ``order``.

    ``order`` must be unique per row (add a key column to break ties).
    """
    n = num_partitions or numbering_partitions(df)
    order_cols = _cols(order)
    tagged = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    tagged = reliable_checkpoint(tagged)
    pid = F.shiftright(F.col("__mid"), 33)
    counts = tagged.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: a window without partitioning is fine on this table.
    offsets = counts.select(
        "__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off")
    )
    out = tagged.join(F.broadcast(offsets), pid == F.col("__pid"), "inner").withColumn(
        name, F.col("__off") + F.col("__mid").bitwiseAND(F.lit(_MASK33))
    )
    return out.drop("__mid", "__pid", "__off")


def with_running_sum(df: DataFrame, order, value: str, name: str, one_task_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one in the total order ``order``.

    A table of up to ``one_task_bytes`` (one whose estimate is above it is written once and
    measured) is summed in one task; a larger one in range partitions, each with the sum of the
    partitions before it.
    """
    size = estimated_bytes(df)
    if size is None or size > one_task_bytes:
        df = reliable_checkpoint(df)
        size = estimated_bytes(df)
    cols = _cols(order)
    if size is not None and size <= one_task_bytes:
        before = Window.orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    parts = df.repartitionByRange(numbering_partitions(df), *cols).sortWithinPartitions(*cols)
    parts = reliable_checkpoint(parts.withColumn("__mid", F.monotonically_increasing_id()))
    parts = parts.withColumn("__pid", F.shiftright(F.col("__mid"), 33))
    # One row per partition.
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("__pid").agg(F.sum(value).alias("__sum"))
    sums = sums.select("__pid", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(sums), "__pid")
    return out.select(*df.columns, (F.col("__off") + F.col("__in")).alias(name))


def _join_on_groups(left: DataFrame, stats: DataFrame, group_cols: list[str]) -> DataFrame:
    """Join a per-group table back (null-safe keys, renamed to avoid self-join ambiguity)."""
    renamed = stats.select(
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(group_cols)],
        *[c for c in stats.columns if c not in group_cols],
    )
    renamed = broadcast_if_small(renamed, measure=True)
    cond = None
    for i, c in enumerate(group_cols):
        e = F.col(c).eqNullSafe(F.col(f"__k{i}"))
        cond = e if cond is None else cond & e
    out = left.join(renamed, cond, "inner")
    return out.drop(*[f"__k{i}" for i in range(len(group_cols))])


def with_group_row_index(
    df: DataFrame, group_cols, order, name: str = "group_idx", num_partitions: int | None = None,
    size_name: str | None = None,
) -> DataFrame:
    """0-based position inside each group, without one task per group.

    A hot group is spread over many range partitions; its first global index is found
    with a partial (map-side combined) aggregate and subtracted. With ``size_name`` the
    same aggregate also yields the group size.
    """
    group_cols = list(group_cols)
    g = with_row_index(df, [*group_cols, *order], "__gidx", num_partitions)
    aggs = [F.min("__gidx").alias("__gstart")]
    if size_name:
        aggs.append(F.count(F.lit(1)).alias(size_name))
    starts = g.groupBy(*group_cols).agg(*aggs)
    out = _join_on_groups(g, starts, group_cols)
    extra = [F.col(size_name)] if size_name else []
    return out.select(*df.columns, (F.col("__gidx") - F.col("__gstart")).alias(name), *extra)


def with_group_sizes(df: DataFrame, group_cols, name: str = "group_size") -> DataFrame:
    """Attach the row count of each group (partial aggregate + join, no window)."""
    group_cols = list(group_cols)
    sizes = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(name))
    return _join_on_groups(df, sizes, group_cols)


def with_dense_group_rank(df: DataFrame, id_col: str, group_col: str, name: str = "group_idx",
                          block_rows: int = 1 << 20) -> DataFrame:
    """0-based rank of each row inside its group, ordered by a *dense, deterministic*
    integer id (e.g. ``spark.range`` output with a group derived from the id).

    No checkpoint is needed because recomputation yields the same rows: ids are cut
    into fixed blocks, per (block, group) counts are prefix-summed over blocks (a table
    with one row per block and group), and the rank inside a block is a window over at
    most ``block_rows`` rows.
    """
    blk = F.floor(F.col(id_col) / F.lit(block_rows)).cast("bigint")
    keyed = df.withColumn("__blk", blk)
    counts = keyed.groupBy("__blk", group_col).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group_col).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__blk", group_col, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = Window.partitionBy("__blk", group_col).orderBy(id_col)
    ranked = keyed.withColumn("__r", F.row_number().over(inner) - 1)
    out = ranked.join(broadcast_if_small(offsets), ["__blk", group_col], "inner")
    return out.withColumn(name, F.col("__off") + F.col("__r")).drop("__blk", "__r", "__off")
