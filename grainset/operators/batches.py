"""Batch assembly: one output row per batch, one array column per input column.

Rows get a global position under a given order (distributed prefix numbering),
``batch_id = floor(position / batch_size)``. The numbered rows lie in sorted runs, so most
batches are cut where the rows are read, in Arrow; only the rows of batches that a run's end
divides move again, to be put together. Rows with an existing position are grouped by batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbering import with_row_index


def in_order(entries: Column, keys: list[str]) -> Column:
    """The structs of an array ordered by their ``keys`` fields alone, so that the other
    fields may be of any type (maps too) and are not compared."""
    place = F.transform(entries, lambda x, i: F.struct(*[x[k].alias(k) for k in keys], i.alias("__i")))
    return F.transform(F.array_sort(place), lambda p: entries[p["__i"]])


def _in_arrow(kind: T.DataType) -> bool:
    """Types that keep their values on the way through Arrow."""
    if isinstance(kind, T.ArrayType):
        return _in_arrow(kind.elementType)
    if isinstance(kind, T.MapType):
        return _in_arrow(kind.keyType) and _in_arrow(kind.valueType)
    if isinstance(kind, T.StructType):
        return all(_in_arrow(f.dataType) for f in kind.fields) and len(kind.names) == len(set(kind.names)) > 0
    plain = (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return isinstance(kind, plain) and type(kind) not in (T.CharType, T.VarcharType)


def cut_runs(batches, size: int, names: list[str]):
    """Record batches of rows whose first column is a position, as record batches of pieces:
    (batch_id, first position, rows, a list of each other column). A piece holds consecutive
    positions of one batch; at most one unfinished piece is kept between record batches."""
    held = None

    def cut(rows: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        pos = rows.column(0).to_numpy()
        ends = np.append(cuts[1:], len(pos))
        offsets = pa.array(np.append(cuts, len(pos)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, c) for c in rows.columns[1:]]
        arrays = [pa.array(pos[cuts] // size), pa.array(pos[cuts]), pa.array((ends - cuts).astype("int32")), *lists]
        return pa.RecordBatch.from_arrays(arrays, names=["batch_id", "__first", "batch_rows", *names])

    for rows in batches:
        if not rows.num_rows:
            continue
        if held is not None:
            rows = pa.Table.from_batches([held, rows.cast(held.schema)]).combine_chunks().to_batches()[0]
        pos = rows.column(0).to_numpy()
        new = (np.diff(pos) != 1) | (np.diff(pos // size) != 0)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1])
        last = int(cuts[-1])
        if last:
            yield cut(rows.slice(0, last), cuts[:-1])
        held = rows.slice(last)
    if held is not None:
        yield cut(held, np.array([0]))


def _runs(pos: DataFrame, size: int) -> DataFrame:
    fields = pos.schema.fields[1:]
    names = [f.name for f in fields]
    kinds = [T.StructField("batch_id", T.LongType()), T.StructField("__first", T.LongType()), T.StructField("batch_rows", T.IntegerType())]
    kinds += [T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]
    return pos.mapInArrow(lambda batches: cut_runs(batches, size, names), T.StructType(kinds))


def _joined(pieces: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Whole batches as they are, and the others from their pieces: rows of divided batches and
    of a short last batch alone go through the grouping."""
    whole = pieces.where(F.col("batch_rows") == size).drop("__first")
    parts = pieces.where(F.col("batch_rows") < size).groupBy("batch_id").agg(
        F.sum("batch_rows").cast("int").alias("batch_rows"),
        F.collect_list(F.struct("__first", *[F.col(c) for c in columns])).alias("__all"))
    parts = parts.select("batch_id", "batch_rows", in_order(F.col("__all"), ["__first"]).alias("__rows"))
    lists = [F.flatten(F.col("__rows").getField(c)).alias(c) for c in columns]
    return whole.unionByName(parts.select("batch_id", "batch_rows", *lists))


def batch_rows(df: DataFrame, batch_size: int, order: list, columns: list[str] | None = None,
               full_only: bool = False, position_col: str | None = None) -> DataFrame:
    """Group rows into batches of ``batch_size`` in ``order``.

    The last batch may be short unless ``full_only`` (then an incomplete tail is not
    emitted). ``position_col``: an existing global position to use instead of numbering.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    columns = columns or [c for c in df.columns if c != position_col]
    if position_col is None:
        pos = with_row_index(df, order, "__pos")
        if all(_in_arrow(df.schema[c].dataType) for c in columns):
            out = _joined(_runs(pos.select("__pos", *columns), batch_size), batch_size, columns)
            return out.filter(F.col("batch_rows") == F.lit(batch_size)) if full_only else out
        position_col = "__pos"
    else:
        pos = df
    bid = F.floor(F.col(position_col) / F.lit(batch_size)).cast("bigint")
    grouped = pos.groupBy(bid.alias("batch_id")).agg(
        F.collect_list(F.struct(F.col(position_col).alias("__p"), *[F.col(c) for c in columns])).alias("__all")
    )
    grouped = grouped.select("batch_id", in_order(F.col("__all"), ["__p"]).alias("__rows"))
    out = grouped.select(
        "batch_id",
        F.size("__rows").alias("batch_rows"),
        *[F.col("__rows").getField(c).alias(c) for c in columns],
    )
    if full_only:
        out = out.filter(F.col("batch_rows") == F.lit(batch_size))
    return out


def stack_matrix(batches: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Check that every list in a batch's ``column`` has the same length (else fail,
    listing the lengths) and expose it as a matrix (array of equal-length arrays)."""
    lens = F.transform(column, lambda a: F.size(a))
    ok = F.array_min(lens) == F.array_max(lens)
    msg = F.concat(F.lit(f"Length of all elements of {column} in a batch must be equal, got "),
                   F.array_join(F.transform(lens, lambda x: x.cast("string")), ", "))
    checked = F.when(ok | (F.size(column) == 0), F.col(column)).otherwise(F.raise_error(msg))
    return batches.withColumn(name or column, checked).withColumn(
        f"{name or column}_shape", F.array(F.size(column), F.coalesce(F.array_max(lens), F.lit(0)))
    )


def unbatch(batches: DataFrame, columns: list[str]) -> DataFrame:
    """Row-wise unroll: one row per element position across the batch arrays."""
    z = F.explode(F.arrays_zip(*[F.col(c) for c in columns]))
    return batches.select("batch_id", z.alias("__z")).select(
        "batch_id", *[F.col("__z")[c].alias(c) for c in columns]
    )


def piece_batches(df: DataFrame, columns: list[str], order: list, piece_col: str = "piece_id") -> DataFrame:
    """One batch per row group (the columnar reader's unit): arrays of each column in the
    piece's row order. Pieces are bounded by the row-group size, so each group fits a task."""
    keys = [f"__o_{i}" for i in range(len(order))]
    by = [(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys)]
    grouped = df.groupBy(piece_col).agg(
        F.collect_list(F.struct(*by, *[F.col(c).alias(f"__c_{c}") for c in columns])).alias("__all")
    )
    grouped = grouped.select(piece_col, in_order(F.col("__all"), keys).alias("__rows"))
    return grouped.select(
        piece_col,
        F.size("__rows").alias("batch_rows"),
        *[F.col("__rows").getField(f"__c_{c}").alias(c) for c in columns],
    )


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.MapType)) or isinstance(kind, T.ArrayType) and _nested(kind.elementType)


def _collated(c: Column, kind: T.DataType) -> Column:
    """An array of values of type ``kind``, one of each row, rebuilt."""
    if isinstance(kind, T.StructType):

        def field(f):
            return _collated(F.transform(c, lambda x: x[f.name]), f.dataType).alias(f.name)

        return F.struct(*map(field, kind.fields))
    if isinstance(kind, T.MapType):
        missing = F.raise_error(F.lit("a row's map lacks a key of the first row's")).cast(kind.valueType)

        def values(k):
            got = F.transform(c, lambda m: F.when(F.map_contains_key(m, k), F.element_at(m, k)).otherwise(missing))
            return _collated(got, kind.valueType)

        keys = F.map_keys(F.get(c, F.lit(0)))
        return F.map_from_arrays(keys, F.transform(keys, values))
    if _nested(kind):  # sequences: one entry per step, as many as the shortest has
        steps = F.array_min(F.transform(c, lambda a: F.size(a)))
        places = F.filter(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), lambda i: i < steps)
        return F.transform(places, lambda i: _collated(F.transform(c, lambda a: F.get(a, i)), kind.elementType))
    return c


def collate(batches: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turns the batch arrays of nested ``columns`` (all, unless given) inside out: an array of
    structs becomes a struct of arrays, an array of maps a map of arrays (the first row's keys,
    an error if a row lacks one), an array of sequences of such an array with an entry for each
    step, as many as the shortest sequence has; and so on inside. Values of other types
    (numbers, tensors, decimals, text) stay arrays with one value of each row."""
    out = []
    for f in batches.schema.fields:
        inside = isinstance(f.dataType, T.ArrayType) and (columns is None or f.name in columns)
        out.append(_collated(F.col(f.name), f.dataType.elementType).alias(f.name) if inside else F.col(f.name))
    return batches.select(*out)
