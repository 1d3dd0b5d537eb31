"""User transforms: schema edits plus an optional Python function.

Without a function the transform is pure projection (``drop``/``select``), planned
by Catalyst. With a function, rows travel through Arrow batches in ``mapInPandas``
(batch functions) or as dicts of exact Python values in ``mapInArrow`` (row functions); a
function that needs a whole row group at once runs in ``applyInPandas`` grouped by
``piece_id`` (pieces are bounded by the row-group size).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.schema import Field


def edit_field(name: str, dtype: str, shape: tuple = (), nullable: bool = False) -> Field:
    """An edited / added field (no codec)."""
    return Field(name, dtype, tuple(shape), None, nullable)


@dataclass
class TransformSpec:
    func: Callable | None = None
    edit_fields: list = field(default_factory=list)
    removed_fields: list = field(default_factory=list)
    selected_fields: list | None = None
    mode: str = "batch"  # 'batch' (pandas DataFrame in/out), 'row' (dict in/out) or 'piece'

    def __post_init__(self):
        if self.removed_fields and self.selected_fields is not None:
            raise ValueError("Only one of removed_fields and selected_fields can be given")
        if self.mode not in ("batch", "row", "piece"):
            raise ValueError("mode must be 'batch', 'row' or 'piece'")
        self.edit_fields = [f if isinstance(f, Field) else edit_field(*f) for f in self.edit_fields]


def transform_schema(schema: T.StructType, spec: TransformSpec) -> T.StructType:
    """Schema of the result: untouched fields in their order, then the edited ones, or just
    ``selected_fields`` in the order given. Names that are not there are warned about."""
    edits = {f.name: f.struct_field() for f in spec.edit_fields}
    held = {f.name: f for f in schema.fields}
    for name in sorted(set(spec.removed_fields) - held.keys()):
        warnings.warn(f"cannot remove {name!r}: the input has no such field")
    result = {n: f for n, f in held.items() if n not in spec.removed_fields and n not in edits} | edits
    order = list(result) if spec.selected_fields is None else spec.selected_fields
    for name in order:
        if name not in result:
            warnings.warn(f"cannot select {name!r}: the result has no such field")
    return T.StructType([result[n] for n in order if n in result])


def _tensor_value(e: Field, value):
    """A function's array as a tensor struct: its shape and its values in row-major order."""
    if value is None:
        return None
    if None in e.shape:
        raise ValueError(f"{e.name}: results need a fixed shape, {e.shape} is declared")
    cells = np.asarray(value)
    if cells.shape != e.shape or not cells.flags.c_contiguous:
        raise ValueError(f"{e.name}: expected a row-major array of shape {e.shape}, got {cells.shape}")
    return {"shape": list(cells.shape), "values": cells.ravel().tolist()}


def _python_rows(batch: pa.RecordBatch):
    """Rows as dicts of exact Python values (a nullable integer stays an integer, a null is
    None); arrays of numbers without nulls become numpy arrays."""
    columns = []
    for column in batch.columns:
        values = column.to_pylist()
        kind = column.type
        if pa.types.is_list(kind) or pa.types.is_large_list(kind):
            if pa.types.is_floating(kind.value_type) or pa.types.is_integer(kind.value_type):
                dtype = kind.value_type.to_pandas_dtype()
                values = [v if v is None or None in v else np.array(v, dtype=dtype) for v in values]
        columns.append(values)
    for row in zip(*columns):
        yield dict(zip(batch.schema.names, row))


def apply_transform(df: DataFrame, spec: TransformSpec, piece_col: str = "piece_id") -> DataFrame:
    out_schema = transform_schema(df.schema, spec)
    if spec.func is None:
        return df.select(*out_schema.fieldNames())
    want = out_schema.fieldNames()
    removed = set(spec.removed_fields)
    func = spec.func
    mode = spec.mode

    tensors = [f for f in spec.edit_fields if len(f.shape) > 1 and f.name in want]

    def check_names(names):
        if set(names) - removed != set(want):
            raise ValueError(f"the function's columns {sorted(names)} do not match those of the schema {sorted(want)}")

    def finish(res: pd.DataFrame) -> pd.DataFrame:
        check_names(res.columns)
        for e in tensors:
            res[e.name] = res[e.name].map(lambda x, e=e: _tensor_value(e, x))
        return res[want]

    if mode == "piece":
        if piece_col not in df.columns:
            raise ValueError("piece transforms need a piece_id column")
        return df.groupBy(piece_col).applyInPandas(lambda pdf: finish(func(pdf)), out_schema)

    if mode == "row":
        arrow = to_arrow_schema(out_schema)

        def run_rows(batches):
            for batch in batches:
                rows = []
                for r in _python_rows(batch):
                    got = func(r)
                    check_names(got)
                    rows.append(got | {e.name: _tensor_value(e, got[e.name]) for e in tensors})
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

        return df.mapInArrow(run_rows, out_schema)

    return df.mapInPandas(lambda batches: (finish(func(pdf)) for pdf in batches), out_schema)
