"""Declared dataset schemas as Spark ``StructType`` with per-field metadata.

A field carries its numpy dtype name, its shape (JSON text, ``null`` for an unknown
dimension) and an optional codec name in ``StructField.metadata``; Spark persists
that metadata in the Parquet files it writes, so the declared schema travels with
the data and no pickled object is ever read.

Tensor fields (non-scalar shapes) are stored as ``struct<shape: array<int>,
values: array<T>>`` so they stay typed, prunable and checkable by expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META_KEY = "grainset"

# Numpy scalar dtype -> Spark storage type.
SCALAR_TYPES = {
    "int8": T.ByteType(),
    "uint8": T.ShortType(),
    "int16": T.ShortType(),
    "uint16": T.IntegerType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "str": T.StringType(),
    "bytes": T.BinaryType(),
    "bool": T.BooleanType(),
}
# Types that only exist inside arrays / tensors.
ELEMENT_ONLY_TYPES = {"uint32": T.LongType()}

UNSIGNED_RANGE = {"uint8": 255, "uint16": 65535, "uint32": 4294967295}


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    shape: tuple = ()
    codec: str | None = None
    nullable: bool = False
    decimal: tuple | None = None  # (precision, scale) for dtype 'decimal'

    def __eq__(self, other):  # equality ignores the codec
        return isinstance(other, Field) and (self.name, self.dtype, self.shape, self.nullable) == (
            other.name, other.dtype, other.shape, other.nullable)

    def __hash__(self):
        return hash((self.name, self.dtype, self.shape, self.nullable))

    @property
    def is_tensor(self) -> bool:
        return len(self.shape) > 0

    def element_type(self) -> T.DataType:
        if self.dtype == "decimal":
            if not self.decimal:
                raise ValueError(f"Field {self.name}: decimal needs (precision, scale)")
            return T.DecimalType(*self.decimal)
        if self.dtype in SCALAR_TYPES:
            return SCALAR_TYPES[self.dtype]
        if self.dtype in ELEMENT_ONLY_TYPES and self.is_tensor:
            return ELEMENT_ONLY_TYPES[self.dtype]
        raise ValueError(f"Field {self.name}: dtype {self.dtype} has no Spark storage type for shape {self.shape}")

    def spark_type(self) -> T.DataType:
        el = self.element_type()
        if not self.is_tensor:
            return el
        if len(self.shape) == 1:
            return T.ArrayType(el, True)
        return T.StructType([
            T.StructField("shape", T.ArrayType(T.IntegerType(), False), False),
            T.StructField("values", T.ArrayType(el, True), True),
        ])

    def metadata(self) -> dict:
        # Nullability is kept here too: Spark reads every Parquet column back as nullable.
        meta = {"np": self.dtype, "shape": json.dumps(list(self.shape)), "codec": self.codec or "",
                "nullable": self.nullable}
        if self.decimal:
            meta["decimal"] = json.dumps(list(self.decimal))
        return {META_KEY: meta}

    def struct_field(self) -> T.StructField:
        return T.StructField(self.name, self.spark_type(), self.nullable, self.metadata())


def make_schema(fields: list[Field]) -> T.StructType:
    """Declared schema in field order (the order given)."""
    names = [f.name for f in fields]
    if len(set(names)) != len(names):
        raise ValueError("field names must be unique")
    return T.StructType([f.struct_field() for f in fields])


def fields_of(schema: T.StructType) -> list[Field]:
    """Declared fields from a StructType; raises if a field has no declaration."""
    out = []
    for sf in schema.fields:
        meta = sf.metadata.get(META_KEY)
        if meta is None:
            raise ValueError(f"Field {sf.name!r} carries no declared schema metadata")
        dec = tuple(json.loads(meta["decimal"])) if "decimal" in meta else None
        out.append(Field(sf.name, meta["np"], tuple(json.loads(meta["shape"])), meta.get("codec") or None,
                         bool(meta.get("nullable", sf.nullable)), dec))
    return out


def stored_schema(df: DataFrame) -> list[Field]:
    """Declared schema of a dataset read back from Parquet (S5)."""
    return fields_of(df.schema)


def _infer_dtype(dt: T.DataType) -> str | None:
    rev = {
        T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64",
        T.FloatType: "float32", T.DoubleType: "float64", T.StringType: "str", T.BinaryType: "bytes",
        T.BooleanType: "bool", T.DateType: "datetime64[D]", T.TimestampType: "datetime64[us]",
        T.TimestampNTZType: "datetime64[us]",
    }
    for k, v in rev.items():
        if isinstance(dt, k):
            return v
    if isinstance(dt, T.DecimalType):
        return "decimal"
    return None


def infer_fields(schema: T.StructType, omit_unsupported: bool = True, strict_compat: bool = False,
                 partition_columns: list[str] | None = None) -> list[Field]:
    """Fields inferred from a plain Parquet schema (S6).

    Scalars and arrays of scalars map directly. Nested lists, structs and maps are kept
    as-is (dtype 'object') unless ``strict_compat``, which drops them (or raises when
    ``omit_unsupported`` is False), as the reference's inference does.
    """
    out = []
    for sf in schema.fields:
        dt = sf.dataType
        d = _infer_dtype(dt)
        if d is not None:
            dec = (dt.precision, dt.scale) if isinstance(dt, T.DecimalType) else None
            out.append(Field(sf.name, d, (), None, sf.nullable, dec))
            continue
        if isinstance(dt, T.ArrayType) and _infer_dtype(dt.elementType) not in (None, "decimal"):
            out.append(Field(sf.name, _infer_dtype(dt.elementType), (None,), None, sf.nullable))
            continue
        if strict_compat:
            if omit_unsupported:
                continue
            raise ValueError(f"Column {sf.name!r} of type {dt.simpleString()} is not supported")
        out.append(Field(sf.name, "object", (), None, sf.nullable))
    if strict_compat and partition_columns:
        # Reference order: partition columns first (Spark lists them last).
        first = [f for f in out if f.name in partition_columns]
        out = first + [f for f in out if f.name not in partition_columns]
    return out


# ---------------------------------------------------------------- tensors


def tensor(shape_col: Column, values_col: Column) -> Column:
    return F.struct(shape_col.cast("array<int>").alias("shape"), values_col.alias("values"))


def tensor_compliant(col: Column, shape: tuple) -> Column:
    """Same rank; each dimension equal unless either side is unknown (None/0); value
    count equals the product of the stored shape."""
    s = col.getField("shape")
    ok = F.size(s) == F.lit(len(shape))
    for i, d in enumerate(shape):
        if d:
            dim = F.element_at(s, i + 1)
            ok = ok & ((dim == F.lit(d)) | (dim == F.lit(0)))
    prod = F.aggregate(s, F.lit(1).cast("bigint"), lambda acc, x: acc * x.cast("bigint"))
    return F.coalesce(ok & (F.size(col.getField("values")).cast("bigint") == prod), F.lit(False))


def check_tensor(col_name: str, shape: tuple, dtype: str | None = None) -> Column:
    """The column unchanged, or a job failure naming the field when a value does not
    comply with the declared shape (or an unsigned range)."""
    c = F.col(col_name)
    ok = tensor_compliant(c, shape)
    if dtype in UNSIGNED_RANGE:
        hi = UNSIGNED_RANGE[dtype]
        ok = ok & F.coalesce(F.forall(c.getField("values"), lambda x: (x >= 0) & (x <= hi)), F.lit(True))
    msg = f"Field {col_name}: value does not comply with shape {list(shape)}" + (f" / {dtype}" if dtype else "")
    return F.when(c.isNull() | ok, c).otherwise(F.raise_error(F.lit(msg)))


def npy_to_tensor(df: DataFrame, col_name: str, element_type: str = "float") -> DataFrame:
    """Bulk import of ``.npy`` byte columns into tensor structs, one Arrow-batched job."""
    out_type = f"struct<shape:array<int>,values:array<{element_type}>>"

    @F.pandas_udf(out_type)
    def decode(s: pd.Series) -> pd.DataFrame:
        import io

        shapes, values = [], []
        for b in s:
            if b is None:
                shapes.append(None)
                values.append(None)
                continue
            a = np.load(io.BytesIO(b), allow_pickle=False)
            shapes.append(list(a.shape))
            values.append(a.ravel(order="C").tolist())
        return pd.DataFrame({"shape": shapes, "values": values})

    return df.withColumn(col_name, decode(F.col(col_name)))


def tensor_to_npy(df: DataFrame, col_name: str, np_dtype: str) -> DataFrame:
    """Tensor struct to ``.npy`` bytes (interop with tools reading numpy files)."""

    @F.pandas_udf("binary")
    def encode(s: pd.DataFrame) -> pd.Series:
        import io

        out = []
        for shape, vals in zip(s["shape"], s["values"]):
            if shape is None:
                out.append(None)
                continue
            buf = io.BytesIO()
            np.save(buf, np.asarray(vals, dtype=np_dtype).reshape([int(x) for x in shape]))
            out.append(buf.getvalue())
        return pd.Series(out)

    return df.withColumn(col_name, encode(F.col(col_name)))
