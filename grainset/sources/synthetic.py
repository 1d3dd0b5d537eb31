"""Synthetic rows from a declared schema, generated by Spark from seeded hashes.

Integers are uniform over the full range of their numpy dtype, floats uniform in
[0, 1), strings are hex text, unknown tensor dimensions become 13. Every value is a
function of (seed, row id, field), so generation is parallel and reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import default_parallelism
from .schema import Field

UNKNOWN_DIM = 13

# Full integer range of each numpy integer dtype.
INT_RANGES = {
    "int8": (-128, 127),
    "uint8": (0, 255),
    "int16": (-32768, 32767),
    "uint16": (0, 65535),
    "int32": (-2147483648, 2147483647),
    "uint32": (0, 4294967295),
    "int64": (-9223372036854775808, 9223372036854775807),
}


def _bits(seed: int, name: str, i: Column) -> Column:
    """64 pseudo-random bits (signed bigint) from (seed, field, row, element)."""
    return F.xxhash64(F.lit(seed), F.lit(name), i)


def _unit(seed: int, name: str, i: Column) -> Column:
    return F.pmod(_bits(seed, name, i), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _value(f: Field, seed: int, i: Column) -> Column:
    d = f.dtype
    if d in INT_RANGES:
        lo, hi = INT_RANGES[d]
        if d == "int64":
            v = _bits(seed, f.name, i)
        else:
            v = F.pmod(_bits(seed, f.name, i), F.lit(hi - lo + 1)) + F.lit(lo)
        return v.cast(f.element_type())
    if d in ("float32", "float64"):
        return _unit(seed, f.name, i).cast(f.element_type())
    if d == "bool":
        return F.pmod(_bits(seed, f.name, i), F.lit(2)) == F.lit(1)
    if d == "str":
        return F.md5(F.concat_ws("|", F.lit(seed), F.lit(f.name), i.cast("string")))
    if d == "bytes":
        return F.unhex(F.md5(F.concat_ws("|", F.lit(seed), F.lit(f.name), i.cast("string"))))
    if d == "decimal":
        return (_unit(seed, f.name, i)).cast(f.element_type())
    raise ValueError(f"cannot generate values for dtype {d}")


def generate_rows(spark: SparkSession, fields: list[Field], num_rows: int, seed: int = 0,
                  num_partitions: int | None = None) -> DataFrame:
    # The row id gets a private name: a field called "id" must not shadow it.
    ids = spark.range(0, num_rows, numPartitions=num_partitions or default_parallelism(spark))
    ids = ids.select(F.col("id").alias("__rid"))
    cols = []
    for f in fields:
        rid = F.col("__rid")
        if not f.is_tensor:
            c = _value(f, seed, rid)
        else:
            shape = [d if d else UNKNOWN_DIM for d in f.shape]
            n = 1
            for d in shape:
                n *= d
            vals = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                               lambda k: _value(f, seed, rid * F.lit(n) + k.cast("bigint")))
            if len(f.shape) == 1:
                c = vals
            else:
                c = F.struct(F.array(*[F.lit(d) for d in shape]).alias("shape"), vals.alias("values"))
        cols.append(c.cast(f.spark_type()).alias(f.name, metadata=f.metadata()))
    out = ids.select(*cols)
    return out


def shuffle_analysis_dataset(spark: SparkSession, path: str, num_rows: int = 1000, row_group_size: int = 100):
    """Ordered ids in files of ``row_group_size`` rows (one group per file), for
    measuring shuffle quality."""
    n_files = max(1, (num_rows + row_group_size - 1) // row_group_size)
    df = spark.range(num_rows).repartitionByRange(n_files, "id").sortWithinPartitions("id")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
