"""Deterministic hash expressions.

All randomness in the library is derived from md5 of a seed and a stable row key,
never from ``rand()``, so results do not depend on partitioning and can be
recomputed after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The split modulus is Python's sys.maxsize (2**63 - 1) on 64-bit builds,
# and split borders are scaled by sys.maxsize - 1.
SPLIT_MODULUS = 2**63 - 1
SPLIT_SCALE = 2**63 - 2

_HEX64 = 2**52  # 13 hex digits give a uniform 52-bit integer


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_mod_bucket(value) -> Column:
    """int(md5(str(value)).hexdigest(), 16) % (2**63 - 1) as an exact decimal; null hashes
    as the text 'None'.

    2**64 = 2 (mod 2**63 - 1), so the 128-bit digest hi*2**64 + lo reduces to
    (2*hi + lo) mod (2**63 - 1), which fits in decimal(38, 0).
    """
    digest = F.md5(F.coalesce(_c(value).cast("string"), F.lit("None")))
    hi = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring(digest, 17, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(hi * F.lit(2) + lo, F.lit(SPLIT_MODULUS).cast("decimal(20,0)")).cast("decimal(20,0)")


def seeded_key(seed, *cols) -> Column:
    """Text key 'seed|c1|c2...' hashed by the helpers below."""
    s = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.concat_ws("|", s, *[_c(c).cast("string") for c in cols])


def order_key(seed, *cols) -> Column:
    """md5 hex of the seeded key: a uniform, reproducible sort key."""
    return F.md5(seeded_key(seed, *cols))


def hash_uniform(seed, *cols) -> Column:
    """Uniform double in [0, 1) from the first 52 bits of the seeded md5."""
    bits = F.conv(F.substring(order_key(seed, *cols), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(float(_HEX64))
