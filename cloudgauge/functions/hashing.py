"""Hash-driven order: the replacement for a seeded shuffle.

The order of rows under ``md5(seed:id)`` does not depend on partitioning, file layout
or engine, and its leading digits cut the rows of any key into even slices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_DIGITS = 3
SLICES = 16**SLICE_DIGITS


def hash_key(seed: int | str, *cols: Column | str) -> Column:
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_slice(key: Column) -> Column:
    """Leading hex digits as a number in [0, SLICES): monotone in the key."""
    return F.conv(F.substring(key, 1, SLICE_DIGITS), 16, 10).cast("int")


def hash_index(key: Column, n: Column) -> Column:
    """Index in [0, n) drawn from the first 32 bits of the key."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), n)
