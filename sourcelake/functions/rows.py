"""Arrays to rows, and rows that sort fast.

The inner generators make the optimizer add a ``size(array) > 0`` filter, which
it pushes to the scan together with a second copy of whatever computes the
array.  The outer forms compute the array once; the empty rows go afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keep: list, items: Column, name: str) -> DataFrame:
    """``keep`` columns and one row per non-NULL item."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def each_pos(df: DataFrame, keep: list, items: Column, pos: str, name: str) -> DataFrame:
    """As :func:`each`, with positions from 0."""
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).where(F.col(pos).isNotNull())


HASH = "_hash"


def hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with a hash of ``keys`` to join or group by before the keys themselves.

    Sorting then compares numbers; paths with long common beginnings are compared
    only where hashes are equal."""
    return df.withColumn(HASH, F.xxhash64(*keys))
