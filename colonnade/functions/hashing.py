"""Hashes of values.  Equal values have equal hashes; null has none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import UnsupportedType

#: Types that the unchained hash takes.
UNCHAINED = ("i32", "u32", "f32", "i64", "u64")


def hash_(x: Column) -> Column:
    return F.when(x.isNotNull(), F.xxhash64(x))


def hash_unchained(x: Column, kind: str) -> Column:
    """For open hash tables: fixed-width types of 32 and 64 bits alone."""
    if kind not in UNCHAINED:
        raise UnsupportedType(f"no unchained hash of {kind}")
    return F.when(x.isNotNull(), F.xxhash64(F.lit(1), x))
