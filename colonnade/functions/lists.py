"""Lists: length, item casts, sums of items, and declared extensions on strings and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_len(x: Column) -> Column:
    """Items of a list; null for null."""
    return F.array_size(x).cast("long")


def cast_items(x: Column, kind: str) -> Column:
    """Items cast to a Spark type; null items stay null."""
    return x.cast(f"array<{kind}>")


def list_sum(x: Column, kind: str = "double") -> Column:
    """The sum of a list's items; nulls are passed over; 0 of none."""
    return F.aggregate(x, F.lit(0).cast(kind), lambda s, item: s + F.coalesce(item.cast(kind), F.lit(0).cast(kind)))


def length(x: Column) -> Column:
    """Characters of a string."""
    return F.char_length(x).cast("long")


def substring(x: Column, start: int, count: int) -> Column:
    """count characters from start, counted from 0."""
    return F.substring(x, start + 1, count)


def concat_elements(*columns: Column) -> Column:
    return F.concat(*columns)


def date_part(field: str, x: Column) -> Column:
    return F.date_part(F.lit(field), x)
