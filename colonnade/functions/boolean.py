"""Boolean operators and null tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_(x: Column) -> Column:
    """Null stays null."""
    return ~x


def is_null(x: Column) -> Column:
    return x.isNull()


def is_not_null(x: Column) -> Column:
    return x.isNotNull()


logical_nulls = is_not_null


def intersect_and_copy_nulls(inputs: list[Column], result: Column) -> Column:
    """result, null where any input is."""
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in inputs], F.lit(True)), result)


def and_kleene(a: Column, b: Column) -> Column:
    """False wins over null."""
    return a & b


def or_kleene(a: Column, b: Column) -> Column:
    """True wins over null."""
    return a | b


def and_(a: Column, b: Column) -> Column:
    """Null wins."""
    return intersect_and_copy_nulls([a, b], a & b)


def or_(a: Column, b: Column) -> Column:
    """Null wins."""
    return intersect_and_copy_nulls([a, b], a | b)


def and_not(a: Column, b: Column) -> Column:
    return intersect_and_copy_nulls([a, b], a & ~b)


def nullif(x: Column, mask: Column) -> Column:
    """x, null where mask is true."""
    return F.when(~F.coalesce(mask, F.lit(False)), x)


def zip_(mask: Column, a: Column, b: Column) -> Column:
    """a where mask is true, else b."""
    return F.when(mask, a).otherwise(b)
