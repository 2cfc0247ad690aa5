"""Casts between logical types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wrap
from .types import UnsupportedType, bounds, is_float, is_integer, spark_type

_TEXT = ("utf8", "binary")


def cast(x: Column, have: str, want: str) -> Column:
    """x of type have as type want; null stays null.

    Integers lose their high bits when narrowed.  Floats are cut toward zero; what is out of range gives null.
    Booleans become 0 or 1 in integers; a number is true unless it is 0 or NaN.  Strings and bytes are each
    other's UTF-8.  Strings and numbers, booleans and floats, and lists of another depth don't meet.
    """
    if have == want:
        return x
    if have.startswith("list<") and want.startswith("list<"):
        cast(F.lit(None), have[5:-1], want[5:-1])  # raises where items don't meet
        return F.transform(x, lambda item: cast(item, have[5:-1], want[5:-1]))
    if have.startswith("list<") or want.startswith("list<"):
        raise UnsupportedType(f"{have} isn't cast to {want}")
    if have in _TEXT or want in _TEXT:
        if have in _TEXT and want in _TEXT:
            return x.cast(spark_type(want))
        raise UnsupportedType(f"{have} isn't cast to {want}")
    if want == "bool":
        return (x != 0) & ~F.isnan(x.cast("double")) if is_float(have) else x != 0
    if have == "bool":
        if is_float(want):
            raise UnsupportedType(f"{have} isn't cast to {want}")
        return x.cast("int").cast(spark_type(want))
    if is_float(have) and is_integer(want):
        return float_to_int(x, want)
    if is_integer(have) and is_integer(want):
        return wrap.to_type(wrap.to_long(x, have), want)
    return x.cast(spark_type(want))


def float_to_int(x: Column, want: str) -> Column:
    """Cut toward zero; null where the result doesn't fit, and for NaN."""
    low, high = bounds(want)
    above = x >= F.lit(float(low)) if want == "i64" else x > F.lit(float(low - 1))  # -2**63 - 1 isn't a double
    whole = F.when(above & (x < F.lit(float(high + 1))), x)
    if want == "u64":
        whole = F.when(whole < 0, 0.0).otherwise(whole)  # a double's halves are exact, its decimal isn't
        high = F.floor(whole / 2.0**32)
        low = (whole - high * 2.0**32).cast("long")
        return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(20,0)")
    return whole.try_cast(spark_type(want))
