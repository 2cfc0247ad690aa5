"""Integer arithmetic that wraps, under ANSI mode, without decimals: all on longs inside generated code.

Spark raises on overflow; these helpers split numbers in halves so that no step overflows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import bits, is_signed, spark_type

_LOW = (1 << 32) - 1


def _whole(n: int) -> Column:
    """2**n as a decimal."""
    return F.lit(str(1 << n)).cast("decimal(20,0)")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _high(x: Column) -> Column:
    return F.shiftright(x, 32)


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2**64, longs."""
    low = _low(a) + _low(b)
    return _join(_high(a) + _high(b) + _high(low), low)


def neg64(a: Column) -> Column:
    return add64(F.bitwise_not(a), F.lit(1).cast("long"))


def sub64(a: Column, b: Column) -> Column:
    low = _low(a) - _low(b)
    return _join(_high(a) - _high(b) + _high(low), low)


def mul64(a: Column, b: Column) -> Column:
    """a * b modulo 2**64, longs."""
    cross = _low(_high(a) * _low(b)) + _low(_low(a) * _high(b))
    first, second = _low(a) * b.bitwiseAND(F.lit(0xFFFF)), _low(a) * F.shiftright(_low(b), 16)
    return add64(add64(first, F.shiftleft(second, 16)), F.shiftleft(cross, 32))


def to_type(x: Column, name: str) -> Column:
    """A long's low bits as a value of the integer type."""
    n = bits(name)
    if name == "u64":
        d = x.cast("decimal(20,0)")
        return F.when(x < 0, d + _whole(64)).otherwise(d).cast("decimal(20,0)")
    if n == 64:
        return x
    low = x.bitwiseAND(F.lit((1 << n) - 1))
    if is_signed(name):
        low = low.bitwiseXOR(F.lit(1 << n - 1)) - F.lit(1 << n - 1)
    return low.cast(spark_type(name))


def to_long(x: Column, name: str) -> Column:
    """The bits of a value of the integer type as a long."""
    if name == "u64":
        half, whole = _whole(63), _whole(64)
        return F.when(x >= half, x - whole).otherwise(x).cast("long")
    return x.cast("long")


def wrap_decimal(x: Column, name: str) -> Column:
    """A whole decimal of up to 38 digits modulo the type's range."""
    whole = _whole(bits(name)).cast("decimal(38,0)")
    if is_signed(name):
        half = _whole(bits(name) - 1).cast("decimal(38,0)")
        return (F.pmod(x.cast("decimal(38,0)") + half, whole) - half).cast(spark_type(name))
    return F.pmod(x.cast("decimal(38,0)"), whole).cast(spark_type(name))
