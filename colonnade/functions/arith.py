"""Arithmetic that keeps its operands' type: integers wrap, floats follow IEEE 754.

Every function takes the operands' logical types; operands meet in their dominant type.  Null in, null out.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wrap
from .types import UnsupportedType, bits, bounds, dominant_type, is_float, is_integer, is_signed, spark_type


def _meet(left: Column, right: Column, kinds: tuple[str, str]) -> tuple[Column, Column, str]:
    kind = dominant_type(*kinds)
    if not (is_float(kind) or is_integer(kind)):
        raise UnsupportedType(f"no arithmetic on {kind}")
    return _as(left, kinds[0], kind), _as(right, kinds[1], kind), kind


def _as(x: Column, have: str, want: str) -> Column:
    if have == want:
        return x.cast(spark_type(want))
    if is_integer(have) and is_integer(want):
        return wrap.to_type(wrap.to_long(x, have), want)
    return x.cast(spark_type(want))


def _wrapping(left: Column, right: Column, kinds: tuple[str, str], whole, real) -> Column:
    left, right, kind = _meet(left, right, kinds)
    if is_float(kind):
        return real(left, right).cast(spark_type(kind))
    return wrap.to_type(whole(wrap.to_long(left, kind), wrap.to_long(right, kind)), kind)


def _on_lists(op):
    """op on numbers as an operator on lists of numbers, too: item by item; null where the lengths differ."""

    @wraps(op)
    def run(left: Column, right: Column, kinds: tuple[str, str]) -> Column:
        if not any(k.startswith("list<") for k in kinds):
            return op(left, right, kinds)
        item = dominant_type(*kinds)[5:-1]
        if not (is_float(item) or is_integer(item)):
            raise UnsupportedType(f"no arithmetic on list<{item}>")
        return F.when(F.size(left) == F.size(right), F.zip_with(left, right, lambda a, b: op(a, b, (item, item))))

    return run


@_on_lists
def add(left: Column, right: Column, kinds: tuple[str, str]) -> Column:
    return _wrapping(left, right, kinds, wrap.add64, lambda a, b: a + b)


@_on_lists
def sub_wrapping(left: Column, right: Column, kinds: tuple[str, str]) -> Column:
    return _wrapping(left, right, kinds, wrap.sub64, lambda a, b: a - b)


@_on_lists
def mul_wrapping(left: Column, right: Column, kinds: tuple[str, str]) -> Column:
    return _wrapping(left, right, kinds, wrap.mul64, lambda a, b: a * b)


@_on_lists
def div(left: Column, right: Column, kinds: tuple[str, str]) -> Column:
    """Integers divide toward zero; by zero gives null, the least by -1 wraps.  Floats by zero give inf or NaN."""
    left, right, kind = _meet(left, right, kinds)
    if is_float(kind):
        a, b = left.cast("double"), right.cast("double")
        nan, inf = F.lit(float("nan")), F.lit(float("inf"))
        negative = (a < 0) != _negative_zero(b)
        by_zero = F.when((a == 0) | F.isnan(a), nan).when(negative, -inf).otherwise(inf)
        return F.when(b == 0, F.when(a.isNotNull(), by_zero)).otherwise(F.try_divide(a, b)).cast(spark_type(kind))
    if kind == "u64":
        zero = F.lit(0).cast("decimal(20,0)")
        return F.call_function("div", left, F.nullif(right, zero)).cast("decimal(20,0)")
    quotient = F.call_function("div", left.cast("long"), F.nullif(right.cast("long"), F.lit(0).cast("long")))
    if is_signed(kind):
        least = F.lit(bounds(kind)[0]).cast(spark_type(kind))
        edge = (left == least) & (right == -1)
        quotient = F.when(edge, least.cast("long")).otherwise(F.call_function("div", F.when(~edge, left.cast("long")), F.nullif(right.cast("long"), F.lit(0).cast("long"))))
    return quotient.cast(spark_type(kind))


def _negative_zero(x: Column) -> Column:
    """Whether a zero has its sign set."""
    return x.cast("string").startswith("-")


@_on_lists
def rem(left: Column, right: Column, kinds: tuple[str, str]) -> Column:
    """The remainder with the dividend's sign; null for integers by zero, NaN for floats by zero."""
    left, right, kind = _meet(left, right, kinds)
    if is_float(kind):
        out = F.when(right == 0, F.when(left.isNotNull(), F.lit(float("nan")))).otherwise(F.try_mod(left, right))
        return out.cast(spark_type(kind))
    return F.try_mod(left, right).cast(spark_type(kind))


def neg_wrapping(x: Column, kind: str) -> Column:
    if is_float(kind):
        return -x
    if not is_integer(kind):
        raise UnsupportedType(f"no arithmetic on {kind}")
    return wrap.to_type(wrap.neg64(wrap.to_long(x, kind)), kind)


def absolute(x: Column, kind: str) -> Column:
    """abs; the least signed integer is its own."""
    if is_integer(kind) and is_signed(kind):
        return F.when(x < 0, neg_wrapping(x, kind)).otherwise(x)
    if is_integer(kind):
        return x
    if not is_float(kind):
        raise UnsupportedType(f"no arithmetic on {kind}")
    return F.abs(x)


def sqrt(x: Column, kind: str) -> Column:
    """Square root: f32 stays f32, else f64; NaN for negatives."""
    return F.sqrt(x.cast("double")).cast("float" if kind in ("f16", "f32") else "double")


# Declared extensions: fixed-point decimals, bits and shifts.


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def shift_right(a: Column, n: int) -> Column:
    return F.shiftright(a, n)


def byte_swap(x: Column, kind: str) -> Column:
    """An integer of 16, 32 or 64 bits with its bytes in the opposite order."""
    if not is_integer(kind) or bits(kind) == 8:
        raise UnsupportedType(f"no bytes to swap in {kind}")
    long, out = wrap.to_long(x, kind), F.lit(0).cast("long")
    for k in range(bits(kind) // 8):
        byte = F.shiftright(long, 8 * k).bitwiseAND(F.lit(0xFF).cast("long"))
        out = out.bitwiseOR(F.shiftleft(byte, bits(kind) - 8 - 8 * k))
    return wrap.to_type(out, kind)


def splat(x: Column, count: int) -> Column:
    """A list of count times the value; a null value gives null."""
    return F.when(x.isNotNull(), F.array_repeat(x, count))


def multiply_fixed_point(a: Column, b: Column, precision: int, scale: int) -> Column:
    """Decimals multiplied and rounded to a fixed scale; null where the product doesn't fit."""
    return F.try_multiply(a, b).try_cast(f"decimal({precision},{scale})")
