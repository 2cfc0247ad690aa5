"""Comparisons, ranges and string predicates.  Null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import dominant_type, is_float, is_integer, spark_type


def _meet(left: Column, right: Column, kinds: tuple[str, str] | None) -> tuple[Column, Column]:
    if kinds is None or kinds[0] == kinds[1]:
        return left, right
    kind = spark_type(dominant_type(*kinds))
    return left.cast(kind), right.cast(kind)


def lt(left: Column, right: Column, kinds: tuple[str, str] | None = None) -> Column:
    left, right = _meet(left, right, kinds)
    return left < right


def lt_eq(left: Column, right: Column, kinds: tuple[str, str] | None = None) -> Column:
    left, right = _meet(left, right, kinds)
    return left <= right


def gt(left: Column, right: Column, kinds: tuple[str, str] | None = None) -> Column:
    left, right = _meet(left, right, kinds)
    return left > right


def gt_eq(left: Column, right: Column, kinds: tuple[str, str] | None = None) -> Column:
    left, right = _meet(left, right, kinds)
    return left >= right


def eq(left: Column, right: Column, kinds: tuple[str, str] | None = None) -> Column:
    left, right = _meet(left, right, kinds)
    return left == right


def neq(left: Column, right: Column, kinds: tuple[str, str] | None = None) -> Column:
    left, right = _meet(left, right, kinds)
    return left != right


def distinct(left: Column, right: Column) -> Column:
    """Inequality in which null is a value like others."""
    return ~left.eqNullSafe(right)


def not_distinct(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def between(x: Column, low: Column, high: Column, kinds: tuple[str, str, str] | None = None) -> Column:
    """Half open: low <= x < high; bounds may be columns.  A null operand gives null, whatever the others say.

    With the operands' logical types, all three meet in their dominant type.
    """
    if kinds is not None and len(set(kinds)) > 1:
        kind = spark_type(dominant_type(dominant_type(kinds[0], kinds[1]), kinds[2]))
        x, low, high = x.cast(kind), low.cast(kind), high.cast(kind)
    # A null x makes both sides null; with literal bounds plain conditions are left, which are pushed down.
    return F.when(low.isNotNull() & high.isNotNull(), (x >= low) & (x < high))


def bounds(x: Column, low: Column, high: Column, kinds: tuple[str, str, str] | None = None) -> Column:
    """Aggregate: whether low <= x < high in all rows; rows with a null are passed over; true of no rows."""
    return F.coalesce(F.bool_and(between(x, low, high, kinds)), F.lit(True))


def compare_lists(compare: Callable[[Column, Column], Column], left: Column, right: Column, item: str) -> Column:
    """Lists of one fixed length and item type by lt, lt_eq, gt, gt_eq, eq or neq; null where a list is null or the lengths differ.

    Lists of numbers are compared item by item, which gives a list of booleans; lists of strings or booleans as
    wholes, in lexicographic order, which gives one boolean.
    """
    out = F.zip_with(left, right, lambda a, b: compare(a, b)) if is_float(item) or is_integer(item) else compare(left, right)
    return F.when(F.size(left) == F.size(right), out)


def in_list(x: Column, values: list) -> Column:
    return x.isin(values)


def starts_with(x: Column, needle: Column) -> Column:
    return F.startswith(x, needle)


def ends_with(x: Column, needle: Column) -> Column:
    return F.endswith(x, needle)


def contains(x: Column, needle: str | bytes) -> Column:
    return F.contains(x, F.lit(needle))


def normalise_pattern(pattern: str, escape: str = "\\") -> str:
    """A LIKE pattern in Spark's dialect.

    The escape may stand before any character; Spark takes it before wildcards and itself alone, so others are
    dropped.  The result's escape is the backslash.  An escape at the end is an error.
    """
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if escape and c == escape:
            at += 1
            if at == len(pattern):
                raise ValueError("a LIKE pattern can't end with its escape")
            c = pattern[at]
            out.append("\\" + c if c in "%_\\" else c)
        else:
            out.append("\\\\" if c == "\\" else c)
        at += 1
    return "".join(out)


def like(x: Column, pattern: str, escape: str = "\\") -> Column:
    """x LIKE pattern; _ is one character."""
    return x.like(normalise_pattern(pattern, escape))


def like_bytes(x: Column, pattern: str, escape: str = "\\") -> Column:
    """x LIKE pattern, where _ is one byte of UTF-8."""
    as_bytes = pattern.encode().decode("iso-8859-1")
    return F.decode(F.encode(x, "utf-8"), "iso-8859-1").like(normalise_pattern(as_bytes, escape))


def compile_string_like(pattern: str, escape: str = "\\") -> Callable[[Column], Column]:
    """A predicate to use again and again."""
    ready = normalise_pattern(pattern, escape)
    return lambda x: x.like(ready)


def nlike(x: Column, pattern: str, escape: str = "\\") -> Column:
    return ~like(x, pattern, escape)


def ilike(x: Column, pattern: str, escape: str = "\\") -> Column:
    return x.ilike(normalise_pattern(pattern, escape))


def eq_ignore_case(x: Column, other: Column) -> Column:
    return F.lower(x) == F.lower(other)


def regexp_is_match(x: Column, pattern: str) -> Column:
    return F.regexp_like(x, F.lit(pattern))


def double_bits(x: Column) -> Column:
    """The bits of a double as a long (all NaNs as the usual one), by arithmetic that is exact."""
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    e = F.when(power(guess) > a, guess - 1).when(power(guess + 1) <= a, guess + 1).otherwise(guess)
    e = F.greatest(F.least(e, F.lit(1023).cast("long")), F.lit(-1022).cast("long"))
    fraction = (a / power(e) - 1) * 2.0**52
    normal = F.shiftleft(e + 1023, 52) + fraction.cast("long")
    small = (a * 2.0**537 * 2.0**537).cast("long")
    usual = F.when(a < 2.0**-1022, small).otherwise(F.when(a <= 1.7976931348623157e308, normal))
    inf, nan = F.lit(0x7FF << 52), F.lit(0x7FF8 << 48)
    bits = F.when(F.isnan(x), nan).when(a == float("inf"), inf).otherwise(usual)
    negative = x.cast("string").startswith("-")
    return F.when(x.isNotNull(), F.when(negative, bits.bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits))


def total_order_key(x: Column) -> Column:
    """A long that orders doubles totally: -0.0 before 0.0, NaN last.  (Spark's own order takes the zeros for equal.)"""
    bits = double_bits(x)
    return F.when(bits < 0, F.bitwise_not(bits).bitwiseOR(F.lit(-(1 << 63)))).otherwise(bits)
