"""Reductions of whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.functions import wrap
from colonnade.functions.types import UnsupportedType, bounds, is_float, is_integer, spark_type

#: Values multiplied by one task at a time.
BLOCK = 1024


def _ordered(kind: str) -> None:
    if kind == "bool" or kind.startswith("list<"):
        raise UnsupportedType(f"no minimum of {kind}")


def minimum(x: Column, kind: str) -> Column:
    """Nulls are passed over; null of no values."""
    _ordered(kind)
    return F.min(x)


def maximum(x: Column, kind: str) -> Column:
    _ordered(kind)
    return F.max(x)


def total(x: Column, kind: str) -> Column:
    """The sum in the column's own type: integers wrap.  Null of no values."""
    if is_integer(kind):
        return wrap.wrap_decimal(F.sum(x.cast("decimal(20,0)")), kind)
    if is_float(kind):
        return F.sum(x.cast("double")).cast(spark_type(kind))
    raise UnsupportedType(f"{kind} can't be summed")


def checked_total(x: Column, kind: str) -> Column:
    """The sum, null where it doesn't fit the type."""
    return F.sum(x.cast("decimal(20,0)")).try_cast(spark_type(kind))


def product(df: DataFrame, column: str, kind: str, name: str = "product") -> DataFrame:
    """One row: the product in the column's own type; integers wrap.  Nulls are passed over; null of no values.

    Integers are multiplied in blocks of BLOCK values, then blocks of blocks, until one is left.
    """
    x = F.col(column)
    if is_float(kind):
        return df.agg(F.product(x.cast("double")).cast(spark_type(kind)).alias(name))
    if not is_integer(kind):
        raise UnsupportedType(f"{kind} can't be multiplied")
    state = df.where(x.isNotNull()).select(wrap.to_long(x, kind).alias("_x"))
    left = state.count()
    one = F.lit(1).cast("long")
    while True:
        block = F.floor(F.monotonically_increasing_id() / BLOCK) if left > BLOCK else F.lit(0)
        state = state.groupBy(block.alias("_b")).agg(F.aggregate(F.collect_list("_x"), one, wrap.mul64).alias("_x")).select("_x")
        if left <= BLOCK:
            break
        from .position import written

        state = written(state.coalesce(max(1, left // (BLOCK * BLOCK))))
        left = state.count()
    if left:
        return state.select(wrap.to_type(F.col("_x"), kind).alias(name))
    return df.limit(0).agg(F.max(F.lit(0)).cast(spark_type(kind)).alias(name))


def checked_product(df: DataFrame, column: str, kind: str, name: str = "product") -> DataFrame:
    """One row: the exact product, null where it doesn't fit the integer type.  Nulls are passed over; null of no values.

    Floats are multiplied as product() does.  Of integers, zeros and signs are counted; 65 factors of two or more
    exceed every type, so 65 of them tell the whole product.  Magnitudes are multiplied, which never shrink, so no
    partial product overflows alone.
    """
    if not is_integer(kind):
        return product(df, column, kind, name)
    low, high = bounds(kind)
    whole = "decimal(38,0)"
    x = F.abs(F.col(column).cast("decimal(20,0)")).cast(whole)
    facts = df.agg(F.count(column).alias("_n"), F.count_if(x == 0).alias("_zeros"), F.count_if(F.col(column) < 0).alias("_minus"))
    few = df.where(x > 1).select(x.alias("_x")).limit(65)
    # A product beyond 38 digits is null, and so is all that follows.
    size = few.agg(F.aggregate(F.collect_list("_x"), F.lit(1).cast(whole), lambda a, b: F.try_multiply(a, b).try_cast(whole)).alias("_size"))
    signed = F.when(F.col("_zeros") > 0, F.lit(0).cast(whole)).when(F.col("_minus") % 2 == 1, -F.col("_size")).otherwise(F.col("_size"))
    fits = (F.col("_n") > 0) & signed.between(F.lit(str(low)).cast(whole), F.lit(str(high)).cast(whole))
    return facts.crossJoin(size).select(F.when(fits, signed).try_cast(spark_type(kind)).alias(name))


def argmin(x: Column, position: Column) -> Column:
    """The first position of the least value; nulls are passed over; null of no values."""
    return F.min_by(F.when(x.isNotNull(), position), F.when(x.isNotNull(), F.struct(x, position)))


def argmax(x: Column, position: Column) -> Column:
    """The first position of the greatest value."""
    return F.max_by(F.when(x.isNotNull(), position), F.when(x.isNotNull(), F.struct(x, -position)))


def bit_and(x: Column) -> Column:
    return F.bit_and(x)


def bit_or(x: Column) -> Column:
    return F.bit_or(x)


def bit_xor(x: Column) -> Column:
    return F.bit_xor(x)


def bool_and(x: Column) -> Column:
    return F.bool_and(x)


def bool_or(x: Column) -> Column:
    return F.bool_or(x)


def approx_max_run_length(df: DataFrame, column: str, position: str = "_pos", most: int = 8192) -> DataFrame:
    """One row: the longest run of equal values among the first `most` neighbours; a null ends a run; 1 of fewer than two rows.

    It looks at the table's first rows only: that is the operator (a cheap hint), not a cap.
    """
    first = df.select(F.col(column).alias("x"), F.col(position).alias("p")).orderBy("p").limit(most + 1)
    w = Window.orderBy("p")
    new = first.withColumn("new", F.coalesce(~(F.col("x") == F.lag("x").over(w)), F.lit(True)).cast("long"))
    runs = new.withColumn("run", F.sum("new").over(w)).groupBy("run").agg(F.count("*").alias("n"))
    return runs.agg(F.coalesce(F.max("n"), F.lit(1)).cast("long").alias("run_length"))
