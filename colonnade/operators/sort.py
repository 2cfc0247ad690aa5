"""Sorting with explicit null order, top-k, lower bounds, and row keys that compare as bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.cmp import total_order_key

from .position import free_name, running_sum, with_position


@dataclass(frozen=True)
class SortOptions:
    """Ascending with nulls last unless asked otherwise."""

    descending: bool = False
    nulls_first: bool = False

    def reverse(self) -> SortOptions:
        return SortOptions(not self.descending, not self.nulls_first)

    def apply(self, x: Column) -> Column:
        if self.descending:
            return x.desc_nulls_first() if self.nulls_first else x.desc_nulls_last()
        return x.asc_nulls_first() if self.nulls_first else x.asc_nulls_last()


def _order(columns: list[str], options: list[SortOptions] | None, position: str) -> list[Column]:
    options = options or [SortOptions()] * len(columns)
    if len(options) != len(columns):
        raise ValueError(f"{len(columns)} columns and {len(options)} options")
    return [o.apply(F.col(c)) for c, o in zip(columns, options, strict=True)] + [F.col(position).asc()]


def multicol_sort_to_indices(df: DataFrame, columns: list[str], options: list[SortOptions] | None = None, position: str = "_pos") -> DataFrame:
    """Rows (rank, index): the position of the row that comes at each rank; ties by position."""
    ranked = with_position(df.select(*dict.fromkeys([*columns, position])), _order(columns, options, position), "rank")
    return ranked.select("rank", F.col(position).alias("index"))


def sort_to_indices(df: DataFrame, column: str, options: SortOptions | None = None, position: str = "_pos") -> DataFrame:
    return multicol_sort_to_indices(df, [column], [options or SortOptions()], position)


def topk_indices(df: DataFrame, columns: list[str], k: int, options: list[SortOptions] | None = None, position: str = "_pos") -> DataFrame:
    """Rows (rank, index) of the first k rows in order: each task keeps k rows of its own."""
    from pyspark.sql.window import Window

    order = _order(columns, options, position)
    first = df.select(*dict.fromkeys([*columns, position])).orderBy(*order).limit(max(k, 0))
    return first.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("rank"), F.col(position).alias("index"))


def rank(df: DataFrame, column: str, options: SortOptions | None = None) -> DataFrame:
    """df with rank, from 1: rows with equal values share the rank of the last of them."""
    order = [(options or SortOptions()).apply(F.col(column))]
    n, key = (free_name(name, column, "rank", *df.columns) for name in ("_n", "_c"))
    counts = df.groupBy(column).agg(F.count("*").alias(n))
    ranks = running_sum(counts, order, F.col(n), "rank").select(F.col(column).alias(key), "rank")
    return df.join(ranks, df[column].eqNullSafe(F.col(key))).drop(key)


def lower_bound(keys: DataFrame, key: str, values: DataFrame, value: str, options: SortOptions | None = None) -> DataFrame:
    """keys with bound: how many values come before the key in the given order.

    One running sum over the counts of distinct values and keys together (keys before equal values); no range
    join.  Nulls are placed by the options.
    """
    order = (options or SortOptions()).apply
    counts = values.groupBy(F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    asked = keys.select(F.col(key).alias("_x")).distinct()
    both = counts.withColumn("_value", F.lit(1)).unionByName(asked.withColumn("_n", F.lit(0).cast("long")).withColumn("_value", F.lit(0)))
    summed = running_sum(both, [order(F.col("_x")), F.col("_value").asc()], F.col("_n"), "bound").where("_value = 0").select("_x", "bound")
    x = free_name("_x", *keys.columns)
    return keys.join(summed.withColumnRenamed("_x", x), keys[key].eqNullSafe(F.col(x))).drop(x)


def shift(df: DataFrame, column: str, by: int, name: str, position: str = "_pos") -> DataFrame:
    """df with name: the value `by` positions earlier (later where negative), null beyond the ends.  An equi-join on dense positions."""
    at = free_name("_at", name, *df.columns)
    side = df.select((F.col(position) + by).alias(at), F.col(column).alias(name))
    return df.join(side, df[position] == side[at], "left").drop(at)


def _flipped(x: Column) -> Column:
    """All bits of the bytes turned."""
    return F.unhex(F.translate(F.hex(x), "0123456789ABCDEF", "FEDCBA9876543210"))


def normalised_key(x: Column, kind: str, options: SortOptions | None = None) -> Column:
    """Bytes that compare as the values do: a tag for null, then the value.

    Integers are big-endian with the sign bit turned, floats the same of their total order; texts have each zero byte followed by 0xFF and end in two
    zero bytes; descending order turns all bits of the value.
    """
    options = options or SortOptions()
    if kind in ("utf8", "binary"):
        latin = F.decode(x.cast("binary"), "iso-8859-1")
        body = F.concat(F.encode(F.replace(latin, F.lit("\0"), F.lit("\0\xff")), "iso-8859-1"), F.unhex(F.lit("0000")))
    elif kind in ("f16", "f32", "f64"):
        body = F.unhex(F.lpad(F.hex(total_order_key(x.cast("double")).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    elif kind in ("bool", "i8", "i16", "i32", "i64", "u8", "u16", "u32"):
        number = x.cast("int").cast("long") if kind == "bool" else x.cast("long")
        body = F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        raise TypeError(f"no byte key for {kind}; sort by the column itself")
    if options.descending:
        body = _flipped(body)
    valid, null = ("01", "00") if options.nulls_first else ("00", "01")
    return F.when(x.isNull(), F.unhex(F.lit(null))).otherwise(F.concat(F.unhex(F.lit(valid)), body))


def normalize_columns(columns: list[Column], kinds: list[str], options: list[SortOptions] | None = None) -> Column:
    """One key for several columns."""
    options = options or [SortOptions()] * len(columns)
    return F.concat(*[normalised_key(c, k, o) for c, k, o in zip(columns, kinds, options, strict=True)])
