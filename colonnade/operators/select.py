"""Positional selection: take, filter, concat, interleave, partition.

Arrays are tables with a position column; a table that is split by source has a source column, too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .position import free_name, running_sum


def _checked(found: Column, index: Column, what: str) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"{what} out of bounds: "), F.coalesce(index.cast("string"), F.lit("null"))))
    return F.when(found.isNotNull(), F.lit(True)).otherwise(bad.cast("boolean"))


def take(data: DataFrame, indices: DataFrame, index: str, data_position: str = "_pos") -> DataFrame:
    """Each row of indices with the row of data at that position; null and unknown positions raise.

    An equi-join: the planner broadcasts the smaller side or shuffles both; hot indices may be split.
    """
    found, at = (free_name(n, *data.columns, *indices.columns) for n in ("_found", "_at"))
    side = data.withColumn(found, F.lit(1)).withColumnRenamed(data_position, at)
    out = indices.join(side, indices[index].cast("long") == F.col(at), "left")
    return out.where(_checked(F.col(found), indices[index], "index")).drop(found, at)


def filter_(data: DataFrame, mask: Column) -> DataFrame:
    """Rows whose mask is true; a null mask drops its row."""
    return data.where(mask)


def concat(parts: list[DataFrame], source: str = "src") -> DataFrame:
    """All rows of tables with one schema; source numbers the tables, so (source, position) is the order."""
    if not parts:
        raise ValueError("nothing to concatenate")
    return reduce(DataFrame.unionByName, [p.withColumn(source, F.lit(k)) for k, p in enumerate(parts)])


def interleave(parts: list[DataFrame], indices: DataFrame, array: str = "a", index: str = "i", data_position: str = "_pos") -> DataFrame:
    """Each row of indices (array, index) with that array's row at that position; unknown ones raise."""
    kinds = {tuple(sorted((f.name, f.dataType.simpleString()) for f in p.schema)) for p in parts}
    if len(kinds) != 1:
        raise TypeError("arrays of different types can't be interleaved")
    found, at, src = (free_name(n, *parts[0].columns, *indices.columns) for n in ("_found", "_at", "_src"))
    side = concat(parts, src).withColumn(found, F.lit(1)).withColumnRenamed(data_position, at)
    out = indices.join(side, (indices[array] == F.col(src)) & (indices[index].cast("long") == F.col(at)), "left")
    return out.where(_checked(F.col(found), indices[index], "index")).drop(found, at, src)


def merge(mask: DataFrame, truthy: DataFrame, falsy: DataFrame, flag: str, position: str = "_pos") -> DataFrame:
    """Rows of truthy and falsy in turn: where flag is true the next of truthy, else the next of falsy."""
    counted = running_sum(mask, [F.col(position)], F.col(flag).cast("long"), "_t")
    counted = counted.select(position, F.when(F.col(flag), 0).otherwise(1).alias("_a"), F.when(F.col(flag), F.col("_t") - 1).otherwise(F.col(position) - F.col("_t")).alias("_i"))
    return interleave([truthy, falsy], counted, "_a", "_i", position).drop("_a", "_i")


def partition(data: DataFrame, part: Column, name: str = "part", spread: int = 8) -> DataFrame:
    """data with its partition's number; null numbers raise.

    One exchange puts each partition's rows together, in up to `spread` tasks, by a hash of the row, so that no
    task gets all of a large partition.
    """
    bad = F.raise_error(F.lit("null partition number")).cast("long")
    return data.withColumn(name, F.coalesce(part.cast("long"), bad)).repartition(F.col(name), F.pmod(F.xxhash64(*data.columns), F.lit(spread)))


def partitions(data: DataFrame, part: Column, count: int) -> list[DataFrame]:
    """The partitions 0 to count - 1 as tables; those without rows are empty."""
    return [data.where(part == k) for k in range(count)]
