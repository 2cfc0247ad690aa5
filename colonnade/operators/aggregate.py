"""Mergeable grouped aggregates.

A partial table has the group's columns and the aggregates' states; partial tables of parts of the input are
merged by aggregating their union again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.types import UnsupportedType, spark_type, widened

from .position import free_name


@dataclass(frozen=True)
class Aggregate:
    """kind: sum, min, max, count or most_recent, of a column of a logical type; order: for most_recent."""

    kind: str
    name: str
    column: str | None = None
    type: str | None = None
    order: str | None = None

    def ingest(self) -> list[Column]:
        x = F.col(self.column) if self.column else None
        if self.kind == "sum":
            return [grouped_sum(x, self.type).alias(self.name)]
        if self.kind == "count":
            return [count().alias(self.name)]
        if self.kind in ("min", "max"):
            return [(grouped_min if self.kind == "min" else grouped_max)(x, self.type or "i64").alias(self.name)]
        if self.kind == "most_recent":
            return [F.max_by(F.struct(x.alias("value")), self.order).alias(self.name), F.max(self.order).alias(f"{self.name}_order")]
        raise ValueError(f"no aggregate {self.kind}")

    def merge(self, turn: Column | None = None) -> list[Column]:
        """turn numbers the partial tables: of states of most_recent with one order that of the least turn stays."""
        x = F.col(self.name)
        if self.kind in ("sum", "count"):
            kind = spark_type(widened(self.type)) if self.kind == "sum" else "bigint"
            return [F.sum(x).cast(kind).alias(self.name)]
        if self.kind in ("min", "max"):
            return [(F.min if self.kind == "min" else F.max)(x).alias(self.name)]
        order = F.col(f"{self.name}_order")
        return [F.max_by(x, order if turn is None else F.struct(order, -turn)).alias(self.name), F.max(f"{self.name}_order").alias(f"{self.name}_order")]

    def finish(self) -> Column:
        x = F.col(self.name)
        return x["value"].alias(self.name) if self.kind == "most_recent" else x


def grouped_sum(x: Column, kind: str) -> Column:
    """The sum in the widened type; nulls are passed over; 0 for a group without values."""
    wide = spark_type(widened(kind))
    return F.coalesce(F.sum(x.cast(wide)), F.lit(0)).cast(wide)


def _ordered(kind: str) -> None:
    if kind.startswith("list<"):
        raise UnsupportedType(f"no minimum of {kind}")


def grouped_min(x: Column, kind: str) -> Column:
    """The least value, of booleans too; null for a group without values."""
    _ordered(kind)
    return F.min(x)


def grouped_max(x: Column, kind: str) -> Column:
    _ordered(kind)
    return F.max(x)


def count() -> Column:
    """Rows of the group, nulls too."""
    return F.count(F.lit(1))


def most_recent(x: Column, order: Column) -> Column:
    """The value of the row with the greatest order, null if it is null there."""
    return F.max_by(F.struct(x.alias("v")), order)["v"]


def ingest(df: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """The partial table of df."""
    return df.groupBy(*keys).agg(*[c for a in aggregates for c in a.ingest()])


def merge(partials: list[DataFrame], keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """One partial table of several.  Where states of most_recent have one order, that of the first table stays."""
    turn = free_name("turn", *partials[0].columns)
    both = reduce(DataFrame.unionByName, [p.withColumn(turn, F.lit(k)) for k, p in enumerate(partials)])
    return both.groupBy(*keys).agg(*[c for a in aggregates for c in a.merge(F.col(turn))])


def finish(partial: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    return partial.select(*keys, *[a.finish() for a in aggregates])
