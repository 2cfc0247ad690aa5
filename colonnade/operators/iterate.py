"""Values of a column on the driver, one partition at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The Spark type of each kind of value.
KINDS = {"i64": "bigint", "u64": "decimal(20,0)", "u8": "smallint", "f64": "double", "bytes": "binary"}


def iterate(df: DataFrame, column: str, kind: str, position: str = "_pos", nonnull: bool = False, indexed: bool = False) -> Iterator:
    """The column's values in order of position as i64, u64, u8, f64 or bytes; nonnull passes nulls over; indexed gives (position, value)."""
    rows = df.select(F.col(position).alias("p"), F.col(column).cast(KINDS[kind]).alias("v"))
    if nonnull:
        rows = rows.where("v is not null")
    for p, v in rows.orderBy("p").toLocalIterator(prefetchPartitions=True):
        v = int(v) if kind == "u64" and v is not None else bytes(v) if kind == "bytes" and v is not None else v
        yield (p, v) if indexed else v
