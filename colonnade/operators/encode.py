"""Dictionary and run-end encodings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.types import bounds, spark_type

from .position import with_position


def dictionary(df: DataFrame, column: str, position: str = "_pos", kind: str = "i64") -> DataFrame:
    """Rows (key, value): distinct values, numbered from 0 in the order in which they come first; null has none.

    kind is the keys' integer type.  All its numbers from 0 on may be keys (256 of u8); one value more raises.
    """
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(position).alias("_first"))
    numbered = with_position(firsts, [F.col("_first")], "key").select("key", F.col(column).alias("value"))
    if kind == "i64":
        return numbered
    full = F.raise_error(F.lit(f"more values than {kind} has keys")).cast("long")
    key = F.when(F.col("key") <= F.lit(bounds(kind)[1]), F.col("key")).otherwise(full)
    return numbered.select(key.cast(spark_type(kind)).alias("key"), "value")


def dictionary_encode(df: DataFrame, column: str, position: str = "_pos", kind: str = "i64") -> tuple[DataFrame, DataFrame]:
    """(rows (position, key), dictionary)."""
    values = dictionary(df, column, position, kind)
    keys = df.select(position, column).join(values, F.col(column) == F.col("value"), "left").select(position, "key")
    return keys, values


def dictionary_decode(keys: DataFrame, values: DataFrame) -> DataFrame:
    return keys.join(values, "key", "left").drop("key")


def run_length_encode(df: DataFrame, column: str, position: str = "_pos") -> DataFrame:
    """Rows (run_end, value): runs of equal neighbours (nulls are equal), run_end the position after the run.

    Neighbours meet by an equi-join on dense positions; ends of runs are then all that is left.
    """
    rows = df.select(F.col(position).alias("_p"), F.col(column).alias("value"))
    after = rows.select((F.col("_p") - 1).alias("_p"), F.col("value").alias("_next"), F.lit(True).alias("_has"))
    ends = rows.join(after, "_p", "left").where(F.col("_has").isNull() | ~F.col("value").eqNullSafe(F.col("_next")))
    return ends.select((F.col("_p") + 1).alias("run_end"), "value")


def run_length_decode(runs: DataFrame) -> DataFrame:
    """Rows (position, value) of a run-end table; a run's rows are made where the run is."""
    ordered = with_position(runs, [F.col("run_end")], "_k")
    previous = ordered.select((F.col("_k") + 1).alias("_k"), F.col("run_end").alias("_from"))
    both = ordered.join(previous, "_k", "left").withColumn("_from", F.coalesce("_from", F.lit(0).cast("long")))
    return both.select(F.explode(F.sequence("_from", F.col("run_end") - 1)).alias("_pos"), "value")

