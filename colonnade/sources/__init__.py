"""Tables to read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet table, of which only the given columns are scanned."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Scatter rows to one folder per partition id."""
    df.write.partitionBy(partition).parquet(path)
