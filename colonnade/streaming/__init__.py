"""The grouped aggregates over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colonnade.operators.aggregate import Aggregate, finish


def aggregate_stream(stream: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """The aggregates' states so far, kept in Spark's state store; for output mode complete or update."""
    return stream.groupBy(*keys).agg(*[c for a in aggregates for c in a.ingest()])


def windowed_stream(stream: DataFrame, time: str, width: str, late: str, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """The aggregates of each window of time; a window is given out once the watermark has passed its end."""
    timed = stream.withWatermark(time, late).withColumn("window", F.window(time, width))
    return timed.groupBy("window", *keys).agg(*[c for a in aggregates for c in a.ingest()])


def write_merged(stream: DataFrame, keys: list[str], aggregates: list[Aggregate], path: str, checkpoint: str) -> StreamingQuery:
    """Each batch's partial table goes to a folder of its own, named by the batch, so a batch that is run again replaces it.

    Read them with read_merged: states merge by aggregating them again.
    """

    def put(batch: DataFrame, number: int) -> None:
        partial = batch.groupBy(*keys).agg(*[c for a in aggregates for c in a.ingest()])
        partial.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_merged(spark, path: str, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    partial = spark.read.parquet(path).drop("batch")
    return finish(partial.groupBy(*keys).agg(*[c for a in aggregates for c in a.merge()]), keys, aggregates)
