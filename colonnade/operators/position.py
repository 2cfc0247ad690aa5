"""Row positions and running sums over a whole table, without gathering it in one task."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def free_name(name: str, *taken: str) -> str:
    """The name, with as many underscores as it takes to be none of the others (case aside)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where all runs in one process (tests) and spark.checkpoint.dir is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="colonnade-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the shared folder is the cluster's to clear
        pass


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; so what depends on partitions is fixed once and for all.

    The table is removed when the driver's process ends.
    """
    path = f"{shared_dir(df.sparkSession)}/colonnade-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with name: the sum of value over the rows up to this one in the given total order.

    Rows are range partitioned by the order and written with their partition's number; sums run within
    partitions, and each partition starts from the sum of those before it (one row per partition).
    A column of df with that name is replaced; no other is touched.
    """
    v, part, inner, outer = (free_name(n, name, *df.columns) for n in ("_v", "_part", "_i", "_o"))
    ranged = df.withColumn(v, value).repartitionByRange(*order)
    ranged = written(ranged.withColumn(part, F.spark_partition_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(part).agg(F.sum(v).alias("s")).select(part, F.coalesce(F.sum("s").over(before), F.lit(0)).alias(outer))
    inside = F.sum(v).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ranged.withColumn(inner, inside).join(offsets, part)
    return out.withColumn(name, F.col(inner) + F.col(outer)).drop(v, part, inner, outer)


def with_position(df: DataFrame, order: list[Column], name: str = "_pos") -> DataFrame:
    """df with dense positions from 0 in the given total order."""
    rank = free_name("_rank", name, *df.columns)
    return running_sum(df, order, F.lit(1).cast("long"), rank).withColumn(name, F.col(rank) - 1).drop(rank)
