"""Helpers that the operators of this subpackage share: tables in the shared folder, rows' names, components."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and all runs in one process (tests), a temporary folder.

    On a cluster without the setting this raises: executors wouldn't see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colonnade-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the shared folder is the cluster's to clear
        pass


#: After so many tables the driver collects its garbage.
COLLECT_EVERY = 8
_tables = itertools.count(1)


def drop_finished(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and broadcasts of finished plans: it does when the driver's collector finds them unused."""
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame, name: str, done: DataFrame | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs a read of that table.  The table's size is known, so the
    planner sees whether it may be broadcast.  It is removed when the driver's process ends.  done is an
    earlier result of cut() that nothing but df reads: it is removed as soon as df is written.

    Loops that write make many plans, so drop_finished() runs after every COLLECT_EVERY tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/colonnade-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if done is not None:
        _remove(spark, done._written)
    if next(_tables) % COLLECT_EVERY == 0:
        drop_finished(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


#: Plan nodes over a scan that keep each of its rows at most once.
_ROW_BY_ROW = ("Project", "Filter", "SubqueryAlias", "View")


def _scans_parquet(df: DataFrame) -> bool:
    """Whether df is a scan of Parquet files with projections and filters alone, all of them deterministic."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.getClass().getSimpleName() in _ROW_BY_ROW:
        node = node.children().head()
    if node.getClass().getSimpleName() != "LogicalRelation":
        return False
    relation = node.relation()
    return relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().toString() == "Parquet"


def stored(docs: DataFrame) -> DataFrame:
    """docs where it is a plain scan of Parquet files, else docs written to the shared folder: two scans see the same rows."""
    return docs if _scans_parquet(docs) else cut(docs, "rows")


def numbered(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns of docs, and rk, which names the row: (f, i), the hash of its file's path and its number in the file.

    Every scan of the result gives a row the same rk, whatever the partitions or lost tasks, and no two rows
    share one: the paths' hashes are compared on the driver, which holds the list of files as it is.  Where docs
    isn't a plain scan of Parquet files (a join, a generated table), its columns are written first, and the
    rows of that table are numbered.
    """
    rows = docs.select(*[c.alias(name) for name, c in columns.items()])
    if not _scans_parquet(docs):
        rows = docs = cut(rows, "rows")
        columns = {name: F.col(name) for name in columns}
    files = [p.replace(":///", ":/", 1) for p in docs.inputFiles()]
    if len({xxhash.xxh64_intdigest(p, seed=42) for p in files}) < len(set(files)):
        raise RuntimeError("two files' paths have one hash; copy one of them to another name")
    meta = docs.metadataColumn("_metadata")
    rk = F.struct(F.xxhash64(meta["file_path"]).alias("f"), meta["row_index"].alias("i"))
    return docs.select(*[c.alias(name) for name, c in columns.items()], rk.alias("rk"))


#: rk in Arrow and in a schema string.
RK = pa.struct([("f", pa.int64()), ("i", pa.int64())])
RK_SQL = "struct<f:bigint,i:bigint>"


#: Bytes of an Arrow batch between the JVM and Python; texts are long, and each side holds a batch or two.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow with batches of about BATCH_BYTES, unless the session asks for smaller ones; a longer text is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def _stars(edges: DataFrame) -> bool:
    """Whether edges (a, b), a above b, are stars: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("root").alias("root"))
    return nodes.where(F.col("ups") + F.col("root") > 1).agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of edges (a, b), longs: rows (node, root), root the least node of the component.

    Alternates large-star and small-star rounds (Kiveris et al. 2014) until the edges are stars, which a round
    wouldn't change.  Every round is a join and an aggregation, each written to the shared folder; no component
    is gathered in one task.
    An empty edge table gives no rows; loops and repeated edges do no harm; nulls are dropped.
    """
    state = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    state = cut(state.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(state):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        state = cut(small.where("a <> b").distinct(), "edges", state)
    leaves = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return cut(leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct()), "roots")
