"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm._shared import cut
from colonnade.llm.decontam import decontaminate
from colonnade.llm.jaccard import keep_one
from colonnade.llm.mixing import mix
from colonnade.llm.sharding import shard
from colonnade.llm.toxicity import fit, score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below their language's threshold.

    Texts are read whole, however long.  Null and empty texts get the score of no words; a null lang has the
    threshold 0.5.  Equal rows share their fate.  Other columns are kept, whatever their names; an empty table
    gives no rows.  Without labels of both kinds nothing is rejected.
    """
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select("text", "lang", F.struct(*docs.columns).alias("row"))
    return score(packed, net).where("score < threshold").select("row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, similarity 0.8).

    That of the least doc_id stays (null last), of rows with one doc_id the first in the files.  Null texts and
    texts without words are copies of each other, so one of them stays.  Other columns are kept, whatever their
    names; an empty table gives no rows.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item (word edits up to 0.2 of its words).

    Each row is judged by its own whole text; null and empty texts and items match nothing, and equal rows share
    their fate.  Other columns are kept, whatever their names; an empty table gives no rows.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    A null or empty text has no words and is taken once; a null source is a source of its own.  Rows equal in
    doc_id, source and size are interchangeable.  Other columns are kept, whatever their names; an empty table
    gives no rows.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    return mix(packed).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard (0 to 39) and slot.

    Nulls, empty and long texts and equal rows are dealt like others.  Columns named shard and slot are
    replaced, others kept, whatever their names; an empty table gives no rows.
    """
    return shard(docs, 40)


STAGES = [("toxicity", toxicity), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
