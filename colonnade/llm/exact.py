"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACES, cut, numbered


def normalised(text: Column) -> Column:
    """The text without white space, as UTF-8 bytes; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "").cast("binary")


def radix_groups(rows: DataFrame, first_bytes: int = 64, growth: int = 8) -> DataFrame:
    """Rows (rk, doc_id, n, key binary) with an equal key elsewhere, as (rk, doc_id, n, gid): gid names the group.

    Most significant digits first: rows are split by their first bytes, then each group that still has two
    rows or more is split by the bytes that follow, until groups are singletons or their keys have ended.
    Digits get longer from round to round (64 bytes, 512, 4096, ...), so a key of m bytes takes log(m) rounds.
    Groups are compared by the bytes themselves; no digest decides.  A round's groups are counted with map-side
    partial sums, written and numbered; rows then meet their group's number by an equi-join on (group, digit),
    of which both sides are plain tables, so that the planner can split a hot group's rows over many tasks.
    Group tables grow with the corpus and are never broadcast, so the plan is one at every size.
    Singletons leave at once and carry no bytes into the next round.  rk must be one row's alone.
    """
    digit = F.substring("key", 1, first_bytes)
    heads = rows.groupBy(digit.alias("digit")).agg(F.count("*").alias("c")).where("c > 1")
    heads = cut(heads.select("digit", F.monotonically_increasing_id().alias("gid")), "digits")
    active = rows.withColumn("digit", digit).join(heads.hint("merge"), "digit").select("rk", "doc_id", "n", "gid", F.expr(f"substring(key, {first_bytes + 1})").alias("key"))
    active, done, step = cut(active, "radix", heads), None, first_bytes * growth
    while True:
        keyed = active.withColumn("digit", F.substring("key", 1, step))
        groups = keyed.groupBy("gid", "digit").agg(F.count("*").alias("c"), F.max(F.length("key") > step).alias("more")).where("c > 1")
        groups = cut(groups.select("gid", "digit", "more", F.monotonically_increasing_id().alias("next")), "digits")
        split = keyed.join(groups.hint("merge"), ["gid", "digit"]).select("rk", "doc_id", "n", F.col("next").alias("gid"), F.lit(step).alias("step"), "more", F.expr(f"substring(key, {step + 1})").alias("key"))
        split = cut(split, "radix", groups)
        ended = split.where(~F.col("more")).select("rk", "doc_id", "n", F.struct("step", "gid").alias("gid"))  # each round numbers anew
        done = ended if done is None else done.unionByName(ended)
        active = split.where("more").drop("more", "step")
        if active.isEmpty():
            return done
        step = min(step * growth, 1 << 26)


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after deleting white space (U+0020, U+0009 to U+000D); null is
    empty, and empty texts are equal.  Of a group the row with the most code points in its original text
    stays, then the least doc_id; a null doc_id loses ties.  kept says whether a row's doc_id is the one that
    stays, so of rows with one doc_id in one group all are kept or none; group_size counts every row.
    An empty table gives no rows.  Other columns are ignored.  text_sha256 is for the reader; it decides nothing.
    """
    base = numbered(docs, doc_id=F.col(doc_id), text=F.col(text))
    base = base.select("doc_id", "rk", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("key"))
    members = cut(radix_groups(base), "members")
    best = F.max_by("doc_id", F.struct("n", F.bitwise_not(F.col("doc_id"))))
    groups = cut(members.groupBy("gid").agg(F.count("*").alias("group_size"), best.alias("keep_id")), "groups")
    labels = members.select("rk", "gid").join(groups.hint("merge"), "gid").select("rk", "group_size", "keep_id")
    out = base.select("doc_id", "rk", F.sha2("key", 256).alias("text_sha256")).join(labels.hint("merge"), "rk", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256",
    )
