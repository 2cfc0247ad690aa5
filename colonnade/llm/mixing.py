"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import SPACES, cut, numbered, stored

#: Newton steps stop when every source's rates give its target to this relative error.
TOLERANCE = 1e-7
#: Rows of one cell (source, size) that one block ranks.
BLOCK_ROWS = 1024
#: Sizes of one block of the running sums over sizes.
BLOCK_SIZES = 256
#: Starting points of the systematic rounding that are tried for each source.
PHASES = 16
#: Rates are rounded in whole numbers of 1 / UNIT, so that sums of them don't depend on their order.
UNIT = 1 << 28


def word_count(text: Column) -> Column:
    """Number of words; words shrink to one character each, so no list of words is built."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), SPACES, "")).cast("long")


def token_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (source, source_size) to (source, source_size, target).

    Sources by code point, null last, get the weights in turn and share budget times all sizes by weight.  A
    target stops at most times its source's size; the excess is shared by weight among the rest until none is
    above.  The capped sources are those with the least size per weight, so one pass in that order settles all.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    ranked = sources.withColumn("_i", (F.row_number().over(ordered) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") + 1).cast("int"))).drop("_i")
    cap = F.lit(most) * F.col("source_size")
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("_all", F.lit(budget) * F.sum("source_size").over(all_rows))
    ranked = ranked.withColumn("_left", F.col("_all") - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_w", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", F.col("_left") / F.col("_w"))
    ranked = ranked.withColumn("_free", F.col("_level") * F.col("weight") < cap)
    ranked = ranked.withColumn("_fixed", F.min(F.when(F.col("_free"), F.struct(cap / F.col("weight"), F.col("source").isNull().alias("_n"), F.col("source"), F.col("_level")))).over(all_rows)["_level"])
    target = F.when(F.col("_fixed").isNull(), cap).otherwise(F.least(cap, F.col("_fixed") * F.col("weight")))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def tilted(lam: Column, x: Column, most: float) -> Column:
    """most above 1.  The rate of a document with tilt lam and scaled size x: most * p, p the exponentially tilted chance of a copy."""
    z = F.greatest(F.least(lam * x - F.lit(math.log(most - 1)), F.lit(700.0)), F.lit(-700.0))
    return most / (1 + F.exp(-z))


def solve_tilts(cells: DataFrame, targets: DataFrame, most: float = 2.0, steps: int = 60) -> DataFrame:
    """The tilt of each source: (source, lam, scale).

    Among rates in [0, most], those nearest (in relative entropy) to one copy per document that give each
    source its target of tokens are exponentially tilted: rate(size) = most * sigmoid(lam * size / scale + c).
    lam solves the convex dual, one constraint per source.  Each Newton step is one distributed aggregation
    over cells (source, size, n), with sums of decimals, so that reruns agree to the last bit; steps that leave
    the bracket of the root are replaced by bisection.  A source without a solution after `steps` steps raises.
    Targets at the bounds 0 and most * size have no finite tilt; plan_copies sets their rates.
    """
    scale = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("scale"), F.sum("n").alias("all"))
    state = targets.join(scale.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    state = state.where((F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-12)))
    state = state.select("source", "target", "scale", "all", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("over"))
    state = cut(state, "tilts")
    for step in range(steps):
        if state.where("not over").isEmpty():
            return state.select("source", "lam", "scale")
        open_ = state.where("not over")
        x = F.col("size") / F.col("scale")
        rate = tilted(F.col("lam"), x, most)
        share = F.col("n") / F.col("all")
        exact = "decimal(28,18)"  # sums of doubles would depend on the order in which tasks end
        each = cells.where("size > 0").withColumnRenamed("source", "_s").join(open_, F.col("source").eqNullSafe(F.col("_s")))
        sums = each.groupBy("source", "target", "scale", "all", "lam", "lo", "hi").agg(
            F.sum((share * rate * x).cast(exact)).cast("double").alias("g"), F.sum((share * rate * (1 - rate / most) * x * x).cast(exact)).cast("double").alias("h")
        )
        goal = F.col("target") / F.col("scale") / F.col("all")
        gap = F.col("g") - goal
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - gap / F.greatest("h", F.lit(1e-300))
        far = 4.0 * 2 ** max(0, step - 10)
        newton = F.greatest(F.col("lam") - far, F.least(F.col("lam") + far, newton))
        good = F.abs(gap) <= TOLERANCE * goal
        stepped = sums.select("source", "target", "scale", "all", good.alias("over"), newton.alias("to"), "lam", lo.alias("lo"), hi.alias("hi"))
        lam = F.when(F.col("over"), F.col("lam")).when((F.col("to") > F.col("lo")) & (F.col("to") < F.col("hi")), F.col("to")).otherwise((F.col("lo") + F.col("hi")) / 2)
        stepped = stepped.select("source", "target", "scale", "all", lam.alias("lam"), "lo", "hi", "over")
        state = cut(state.where("over").unionByName(stepped), "tilts", state)
    raise RuntimeError(f"the tilts of {state.where('not over').count()} sources were not found in {steps} steps")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes each document (0 to most).

    Rates from the dual are rounded systematically in the order of size: a source's running sum of rates is
    cut at whole numbers, so its copies miss its target by about the gap between neighbouring sizes; of
    PHASES starting points the nearest to the target is used.  Running sums are taken in two levels (blocks of
    sizes, blocks of rows) so that no task gets a whole source.  Rates are rounded to whole numbers of 1 / UNIT
    and summed exactly.  Rows are ranked by a hash of keys, source and size, so reruns agree, also over other
    partitions; rows that are equal in all of these are interchangeable.  Null text has size 0; a document of
    size 0 adds no tokens and is taken once.  Null is a source of its own; an empty table gives no rows.
    Columns of docs with the names of the four are replaced.
    """
    docs = stored(docs)
    size = word_count(F.col("text"))
    slim = numbered(docs, source=F.col("source"), size=size, r=F.xxhash64(*keys, "source", size))
    placed = plan_copies(slim, weights, budget, most).select("rk", "size", "source_size", "target", "copies")
    added = ("size", "source_size", "target", "copies")
    rows = numbered(docs, row=F.struct(*docs.columns))
    return rows.join(placed, "rk").select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def plan_copies(slim: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """slim (rk, source, size, r, ...) with source_size, target and copies added."""
    slim = cut(slim, "sizes")  # words are counted once
    cells = cut(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = cut(token_targets(sources, weights, budget, most), "targets")
    tilts = cut(solve_tilts(cells, targets, most), "solved")
    known = targets.join(tilts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    rate = F.when(full, F.lit(float(most))).when(F.col("target") <= 0, 0.0).otherwise(tilted(F.col("lam"), F.col("size") / F.col("scale"), most))
    rate = F.round(rate * UNIT).cast("long").alias("rate")
    cells = cells.where("size > 0").withColumnRenamed("source", "_s").join(known, F.col("source").eqNullSafe(F.col("_s"))).select("source", "size", "n", "source_size", "target", rate)
    # Running sums of rates over sizes: within blocks of sizes, then over blocks.
    whole = "decimal(38,0)"
    cells = cells.withColumn("mass", (F.col("n").cast("decimal(19,0)") * F.col("rate").cast("decimal(19,0)")).cast(whole)).withColumn("block", F.floor(F.col("size") / BLOCK_SIZES))
    inner = Window.partitionBy("source", "block").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("inside", F.coalesce(F.sum("mass").over(inner).cast(whole), F.lit(0).cast(whole)))
    blocks = cells.groupBy("source", "block").agg(F.sum("mass").cast(whole).alias("m"))
    outer = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.coalesce(F.sum("m").over(outer).cast(whole), F.lit(0).cast(whole)).alias("outside"))
    cells = cells.join(blocks, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    # Of where a cell starts only the part beyond a whole copy matters.
    start = F.pmod((F.col("inside") + F.col("outside")).cast(whole), F.lit(UNIT).cast(whole)).cast("long").alias("start")
    cells = cut(cells.select("source", "size", "n", "rate", "source_size", "target", start), "starts")

    def copies_to(j: Column, phase: Column) -> Column:
        """Whole copies up to the cell's j-th row."""
        return F.shiftright(F.col("start") + phase + j * F.col("rate"), UNIT.bit_length() - 1)

    # The starting point that brings each source nearest to its target.
    phases = [p * UNIT // PHASES for p in range(PHASES)]
    none = F.lit(0).cast("long")
    tried = [F.sum(F.col("size") * (copies_to(F.col("n"), F.lit(p)) - copies_to(none, F.lit(p)))).alias(f"p{k}") for k, p in enumerate(phases)]
    tried = cells.groupBy("source", "target").agg(*tried)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"p{k}") - F.col("target")).alias("gap"), F.lit(p).cast("long").alias("phase")) for k, p in enumerate(phases)]))["phase"]
    tried = tried.select(F.col("source").alias("_s"), nearest.alias("phase"))
    cells = cells.join(tried, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Ranks in a cell: within blocks of rows, then over the cell's blocks.
    cells = cells.withColumnsRenamed({"source": "_s", "size": "_z"})
    rows = slim.where("size > 0").join(cells, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).drop("_s", "_z")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("r"), F.ceil(F.col("n") / BLOCK_ROWS).cast("long")))
    parts = rows.groupBy("source", "size", "part").agg(F.count("*").alias("c"))
    ahead = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("part").alias("_p"), F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "size", "part").orderBy("r", "rk")
    rows = rows.withColumn("j", F.row_number().over(within))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("part") == F.col("_p")))
    j = (F.col("ahead") + F.col("j")).cast("long")
    copies = F.least(copies_to(j, F.col("phase")) - copies_to(j - 1, F.col("phase")), F.lit(int(most)))
    rows = rows.select(*slim.columns, "source_size", "target", copies.cast("long").alias("copies"))
    empty = slim.where("size = 0").join(targets.withColumnsRenamed({"source": "_s"}), F.col("source").eqNullSafe(F.col("_s")))
    return rows.unionByName(empty.select(*slim.columns, "source_size", "target", F.lit(1).cast("long").alias("copies")))
