"""Uniform sharding by a hypergeometric communication matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import cut, numbered, stored

#: Rows of a source block: small tables have blocks of LEAST_ROWS; from LEAST_ROWS ** 2 rows on blocks grow, up to
#: MOST_ROWS, and beyond MOST_ROWS * LEAST_ROWS rows their number does.
LEAST_ROWS, MOST_ROWS = 4096, 65536
#: Rows of one range of random keys in the second permutation.
RANGE_ROWS = 4096


def _uniform(*parts: str) -> str:
    """SQL of a number in (0, 1) that depends on parts alone."""
    return f"((pmod(xxhash64({', '.join(parts)}), 9007199254740992) + 0.5D) / 9007199254740992D)"


def _hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL of the number of marked ones among drawn of total, without replacement, by inversion of its law at u.

    Weights follow from one count to the next by their exact ratio; they are summed over ten standard
    deviations around the mode, beyond which their share is below what a double resolves.
    """
    inner = """
      transform(array(named_struct('p', P, 'a', cast(A as bigint), 'b', cast(B as bigint))), s ->
        transform(array(aggregate(sequence(s.a, s.b), named_struct('w', 1e-300D, 't', 0D),
                                  (z, k) -> named_struct('w', z.w * RATIO, 't', z.t + z.w), z -> z.t)), goal ->
          aggregate(sequence(s.a, s.b), named_struct('w', 1e-300D, 't', 0D, 'k', -1L),
                    (z, k) -> named_struct('w', z.w * RATIO, 't', z.t + z.w, 'k', if(z.k < 0 and z.t + z.w >= s.p.u * goal, k, z.k)),
                    z -> if(z.k < 0, s.b, z.k)))[0])[0]"""
    ratio = "(cast(s.p.m - k as double) * (s.p.n - k) / ((k + 1D) * (s.p.g - s.p.m - s.p.n + k + 1D)))"
    spread = "(ceil(10 * sqrt(greatest(0D, p.n * (p.m / greatest(p.g, 1D)) * (1 - p.m / greatest(p.g, 1D)) * (p.g - p.n) / greatest(p.g - 1D, 1D)))) + 20)"
    mode = "floor((p.n + 1D) * (p.m + 1D) / (p.g + 2D))"
    low, high = "greatest(0L, p.n - (p.g - p.m))", "least(p.n, p.m)"
    inner = inner.replace("RATIO", ratio).replace("P,", "p,").replace("A as", f"least(greatest({low}, {mode} - {spread}), {high}) as").replace("B as", f"greatest(least({high}, {mode} + {spread}), {low}) as")
    return f"transform(array(named_struct('g', {total}, 'm', {marked}, 'n', {drawn}, 'u', {u})), p -> {inner})[0]"


def _draw(rest: str, taken: str, total: str, seed: int) -> str:
    """SQL of how taken rows of total fall to shards of the sizes in rest: a multivariate hypergeometric draw."""
    one = _hypergeometric("z.g", f"element_at({rest}, i)", "z.n", _uniform(str(seed), "first", "size(counts)", "i"))
    return f"""aggregate(sequence(1, size({rest})), named_struct('g', {total}, 'n', {taken}, 'out', cast(array() as array<bigint>)),
      (z, i) -> transform(array({one}), x -> named_struct('g', z.g - element_at({rest}, i), 'n', z.n - x, 'out', concat(z.out, array(x))))[0], z -> z.out)"""


def communication_matrix(counts: DataFrame, blocks: int, sizes: list[int], seed: int = 0) -> DataFrame:
    """Rows (block, c) to rows (block, starts): a random matrix of counts with the given margins.

    counts gives each source block's rows, sizes each shard's.  The matrix has exactly the law of the counts
    that a uniform permutation of all rows gives.  It is drawn by halving: the rows of the left half of the
    blocks fall to the shards by a multivariate hypergeometric draw, the rest to the right half, and so on.
    starts[s] is the rank in the block at which shard s begins.
    """
    spark = counts.sparkSession
    every = spark.range(blocks).select(F.col("id").alias("block")).join(counts, "block", "left")
    every = every.agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce("c", F.lit(0)).cast("long").alias("c")))).alias("all"))  # one number for each block
    node = every.select(F.lit(0).alias("first"), F.expr("transform(all, x -> x.c)").alias("counts"), F.array(*[F.lit(x).cast("long") for x in sizes]).alias("rest"))
    for level in range(math.ceil(math.log2(max(blocks, 1)))):
        half = "cast(ceil(size(counts) / 2) as int)"
        total = "aggregate(counts, 0L, (s, x) -> s + x)"
        left = f"aggregate(slice(counts, 1, {half}), 0L, (s, x) -> s + x)"
        node = node.withColumn("got", F.when(F.size("counts") > 1, F.expr(_draw("rest", left, total, seed))))
        node = node.select(F.explode(F.expr(f"""if(size(counts) > 1,
            array(named_struct('first', first, 'counts', slice(counts, 1, {half}), 'rest', got),
                  named_struct('first', first + {half}, 'counts', slice(counts, {half} + 1, size(counts)), 'rest', zip_with(rest, got, (a, b) -> a - b))),
            array(named_struct('first', first, 'counts', counts, 'rest', rest)))""")).alias("n")).select("n.*")
        if level == 5:
            node = node.repartition(64, "first")
    starts = "aggregate(rest, named_struct('s', 0L, 'out', cast(array() as array<bigint>)), (z, x) -> named_struct('s', z.s + x, 'out', concat(z.out, array(z.s))), z -> z.out)"
    return node.select(F.col("first").cast("long").alias("block"), F.expr(starts).alias("starts"))


def source_blocks(total: int) -> int:
    """Source blocks for so many rows, each of MOST_ROWS rows at most, about."""
    return max(1, math.ceil(total / min(MOST_ROWS, max(LEAST_ROWS, total // LEAST_ROWS))))


def number_equal(rows: DataFrame, key: list[str], parts: int) -> DataFrame:
    """rows, each with its own rk, with _1 and _2, two hashes of the key, and _n, the row's number among those with its key.

    Rows of one key are dealt to parts by a hash of rk and numbered there, behind the rows of the parts before;
    so no task gets a whole key.  Which of the equal rows gets which number depends on rk.
    """
    rows = rows.withColumn("_1", F.xxhash64(F.lit(1), *key)).withColumn("_2", F.xxhash64(F.lit(2), *key)).withColumn("_q", F.pmod(F.xxhash64("rk"), F.lit(parts)))
    before = Window.partitionBy("_1", "_2").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("_1", "_2", "_q").agg(F.count("*").alias("c")).select("_1", "_2", "_q", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_o"))
    inside = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_1", "_2", "_q").orderBy("rk")))
    return inside.join(ahead, ["_1", "_2", "_q"]).withColumn("_n", F.col("_n") + F.col("_o")).drop("_q", "_o")


def deal(rows: DataFrame, key: list[str], shards: int = 40, seed: int = 0) -> DataFrame:
    """rows, each with its own rk, with shard (0 to shards - 1) and slot (place in the shard, gapless from 0): a uniform shuffle.

    Shards' counts differ by one at most.  Rows are put into source blocks by a hash; the communication matrix
    says how many of each block's rows go to each shard; each block permutes its rows locally and deals them
    out; each shard permutes what it has got.  Permutations sort by hashes of seed, key and the row's number
    among the rows with its key, so reruns agree, over other partitions too, but for which of the rows with one
    key gets which of their places.  Rows with one key are spread like others.  Ranks are taken in blocks of
    about MOST_ROWS rows at most and in ranges of about RANGE_ROWS, never in a whole shard; the matrix has one
    row for each block, and the planner broadcasts it only while it is small.  Nulls are keys like others; an
    empty table gives no rows.
    """
    names = [c for c in rows.columns if c != "rk"]
    total = rows.count()
    blocks = source_blocks(total)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    slim = number_equal(rows, key, blocks).withColumn("_k", F.xxhash64("_1", "_n")).withColumn("_l", F.xxhash64("_2", "_n")).drop("_1", "_2", "_n")
    slim = cut(slim.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), "_k"), F.lit(blocks))), "blocks")
    matrix = cut(communication_matrix(slim.groupBy(F.col("_b").alias("block")).agg(F.count("*").alias("c")), blocks, sizes, seed), "matrix")
    local = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), "_k"), "_l")
    dealt = slim.withColumn("_j", F.row_number().over(local) - 1)
    dealt = dealt.join(matrix.withColumnRenamed("block", "_b"), "_b")
    dealt = dealt.withColumn("shard", F.expr("size(filter(starts, x -> x <= _j)) - 1")).drop("starts", "_j", "_b")
    # Second permutation: ranges of a random key, ranked each on its own, behind the ranges before them.
    ranges = max(1, math.ceil(total / shards / RANGE_ROWS))
    dealt = dealt.withColumn("_r", F.xxhash64(F.lit(seed + 2), "_k"))
    dealt = cut(dealt.withColumn("_p", F.floor((F.col("_r") / F.lit(2.0**64) + 0.5) * ranges).cast("int")), "dealt")
    before = Window.partitionBy("shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = dealt.groupBy("shard", "_p").agg(F.count("*").alias("c")).select("shard", "_p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("ahead"))
    slot = F.row_number().over(Window.partitionBy("shard", "_p").orderBy("_r", "_l")) - 1
    return dealt.withColumn("_i", slot).join(ahead, ["shard", "_p"]).select(*names, "rk", "shard", (F.col("_i") + F.col("ahead")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 0) -> DataFrame:
    """docs with shard and slot, as by deal(): places are dealt to the rows' names, and the rows are shuffled once, to meet them.

    Columns of docs with the names shard and slot are replaced.
    """
    docs = stored(docs)
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    row = F.struct(*names)
    places = deal(numbered(docs, _h=F.xxhash64(F.lit(3), row), _i=F.xxhash64(F.lit(4), row)), ["_h", "_i"], shards, seed)
    return numbered(docs, row=row).join(places, "rk").select(*[F.col("row")[c].alias(c) for c in names], "shard", "slot")
