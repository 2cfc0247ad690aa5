"""Entropy balancing and the communication matrix against their definitions."""

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from colonnade.llm import sharding
from colonnade.llm.mixing import mix, token_targets


def plain_targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = budget * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_targets(spark):
    for sizes in ({"a": 100, "b": 900, "c": 50, None: 700, "d": 3000}, {"a": 1, "b": 1}, {None: 5}, {"a": 0, "b": 10}, {"x": 0}):
        got = token_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert {r.source for r in got} == set(sizes)
        assert all(math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9) for r in got)


def test_mix(docs, none, corpus):
    got = mix(docs).collect()
    assert len(got) == len(corpus)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, _, s in corpus:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    for r in got:
        assert r["size"] == size(r.text) and r.source_size == sizes[r.source] and r.copies in (0, 1, 2) and r.row == "row"
        taken[r.source] += r.copies * r["size"]
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + largest[s] for s in sizes)
    again = Counter((r.doc_id, r.text, r.copies) for r in mix(docs.repartition(2)).collect())
    assert again == Counter((r.doc_id, r.text, r.copies) for r in got)
    assert mix(none).count() == 0


def test_mix_comes_near_large_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3)).alias("source"), F.repeat(F.lit("w "), (1 + F.pmod(F.xxhash64("id"), F.lit(300))).cast("int")).alias("text"))
    got = mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("k"), F.first("target").alias("t")).collect()
    assert all(abs(r.k - r.t) < 0.002 * r.t for r in got)


def test_hypergeometric_law(spark):
    """The draw's frequencies over many seeds against the exact law."""
    total, marked, drawn, n = 30, 12, 9, 20000
    sql = sharding._hypergeometric(f"{total}L", f"{marked}L", f"{drawn}L", sharding._uniform("7", "id"))
    got = Counter(r[0] for r in spark.range(n).select(F.expr(sql)).collect())
    law = {k: math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) for k in range(max(0, drawn - total + marked), min(drawn, marked) + 1)}
    assert set(got) <= set(law)
    chi = sum((got[k] - n * p) ** 2 / (n * p) for k, p in law.items() if n * p >= 5)
    assert chi < 30
    for t, m, d in ((5, 0, 3), (5, 5, 3), (5, 2, 0), (5, 2, 5), (0, 0, 0), (10**10, 10**9, 10**6)):
        k = spark.range(1).select(F.expr(sharding._hypergeometric(f"{t}L", f"{m}L", f"{d}L", "0.5D"))).first()[0]
        assert max(0, d - t + m) <= k <= min(d, m)
        assert t < 10**9 or abs(k - 10**5) < 10**4


def test_matrix_margins(spark):
    counts = {0: 5, 1: 0, 2: 17, 3: 1, 4: 9}
    sizes = [11, 11, 10]
    df = spark.createDataFrame([(k, v) for k, v in counts.items() if v], "block long, c long")
    got = {r.block: r.starts for r in sharding.communication_matrix(df, 5, sizes).collect()}
    rows = {b: [y - x for x, y in zip(s, [*s[1:], counts[b]])] for b, s in got.items()}
    assert all(min(r) >= 0 and sum(r) == counts[b] for b, r in rows.items())
    assert [sum(r[k] for r in rows.values()) for k in range(3)] == sizes


def test_equal_rows_are_spread(spark):
    """A third of all rows are equal: their numbers are whole, and no part holds more of them than its share."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.struct(F.lit(0).alias("f"), F.col("id").alias("i")).alias("rk"))
    got = sharding.number_equal(rows, ["doc_id"], 10).collect()
    assert sorted(r._n for r in got if r.doc_id is None) == list(range(1, 1001))
    assert {r._n for r in got if r.doc_id is not None} == {1}
    dealt = sharding.deal(rows, ["doc_id"], 7).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("null"), F.max("slot").alias("last")).collect()
    assert all(428 <= r.n <= 429 and r.last == r.n - 1 and 90 < r.null < 200 for r in dealt) and len(dealt) == 7


def test_blocks_grow_with_the_rows():
    for total in (0, 1, 5000, 10**6, 10**8, 10**9, 10**12):
        blocks = sharding.source_blocks(total)
        assert total / blocks <= sharding.MOST_ROWS and blocks <= max(4100, total / 65000)


def places(df):
    return sorted((r.shard, r.slot, r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.collect())


def test_shard(docs, none, corpus, monkeypatch):
    got = places(sharding.shard(docs, 7))
    assert Counter((d, n, t) for _, _, n, d, t in got) == Counter((d is None, d or 0, t or "") for d, t, _, _ in corpus) or len(got) == len(corpus)
    per = Counter(s for s, *_ in got)
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 7
    assert all([p for s, p, *_ in got if s == k] == list(range(per[k])) for k in per)
    assert places(sharding.shard(docs.repartition(2), 7)) == got
    monkeypatch.setattr(sharding, "MOST_ROWS", 8)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 3)
    got = places(sharding.shard(docs, 7, seed=5))
    per = Counter(s for s, *_ in got)
    assert len(got) == len(corpus) and max(per.values()) - min(per.values()) <= 1
    assert all([p for s, p, *_ in got if s == k] == list(range(per[k])) for k in per)
    assert sharding.shard(none, 7).count() == 0


def test_shard_is_uniform(spark):
    """Over seeds, a row's shard and the pairing of two rows are as in a random permutation."""
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.struct(F.lit(0).alias("f"), F.col("id").alias("i")).alias("rk"))
    hits, pairs, n = Counter(), 0, 60
    for seed in range(n):
        at = {r.doc_id: r.shard for r in sharding.deal(docs, ["doc_id"], 4, seed).collect()}
        hits[at[0]] += 1
        pairs += sum(at[k] == at[k + 1] for k in range(39))
    assert all(4 <= hits[k] <= 30 for k in range(4))
    assert abs(pairs / (39 * n) - 9 / 39) < 0.04
