"""DataFrame operators against plain Python."""

import os
import random
import subprocess
import sys
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from colonnade.functions.types import SPARK
from colonnade.operators import aggregate, compute, encode, iterate, select, sort
from colonnade.operators.aggregate import Aggregate
from colonnade.operators.position import running_sum, with_position
from colonnade.operators.sort import SortOptions
from colonnade.sources import read_parquet, write_partitions

c = F.col


def frame(spark, values, kind="int", name="x"):
    return spark.createDataFrame(list(enumerate(values)), f"_pos long, {name} {kind}").repartition(3)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_positions(spark):
    rng = random.Random(2)
    values = [rng.randint(0, 50) for _ in range(500)]
    df = frame(spark, values)
    got = rows(with_position(df, [c("x"), c("_pos")], "p").select("p", "_pos"), "p")
    assert got == list(enumerate(sorted(range(500), key=lambda i: (values[i], i))))
    sums = rows(running_sum(df, [c("_pos")], c("x"), "s").select("_pos", "s"), "_pos")
    assert sums == [(i, sum(values[: i + 1])) for i in range(500)]
    assert running_sum(df.limit(0), [c("_pos")], c("x"), "s").count() == 0


def test_take_and_interleave(spark):
    data = frame(spark, [10, 20, 30])
    idx = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "k long, i int")
    assert rows(select.take(data, idx, "i").select("k", "x"), "k") == [(0, 30), (1, 10), (2, 30)]
    for bad in (3, -1, None):
        with pytest.raises(Exception, match="out of bounds"):
            select.take(data, spark.createDataFrame([(0, bad)], "k long, i int"), "i").collect()
    pairs = spark.createDataFrame([(0, 1, 0), (1, 0, 2), (2, 1, 1)], "k long, a int, i int")
    assert rows(select.interleave([data, frame(spark, [7, 8])], pairs).select("k", "x"), "k") == [(0, 7), (1, 30), (2, 8)]
    with pytest.raises(TypeError):
        select.interleave([data, frame(spark, ["a"], "string")], pairs)
    with pytest.raises(ValueError):
        select.concat([])
    assert rows(select.concat([data, frame(spark, [1])]).select("src", "_pos", "x"), "src", "_pos") == [(0, 0, 10), (0, 1, 20), (0, 2, 30), (1, 0, 1)]


def test_partition_and_merge(spark, tmp_path):
    df = frame(spark, [5, 6, 7, 8])
    parts = select.partitions(df, c("_pos") % 2 * 2, 3)
    assert [rows(p.select("x"), "x") for p in parts] == [[(5,), (7,)], [], [(6,), (8,)]]
    write_partitions(select.partition(df, c("_pos") % 2), str(tmp_path / "out"), "part")
    assert rows(read_parquet(spark, str(tmp_path / "out"), "part", "x"), "part", "x") == [(0, 5), (0, 7), (1, 6), (1, 8)]
    with pytest.raises(Exception, match="null partition"):
        select.partition(df, F.lit(None).cast("long")).collect()
    mask = spark.createDataFrame([(0, True), (1, False), (2, True)], "_pos long, f boolean")
    got = select.merge(mask, frame(spark, [1, 2]), frame(spark, [9]), "f")
    assert rows(got.select("_pos", "x"), "_pos") == [(0, 1), (1, 9), (2, 2)]


@pytest.mark.parametrize("options", [SortOptions(), SortOptions(True, False), SortOptions(False, True), SortOptions(True, True)])
def test_sort(spark, options):
    rng = random.Random(3)
    values = [rng.choice([None, *range(6)]) for _ in range(60)]
    sign = -1 if options.descending else 1
    want = sorted(range(60), key=lambda i: (((values[i] is None) != options.nulls_first), sign * (values[i] or 0), i))
    df = frame(spark, values)
    assert [i for _, i in rows(sort.sort_to_indices(df, "x", options), "rank")] == want
    assert [i for _, i in rows(sort.topk_indices(df, ["x"], 7, [options]), "rank")] == want[:7]
    assert sort.topk_indices(df, ["x"], 0, [options]).count() == 0
    keyed = df.withColumn("key", sort.normalised_key(c("x"), "i32", options))
    assert [i for _, i in rows(sort.sort_to_indices(keyed, "key"), "rank")] == want
    with pytest.raises(ValueError):
        sort.multicol_sort_to_indices(df, ["x"], [options, options])


def test_text_keys(spark):
    values = ["", "a", "a\0", "a\0b", "aa", "b", None, "é"]
    for options in (SortOptions(), SortOptions(True, True)):
        df = frame(spark, values, "string")
        by_key = rows(sort.sort_to_indices(df.withColumn("k", sort.normalize_columns([c("x"), c("_pos")], ["utf8", "i64"], [options, SortOptions()])), "k"), "rank")
        assert by_key == rows(sort.sort_to_indices(df, "x", options), "rank")


def test_float_keys(spark):
    values = [1.5, -2.0, float("nan"), None, 0.25, float("-inf"), 1e-300]
    for options in (SortOptions(), SortOptions(True, False)):
        df = frame(spark, values, "double")
        by_key = rows(sort.sort_to_indices(df.withColumn("k", sort.normalised_key(c("x"), "f64", options)), "k"), "rank")
        assert by_key == rows(sort.sort_to_indices(df, "x", options), "rank")


def test_lower_bound_rank_shift(spark):
    rng = random.Random(4)
    values, keys = [rng.randint(0, 20) for _ in range(40)], [rng.randint(-2, 23) for _ in range(30)]
    got = sort.lower_bound(frame(spark, keys, name="k"), "k", frame(spark, values), "x")
    assert rows(got.select("_pos", "bound"), "_pos") == [(i, bisect_left(sorted(values), k)) for i, k in enumerate(keys)]
    assert rows(sort.rank(frame(spark, [3, 1, 3, 2]), "x").select("_pos", "rank"), "_pos") == [(0, 4), (1, 1), (2, 4), (3, 2)]
    assert rows(sort.shift(frame(spark, [3, 1, 2]), "x", -1, "y").select("_pos", "y"), "_pos") == [(0, 1), (1, 2), (2, None)]


def test_reductions(spark):
    df = frame(spark, [2**31 - 1, 1, None, 5, 1])
    got = df.agg(compute.total(c("x"), "i32"), compute.minimum(c("x"), "i32"), compute.argmin(c("x"), c("_pos")), compute.argmax(c("x"), c("_pos"))).first()
    assert tuple(got) == (-(2**31) + 6, 1, 1, 0)
    none = df.limit(0).agg(compute.total(c("x"), "i32"), compute.argmin(c("x"), c("_pos"))).first()
    assert tuple(none) == (None, None)
    values = [random.Random(5).randint(-(2**31), 2**31 - 1) | 1 for _ in range(3000)]
    want = 1
    for v in values:
        want = want * v % 2**32
    assert compute.product(frame(spark, values), "x", "i32").first()[0] == (want - 2**32 if want >> 31 else want)
    assert compute.product(df.limit(0), "x", "i32").first()[0] is None
    assert compute.approx_max_run_length(frame(spark, [1, 1, None, None, 2, 2, 2]), "x").first()[0] == 3
    assert compute.approx_max_run_length(frame(spark, [1]), "x").first()[0] == 1


def test_encodings(spark):
    values = ["b", "a", "b", None, None, "c"]
    df = frame(spark, values, "string")
    keys, entries = encode.dictionary_encode(df, "x")
    assert rows(entries, "key") == [(0, "b"), (1, "a"), (2, "c")]
    assert rows(encode.dictionary_decode(keys, entries), "_pos") == list(enumerate(values))
    runs = encode.run_length_encode(df, "x")
    assert rows(runs, "run_end") == [(1, "b"), (2, "a"), (3, "b"), (5, None), (6, "c")]
    assert rows(encode.run_length_decode(runs), "_pos") == list(enumerate(values))


WANTED = [Aggregate("sum", "s", "x", "i32"), Aggregate("min", "lo", "x", "i32"), Aggregate("max", "hi", "x", "i32"), Aggregate("count", "n"), Aggregate("most_recent", "last", "x", "i32", "_pos")]


def test_aggregates_and_merge(spark):
    df = spark.createDataFrame([(0, 0, 10), (1, 1, 20), (2, 0, 30), (3, 1, 5), (4, 2, 7), (5, 2, None), (6, 3, None)], "_pos long, g int, x int")
    want = [(0, 40, 10, 30, 2, 30), (1, 25, 5, 20, 2, 5), (2, 7, 7, 7, 2, None), (3, 0, None, None, 1, None)]
    whole = aggregate.finish(aggregate.ingest(df, ["g"], WANTED), ["g"], WANTED)
    assert rows(whole, "g") == want
    parts = [aggregate.ingest(df.where(f), ["g"], WANTED) for f in ("_pos < 3", "_pos >= 3")]
    assert rows(aggregate.finish(aggregate.merge(parts, ["g"], WANTED), ["g"], WANTED), "g") == want


def test_stream(spark, tmp_path):
    from colonnade.streaming import aggregate_stream, read_merged, write_merged

    df = spark.createDataFrame([(0, 0, 10), (1, 1, 20), (2, 0, 30)], "_pos long, g int, x int")
    df.write.parquet(str(tmp_path / "in"))
    df.withColumn("_pos", c("_pos") + 3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_merged(stream, ["g"], WANTED, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert rows(read_merged(spark, str(tmp_path / "out"), ["g"], WANTED), "g") == [(0, 80, 10, 30, 4, 30), (1, 40, 20, 20, 2, 20)]
    query = aggregate_stream(stream, ["g"], WANTED[:4]).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("sums").select("g", "s", "n"), "g") == [(0, 80, 4), (1, 40, 2)]


def test_windowed_stream(spark, tmp_path):
    from colonnade.streaming import windowed_stream

    rows_ = [("2024-01-01 00:01:00", 1, 10), ("2024-01-01 00:02:00", 1, 5), ("2024-01-01 00:11:00", 2, 7), ("2024-01-01 01:00:00", 1, 1)]
    df = spark.createDataFrame(rows_, "t string, g int, x int").select(c("t").cast("timestamp").alias("t"), "g", "x")
    df.where("t < '2024-01-01 00:30:00'").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("t >= '2024-01-01 00:30:00'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windowed_stream(stream, "t", "10 minutes", "5 minutes", ["g"], WANTED[:1] + WANTED[3:4])
    query = out.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("windows").select(F.date_format("window.start", "HH:mm"), "g", "s", "n")
    assert sorted(map(tuple, got.collect())) == [("00:00", 1, 15, 2), ("00:10", 2, 7, 1)]


def test_iterate(spark):
    df = frame(spark, [3, None, 1])
    assert list(iterate.iterate(df, "x", "i64")) == [3, None, 1]
    assert list(iterate.iterate(df, "x", "u64", nonnull=True, indexed=True)) == [(0, 3), (2, 1)]


@pytest.mark.parametrize("values, kind, want", [
    ([3037000499, 3037000499], "i64", 3037000499**2),
    ([2**53 + 1, 3, None], "i64", 3 * (2**53 + 1)),
    ([2] * 62 + [-2], "i64", -(2**63)),
    ([2] * 63, "i64", None),
    ([2**62, 2**62, 2**62, 2**62, 7, 0], "i64", 0),
    ([2] * 200, "i64", None),
    ([-1] * 201 + [5], "i64", -5),
    ([2**63 - 1] * 3, "i64", None),
    ([100, 2], "i8", None),
    ([-64, 2], "i8", -128),
    ([], "i64", None),
    ([None], "i64", None),
    ([2**63, 1], "u64", 2**63),
    ([2**64 - 1, 2**64 - 1], "u64", None),
    ([-2.5, 2.0, None], "f64", -5.0),
])
def test_checked_product(spark, values, kind, want):
    df = spark.createDataFrame([(None if v is None else str(v),) for v in values], "x string").select(F.col("x").cast(SPARK[kind]).alias("x"))
    assert [r.product for r in compute.checked_product(df.repartition(3), "x", kind).collect()] == [want]


def test_names_of_helpers_clash(spark):
    """Columns whose names the operators use inside stay as they are."""
    clash = ["_v", "_i", "_part", "_o", "_rank", "_found", "_at", "_src", "_n", "_c", "_x", "turn"]
    df = spark.createDataFrame([(k, k % 3, *[f"{n}{k}" for n in clash]) for k in range(9)], "_pos long, x int, " + ", ".join(f"{n} string" for n in clash))
    keep = lambda out: {tuple(r[n] for n in clash) for r in out.collect()}
    want = keep(df)
    idx = df.withColumn("a", F.lit(0)).withColumn("i", c("_pos"))
    data = frame(spark, list(range(9)))
    for out in (with_position(df, [c("_pos")], "p"), running_sum(df, [c("_pos")], c("x"), "s"), select.take(data.drop("x"), idx, "i"), select.interleave([data.drop("x")], idx),
                sort.rank(df, "x"), sort.lower_bound(df, "x", data, "x"), sort.shift(df, "x", 1, "before")):
        assert keep(out) == want and set(clash) <= set(out.columns)
    assert rows(with_position(df, [c("_pos")], "p").select("p", "_pos"), "p") == [(k, k) for k in range(9)]


def test_written_tables_go(tmp_path):
    code = "from pyspark.sql import SparkSession\nfrom colonnade.operators.position import written\n" \
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}').getOrCreate()\n" \
        "print(written(s.range(3)).count(), len(written(s.range(3)).inputFiles()) > 0)\n"  # fmt: skip
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert said.stdout.split() == ["3", "True"] and not list(tmp_path.glob("colonnade-*"))


def test_dictionary_keys(spark):
    df = frame(spark, [k % 256 for k in range(600)])
    keys, values = encode.dictionary_encode(df, "x", kind="u8")
    assert values.count() == 256 and values.agg(F.max("key")).first()[0] == 255 and keys.schema["key"].dataType.simpleString() == "smallint"
    for kind, most in (("u8", 256), ("i8", 128)):
        assert encode.dictionary(frame(spark, list(range(most))), "x", kind=kind).count() == most
        with pytest.raises(Exception, match="more values than"):
            encode.dictionary(frame(spark, list(range(most + 1))), "x", kind=kind).collect()


def test_merge_keeps_the_first_of_equal_orders(spark):
    wanted = [Aggregate("most_recent", "last", "x", "i32", "o"), Aggregate("max", "turn", "x", "i32")]
    parts = [aggregate.ingest(spark.createDataFrame([(0, 5, x), (1, x, x)], "g int, o int, x int"), ["g"], wanted) for x in (3, 1, 2)]
    assert rows(aggregate.finish(aggregate.merge(parts, ["g"], wanted), ["g"], wanted), "g") == [(0, 3, 3), (1, 3, 3)]
    assert rows(aggregate.finish(aggregate.merge(parts[::-1], ["g"], wanted), ["g"], wanted), "g") == [(0, 2, 3), (1, 3, 3)]
