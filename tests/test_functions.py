"""Column operators against plain Python, many cases in one job."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colonnade.functions import arith, boolean, cmp, hashing, lists, types, vec
from colonnade.functions.cast import cast

c = F.col


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else [(k, *r) for k, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(expression.alias("v")).collect()]


def wrapped(x, kind):
    n = types.bits(kind)
    x %= 1 << n
    return x - (1 << n) if types.is_signed(kind) and x >> (n - 1) else x


EDGES = [0, 1, -1, 2, -2, 3, 127, -128, 2**31 - 1, -(2**31), 2**32, 2**63 - 1, -(2**63), 10**18, -(10**18)]


@pytest.mark.parametrize("op, plain", [(arith.add, lambda a, b: a + b), (arith.sub_wrapping, lambda a, b: a - b), (arith.mul_wrapping, lambda a, b: a * b)])
@pytest.mark.parametrize("kind", ["i8", "i16", "i32", "i64"])
def test_wrapping(spark, op, plain, kind):
    rng = random.Random(1)
    low, high = types.bounds(kind)
    values = [wrapped(x, kind) for x in EDGES] + [rng.randint(low, high) for _ in range(40)]
    pairs = [(a, b) for a in values for b in values[::3]]
    got = column(spark, pairs, f"a {types.spark_type(kind)}, b {types.spark_type(kind)}", op(c("a"), c("b"), (kind, kind)))
    assert got == [wrapped(plain(a, b), kind) for a, b in pairs]


@pytest.mark.parametrize("kind", ["u8", "u16", "u32", "u64"])
def test_wrapping_unsigned(spark, kind):
    from decimal import Decimal

    top = types.bounds(kind)[1]
    pairs = [(a, b) for a in (0, 1, 2, top // 2, top - 1, top) for b in (0, 1, 3, top)]
    rows = [(Decimal(a), Decimal(b)) if kind == "u64" else (a, b) for a, b in pairs]
    schema = f"a {types.spark_type(kind)}, b {types.spark_type(kind)}"
    for op, plain in ((arith.add, lambda a, b: a + b), (arith.sub_wrapping, lambda a, b: a - b), (arith.mul_wrapping, lambda a, b: a * b)):
        assert [int(x) for x in column(spark, rows, schema, op(c("a"), c("b"), (kind, kind)))] == [wrapped(plain(a, b), kind) for a, b in pairs]
    assert [int(x) for x in column(spark, rows, schema, arith.neg_wrapping(c("a"), kind))] == [wrapped(-a, kind) for a, _ in pairs]


def test_division(spark):
    low = -(2**31)
    pairs = [(7, 2), (-7, 2), (7, -2), (low, -1), (5, 0), (None, 3), (0, 5)]
    assert column(spark, pairs, "a int, b int", arith.div(c("a"), c("b"), ("i32", "i32"))) == [3, -3, -3, low, None, None, 0]
    assert column(spark, pairs, "a int, b int", arith.rem(c("a"), c("b"), ("i32", "i32"))) == [1, -1, 1, 0, None, None, 0]
    reals = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0)]
    got = column(spark, reals, "a double, b double", arith.div(c("a"), c("b"), ("f64", "f64")))
    assert got[0] == math.inf and got[1] == -math.inf and got[2] == -math.inf and math.isnan(got[3]) and got[4] == 1.5 and got[5] is None


def test_unary(spark):
    low = -(2**31)
    assert column(spark, [low, 5, -5, None], "x int", arith.absolute(c("x"), "i32")) == [low, 5, 5, None]
    assert column(spark, [low, 5, None], "x int", arith.neg_wrapping(c("x"), "i32")) == [low, -5, None]
    got = column(spark, [4.0, -1.0], "x double", arith.sqrt(c("x"), "f64"))
    assert got[0] == 2.0 and math.isnan(got[1])
    with pytest.raises(types.UnsupportedType):
        arith.add(c("x"), c("x"), ("utf8", "utf8"))


def test_dominant_type():
    cases = {("i32", "i32"): "i32", ("i8", "i64"): "i64", ("u8", "u32"): "u32", ("i32", "u64"): "i64", ("f32", "f64"): "f64", ("f32", "i8"): "f64", ("utf8", "binary"): "utf8"}
    assert {k: types.dominant_type(*k) for k in cases} == cases
    for bad in (("utf8", "i32"), ("list<i32>", "list<i64>"), ("list<i32>", "i32")):
        with pytest.raises(types.UnsupportedType):
            types.dominant_type(*bad)


def test_comparisons(spark):
    rows = [(1, 2), (2, 2), (None, 1), (3, 2)]
    for op, want in ((cmp.lt, [True, False, None, False]), (cmp.lt_eq, [True, True, None, False]), (cmp.gt, [False, False, None, True]), (cmp.gt_eq, [False, True, None, True]), (cmp.eq, [False, True, None, False]), (cmp.neq, [True, False, None, True])):
        assert column(spark, rows, "a int, b long", op(c("a"), c("b"), ("i32", "i64"))) == want
    assert column(spark, [9, 10, 19, 20, None], "x int", cmp.between(c("x"), F.lit(10), F.lit(20))) == [False, True, True, False, None]
    assert spark.range(0).agg(cmp.bounds(c("id"), F.lit(0), F.lit(1))).first()[0] is True
    assert column(spark, [1.0, math.nan], "x double", cmp.lt(c("x"), F.lit(math.inf))) == [True, False]


def test_total_order(spark):
    import struct

    values = [0.0, -0.0, 1.0, -1.0, 1.5, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 3.0, 1e300, 123456789.125]
    values += [random.Random(k).uniform(-1, 1) * 2.0 ** random.Random(k).randint(-1060, 1020) for k in range(200)] + [2.0**k for k in range(-1074, 1024, 7)]
    bits = column(spark, values, "x double", cmp.double_bits(c("x")))
    assert bits == [struct.unpack("<q", struct.pack("<d", v))[0] for v in values]
    assert column(spark, [math.nan, None], "x double", cmp.double_bits(c("x"))) == [0x7FF8 << 48, None]
    keys = column(spark, [-math.inf, -1.0, -0.0, 0.0, 1.0, math.inf, math.nan], "x double", cmp.total_order_key(c("x")))
    assert keys == sorted(keys) and len(set(keys)) == 7


def plain_like(text, pattern, escape):
    if not pattern:
        return not text
    p, rest = pattern[0], pattern[1:]
    if p == escape:
        return bool(text) and text[0] == rest[0] and plain_like(text[1:], rest[1:], escape)
    if p == "%":
        return any(plain_like(text[k:], rest, escape) for k in range(len(text) + 1))
    return bool(text) and (p == "_" or p == text[0]) and plain_like(text[1:], rest, escape)


@settings(max_examples=12, deadline=None)
@given(st.text("ab%_\\", max_size=7), st.sampled_from(["\\", "a"]))
def test_like(spark, pattern, escape):
    texts = ["", "a", "b", "ab", "aab", "a%b", "a_b", "a\\b", "%", "_", "\\", "bba", "ab\nab"]
    try:
        ready = cmp.normalise_pattern(pattern, escape)
    except ValueError:
        bare = pattern.replace(escape * 2, "")
        assert pattern.endswith(escape) and bare.endswith(escape) or pattern.endswith(escape)
        return
    assert ready is not None
    assert column(spark, texts, "x string", cmp.like(c("x"), pattern, escape)) == [plain_like(t, pattern, escape) for t in texts]


def test_like_bytes(spark):
    assert column(spark, ["é", "ab", "a"], "x string", cmp.like_bytes(c("x"), "__")) == [True, True, False]
    assert column(spark, ["é", "ab", "a"], "x string", cmp.like(c("x"), "_")) == [True, False, True]


def test_strings(spark):
    rows = [("hello", "he"), ("hello", ""), (None, "x"), ("x", None)]
    assert column(spark, rows, "a string, b string", cmp.starts_with(c("a"), c("b"))) == [True, True, None, None]
    assert column(spark, rows, "a string, b string", cmp.ends_with(c("a"), c("b"))) == [False, True, None, None]
    assert column(spark, ["abc", "", None], "a string", cmp.contains(c("a"), "b")) == [True, False, None]


def test_boolean(spark):
    rows = [(a, b) for a in (True, False, None) for b in (True, False, None)]
    schema = "a boolean, b boolean"
    assert column(spark, rows, schema, boolean.and_kleene(c("a"), c("b"))) == [True, False, None, False, False, False, None, False, None]
    assert column(spark, rows, schema, boolean.or_(c("a"), c("b"))) == [True, True, None, True, False, None, None, None, None]
    assert column(spark, rows, schema, boolean.not_(c("a"))) == [False] * 3 + [True] * 3 + [None] * 3
    assert column(spark, rows, schema, boolean.is_null(c("a"))) == [False] * 6 + [True] * 3


def test_casts(spark):
    assert column(spark, [300, -1, None], "x int", cast(c("x"), "i32", "i8")) == [44, -1, None]
    assert column(spark, [300, -1], "x int", cast(c("x"), "i32", "u8")) == [44, 255]
    assert column(spark, [3.9, -3.9, 1e20, math.nan, None, float(2**63)], "x double", cast(c("x"), "f64", "i64")) == [3, -3, None, None, None, None]
    assert column(spark, [-128.9, -129.0, 127.9, 128.0], "x double", cast(c("x"), "f64", "i8")) == [-128, None, 127, None]
    assert column(spark, [-float(2**63), -float(2**63) * 1.001], "x double", cast(c("x"), "f64", "i64")) == [-(2**63), None]
    assert [v if v is None else int(v) for v in column(spark, [-0.5, -1.0, 2.0**63, 2.0**64], "x double", cast(c("x"), "f64", "u64"))] == [0, None, 2**63, None]
    assert column(spark, [0.0, math.nan, 0.5, None], "x double", cast(c("x"), "f64", "bool")) == [False, False, True, None]
    assert column(spark, [[1, None, 300], None], "x array<int>", cast(c("x"), "list<i32>", "list<i8>")) == [[1, None, 44], None]
    for bad in (("utf8", "i32"), ("bool", "f64"), ("list<i32>", "i32"), ("list<i32>", "list<list<i32>>")):
        with pytest.raises(types.UnsupportedType):
            cast(c("x"), *bad)


def test_lists_vectors_hashes(spark):
    assert column(spark, [[1, 2], [], None], "x array<int>", lists.list_len(c("x"))) == [2, 0, None]
    assert column(spark, [[3.0, 4.0], None], "x array<float>", vec.dot([1.0, 2.0], c("x"))) == [11.0, None]
    assert column(spark, [[3.0, 4.0]], "x array<double>", vec.norm(c("x"), "double")) == [[0.6, 0.8]]
    df = spark.createDataFrame([(0, [5.0]), (1, [1.0]), (2, [1.0])], "p long, v array<float>")
    assert vec.nearest_neighbor(df, [0.9], "v", "p").first()[0] == 1
    assert vec.nearest_neighbor(df.limit(0), [0.9], "v", "p").first()[0] is None
    got = column(spark, [5, 5, None, 6], "x int", hashing.hash_(c("x")))
    assert got[0] == got[1] != got[3] and got[2] is None
    with pytest.raises(types.UnsupportedType):
        hashing.hash_unchained(c("x"), "f64")


def test_between_nulls_and_types(spark):
    df = spark.createDataFrame([(5, 10, None), (5, None, 3), (None, 1, 9), (5, 5, 6), (5, 6, 9)], "x int, lo int, hi int")
    got = [r[0] for r in df.select(cmp.between(F.col("x"), F.col("lo"), F.col("hi"))).collect()]
    assert got == [None, None, None, True, False]
    one = spark.range(1).select(cmp.between(F.lit(2), F.lit(1.5), F.lit(2.5), ("i32", "f64", "f64")), cmp.between(F.lit(2), F.lit(2.5), F.lit(3), ("i32", "f64", "i64"))).first()
    assert tuple(one) == (True, False)
    with pytest.raises(TypeError):
        cmp.between(F.lit("a"), F.lit(1), F.lit(2), ("utf8", "i32", "i32"))
    assert df.agg(cmp.bounds(F.col("x"), F.col("lo"), F.col("hi"))).first()[0] is False


def test_lists_of_numbers_and_texts(spark):
    df = spark.createDataFrame([([1, 5], [2, 4], ["a", "b"], ["a", "c"]), ([1], [1, 2], None, ["x"])], "a array<int>, b array<int>, s array<string>, t array<string>")
    got = df.select(cmp.compare_lists(cmp.lt, F.col("a"), F.col("b"), "i32"), cmp.compare_lists(cmp.lt, F.col("s"), F.col("t"), "utf8"), cmp.compare_lists(cmp.eq, F.col("s"), F.col("t"), "utf8")).collect()
    assert [tuple(r) for r in got] == [([True, False], True, False), (None, None, None)]
    kinds = ("list<i32>", "list<i32>")
    got = df.select(arith.add(F.col("a"), F.col("b"), kinds), arith.mul_wrapping(F.col("a"), F.col("b"), kinds)).collect()
    assert [tuple(r) for r in got] == [([3, 9], [2, 20]), (None, None)]
    big = spark.range(1).select(arith.mul_wrapping(F.array(F.lit(2**30)), F.array(F.lit(4)), kinds), arith.byte_swap(F.lit(1), "i32"), arith.byte_swap(F.lit(-2).cast("long"), "i64"), arith.splat(F.lit(7), 3)).first()
    assert tuple(big) == ([0], 1 << 24, int.from_bytes((-2).to_bytes(8, "little", signed=True), "big", signed=True), [7, 7, 7])
    for bad in (("list<utf8>", "list<utf8>"), ("list<i32>", "list<i64>"), ("list<i32>", "i32")):
        with pytest.raises(TypeError):
            arith.add(F.col("a"), F.col("b"), bad)


def test_vectors_that_do_not_fit(spark):
    for bad in (None, [1.0]):
        df = spark.createDataFrame([(0, [1.0, 2.0]), (1, bad)], "p long, v array<float>")
        with pytest.raises(Exception, match="takes vectors of 2 items"):
            vec.nearest_neighbor(df, [1.0, 1.0], "v", "p").collect()
    got = spark.createDataFrame([([3.0, 4.0],), (None,), ([0.0],)], "v array<float>").select(vec.norm(F.col("v"))).collect()
    assert [round(x, 6) for x in got[0][0]] == [0.6, 0.8] and got[1][0] is None and got[2][0][0] != got[2][0][0]
