"""One query for each operator, with SQL that gives the same rows.

Positions are dense keys of the tables: o_orderkey, event_id, doc_id, vec_id; lineitem gets them by its unique order.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import arith, boolean, cmp, hashing, lists, vec
from colonnade.functions.cast import cast
from colonnade.functions.types import dominant_type, logical_type
from colonnade.operators import aggregate, compute, encode, select, sort
from colonnade.operators.aggregate import Aggregate
from colonnade.operators.iterate import KINDS as ITERATED
from colonnade.operators.iterate import iterate
from colonnade.operators.position import with_position
from colonnade.operators.sort import SortOptions
from colonnade.sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: A unique order of lineitem.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE_KEYS = ", ".join(LINE_KEY)
c = F.col


def query(sql: str | None, name: str | None = None):
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


def per_row(name: str, source: str, keys: str, out: Callable[[], dict], sql: str, where: str | None = None) -> None:
    """Register a query of expressions over a table's rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        if where:
            df = df.where(where)
        return df.select(*keys.split(", "), *[e.alias(k) for k, e in out().items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {keys}, {sql} FROM {source}" + (f" WHERE {where}" if where else "")


def line_with_position(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*dict.fromkeys([*LINE_KEY, *columns]))
    return with_position(rows, [c(k).asc() for k in LINE_KEY])


LINE_SQL = f"(SELECT *, row_number() OVER (ORDER BY {LINE_KEYS}) - 1 AS _pos FROM lineitem)"

# Comparisons.
for op, sign in (("lt", "<"), ("lt_eq", "<="), ("gt", ">"), ("gt_eq", ">="), ("eq", "="), ("neq", "<>")):
    per_row(
        f"cmp_{op}", "lineitem", LINE_KEYS,
        lambda f=getattr(cmp, op): {"scalar": f(c("l_quantity"), F.lit(25), ("f64", "i32")), "columns": f(c("l_partkey"), c("l_linenumber") * 1000, ("i64", "i32")), "text": f(c("l_returnflag"), F.lit("N"))},
        f"l_quantity {sign} 25 AS scalar, l_partkey {sign} l_linenumber * 1000 AS columns, l_returnflag {sign} 'N' AS text",
    )
per_row("cmp_list", "embeddings", "vec_id", lambda: {"lanes": cmp.compare_lists(cmp.lt, F.slice("embedding", 1, 4), arith.splat(F.lit(0.0).cast("float"), 4), "f32")}, "list_transform(embedding[1:4], lambda x: x < 0) AS lanes")
per_row("cmp_list_text", "nation", "n_nationkey", lambda: {"below": cmp.compare_lists(cmp.lt, F.array(F.substring("n_name", 1, 1), "n_name"), F.array(F.lit("F"), F.lit("FRANCE")), "utf8")}, "[substr(n_name, 1, 1), n_name] < ['F', 'FRANCE'] AS below")
per_row("cmp_between_types", "lineitem", LINE_KEYS, lambda: {"b": cmp.between(c("l_linenumber"), c("l_discount") * 20, c("l_partkey"), ("i32", "f64", "i64")), "null": cmp.between(c("l_linenumber"), F.lit(9), F.nullif(c("l_linenumber"), F.lit(2)))}, "l_linenumber >= l_discount * 20 AND l_linenumber < l_partkey::DOUBLE AS b, CASE WHEN l_linenumber <> 2 THEN false END AS null")
per_row("arith_list", "embeddings", "vec_id", lambda: {"v": arith.add(arith.mul_wrapping(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4), ("list<f32>", "list<f32>")), F.slice("embedding", 9, 4), ("list<f32>", "list<f32>"))}, "list_transform(range(1, 5), lambda i: embedding[i] * embedding[i + 4] + embedding[i + 8]) AS v")
per_row("arith_byte_swap", "lineitem", LINE_KEYS, lambda: {"b": arith.byte_swap(c("l_linenumber"), "i32")}, "l_linenumber << 24 AS b")
per_row("cmp_between_half_open", "lineitem", LINE_KEYS, lambda: {"fixed": cmp.between(c("l_quantity"), F.lit(10), F.lit(20)), "columns": cmp.between(c("l_discount"), c("l_tax"), F.lit(0.09))}, "l_quantity >= 10 AND l_quantity < 20 AS fixed, l_discount >= l_tax AND l_discount < 0.09 AS columns")


@query("""SELECT l_returnflag, coalesce(bool_and(l_quantity >= 1 AND l_quantity < 51), true) AS inside, coalesce(bool_and(l_quantity >= 2 AND l_quantity < 50), true) AS narrow
FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'none', coalesce(bool_and(l_quantity < 0), true), true FROM lineitem WHERE l_quantity < 0""")
def cmp_bounds(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = [cmp.bounds(c("l_quantity"), F.lit(1), F.lit(51)).alias("inside"), cmp.bounds(c("l_quantity"), F.lit(2), F.lit(50)).alias("narrow")]
    return df.groupBy("l_returnflag").agg(*out).unionByName(df.where("l_quantity < 0").agg(F.lit("none").alias("l_returnflag"), *out))


# Strings.
per_row("str_starts_with", "part", "p_partkey", lambda: {"fixed": cmp.starts_with(c("p_name"), F.lit("a")), "columns": cmp.starts_with(c("p_brand"), F.substring("p_brand", 1, 3))}, "starts_with(p_name, 'a') AS fixed, starts_with(p_brand, substr(p_brand, 1, 3)) AS columns")
per_row("str_ends_with", "part", "p_partkey", lambda: {"fixed": cmp.ends_with(c("p_type"), F.lit("L")), "columns": cmp.ends_with(c("p_brand"), c("p_size").cast("string"))}, "ends_with(p_type, 'L') AS fixed, ends_with(p_brand, p_size::VARCHAR) AS columns")
per_row("str_contains", "documents", "doc_id", lambda: {"found": cmp.contains(c("text"), "the"), "empty": cmp.contains(c("text"), "")}, "contains(text, 'the') AS found, contains(text, '') AS empty")
for shape, pattern in {"exact": "Brand#13", "prefix": "Brand#1%", "suffix": "%3", "infix": "%nd#2%", "underscore": "Brand#_3", "multi": "B%a%#%1%", "escape": "Brand\\#1_"}.items():
    per_row(f"str_like_{shape}", "part", "p_partkey", lambda p=pattern: {"found": cmp.like(c("p_brand"), p), "not_found": cmp.nlike(c("p_brand"), p)}, f"p_brand LIKE '{pattern}' ESCAPE '\\' AS found, p_brand NOT LIKE '{pattern}' ESCAPE '\\' AS not_found")
per_row("str_like_bytes", "documents", "doc_id", lambda: {"found": cmp.like_bytes(c("lang"), "__")}, "octet_length(lang::BLOB) = 2 AS found")
per_row("str_compiled_like", "documents", "doc_id", lambda: {"found": cmp.compile_string_like("src1_")(c("source"))}, "source LIKE 'src1_' AS found")
per_row("ext_ilike", "part", "p_partkey", lambda: {"found": cmp.ilike(c("p_brand"), "bRAND#1%"), "same": cmp.eq_ignore_case(c("p_brand"), F.lit("BRAND#13"))}, "p_brand ILIKE 'bRAND#1%' AS found, lower(p_brand) = 'brand#13' AS same")
per_row("ext_regexp_is_match", "part", "p_partkey", lambda: {"found": cmp.regexp_is_match(c("p_brand"), "#[1-3]{2}$")}, "regexp_matches(p_brand, '#[1-3]{2}$') AS found")
per_row("ext_in_list", "part", "p_partkey", lambda: {"found": cmp.in_list(c("p_size"), [1, 5, 7])}, "p_size IN (1, 5, 7) AS found")
per_row("ext_distinct", "events", "event_id", lambda: {"other": cmp.distinct(F.nullif(c("event_type"), F.lit("click")), F.lit("view")), "same": cmp.not_distinct(F.nullif(c("event_type"), F.lit("click")), F.lit(None).cast("string"))}, "nullif(event_type, 'click') IS DISTINCT FROM 'view' AS other, nullif(event_type, 'click') IS NOT DISTINCT FROM NULL AS same")
per_row("ext_length", "part", "p_partkey", lambda: {"n": lists.length(c("p_name")), "sub": lists.substring(c("p_name"), 2, 4), "both": lists.concat_elements(c("p_brand"), F.lit("/"), c("p_type"))}, "length(p_name) AS n, substr(p_name, 3, 4) AS sub, p_brand || '/' || p_type AS \"both\"")
per_row("ext_date_part", "orders", "o_orderkey", lambda: {"y": lists.date_part("year", c("o_orderdate")).cast("long"), "m": lists.date_part("month", c("o_orderdate")).cast("long"), "d": lists.date_part("day", c("o_orderdate")).cast("long")}, "date_part('year', o_orderdate)::BIGINT AS y, date_part('month', o_orderdate)::BIGINT AS m, date_part('day', o_orderdate)::BIGINT AS d")

# Arithmetic: factors that overflow 32 and 64 bits.
_I32 = "((l_partkey * 7919) % 4294967296 - 2147483648)"
_I64 = "((l_partkey % 1000 * 7919 - 90000) * 922337203685)"


def _wrapped(x: str, n: int) -> str:
    return f"((((({x}) + {2 ** (n - 1)}::HUGEINT) % {2**n}::HUGEINT) + {2**n}::HUGEINT) % {2**n}::HUGEINT - {2 ** (n - 1)}::HUGEINT)"


def _i32():
    return F.expr(_I32).cast("int")


def _i64():
    return F.expr(_I64).cast("long")


for op, sign in (("add", "+"), ("sub_wrapping", "-"), ("mul_wrapping", "*")):
    per_row(
        f"arith_{op.split('_')[0]}", "lineitem", LINE_KEYS,
        lambda f=getattr(arith, op): {"narrow": f(_i32(), F.lit(2147480000), ("i32", "i32")), "wide": f(_i64(), c("l_suppkey") % 1000 * 9000000000000000, ("i64", "i64")), "mixed": f(c("l_quantity"), c("l_linenumber"), ("f64", "i32"))},
        f"{_wrapped(f'{_I32}::HUGEINT {sign} 2147480000', 32)}::INTEGER AS narrow, {_wrapped(f'{_I64}::HUGEINT {sign} (l_suppkey % 1000 * 9000000000000000)::HUGEINT', 64)}::BIGINT AS wide, l_quantity {sign} l_linenumber AS mixed",
    )
per_row("arith_div", "lineitem", LINE_KEYS, lambda: {"whole": _shown(arith.div(c("l_partkey") - 1000, c("l_linenumber") - 3, ("i64", "i32")), "long"), "real": arith.div(c("l_extendedprice"), c("l_quantity"), ("f64", "f64")), "by_zero": arith.div(c("l_quantity"), c("l_quantity") * 0, ("f64", "f64"))}, "coalesce(CASE WHEN l_linenumber <> 3 THEN (l_partkey - 1000) // (l_linenumber - 3) END, -1) AS whole, l_extendedprice / l_quantity AS real, 'inf'::DOUBLE AS by_zero")
per_row("arith_rem", "lineitem", LINE_KEYS, lambda: {"whole": arith.rem(c("l_partkey") - 1000, F.lit(7).cast("long"), ("i64", "i64")), "real": arith.rem(c("l_quantity"), F.lit(7.0), ("f64", "f64"))}, "(l_partkey - 1000) % 7 AS whole, l_quantity % 7.0::DOUBLE AS real")
per_row("arith_neg", "lineitem", LINE_KEYS, lambda: {"whole": arith.neg_wrapping(_i32(), "i32"), "real": arith.neg_wrapping(c("l_quantity"), "f64")}, f"{_wrapped(f'-({_I32}::HUGEINT)', 32)}::INTEGER AS whole, -l_quantity AS real")
per_row("arith_abs", "customer", "c_custkey", lambda: {"whole": arith.absolute(c("c_acctbal").cast("long"), "i64"), "real": arith.absolute(c("c_acctbal"), "f64")}, "abs(trunc(c_acctbal)::BIGINT) AS whole, abs(c_acctbal) AS real")
per_row("arith_sqrt", "lineitem", LINE_KEYS, lambda: {"root": F.floor(arith.sqrt(c("l_extendedprice"), "f64") * 1000000), "whole": F.floor(arith.sqrt(c("l_partkey"), "i64") * 1000000)}, "floor(sqrt(l_extendedprice) * 1000000)::BIGINT AS root, floor(sqrt(l_partkey) * 1000000)::BIGINT AS whole")
per_row("ext_bitwise", "lineitem", LINE_KEYS, lambda: {"a": arith.bit_and(c("l_partkey"), c("l_suppkey")), "o": arith.bit_or(c("l_partkey"), c("l_suppkey")), "x": arith.bit_xor(c("l_partkey"), c("l_suppkey")), "n": arith.bit_not(c("l_partkey")), "l": arith.shift_left(c("l_partkey"), 3), "r": arith.shift_right(c("l_partkey"), 2)}, "l_partkey & l_suppkey AS a, l_partkey | l_suppkey AS o, xor(l_partkey, l_suppkey) AS x, ~l_partkey AS n, l_partkey << 3 AS l, l_partkey >> 2 AS r")
per_row("ext_fixed_point", "lineitem", LINE_KEYS, lambda: {"v": arith.multiply_fixed_point(c("l_extendedprice").cast("decimal(15,2)"), F.lit("1.25").cast("decimal(3,2)"), 18, 4).cast("double")}, "(l_extendedprice::DECIMAL(15,2) * 1.25::DECIMAL(3,2))::DECIMAL(18,4)::DOUBLE AS v")

# Booleans and nulls, synthesised.  Null shows as -1, so that results hold whole numbers on either side.
def _shown(x, kind: str = "int"):
    return F.coalesce(x.cast(kind), F.lit(-1).cast(kind))


_B = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type = 'click' END"
_V = "nullif(event_type, 'click')"
per_row("bool_not", "events", "event_id", lambda: {"b": _shown(boolean.not_(F.expr(_B)))}, f"coalesce((NOT ({_B}))::INTEGER, -1) AS b")
per_row("bool_is_null", "events", "event_id", lambda: {"b": boolean.is_null(F.expr(_V))}, f"{_V} IS NULL AS b")
per_row("bool_is_not_null", "events", "event_id", lambda: {"b": boolean.is_not_null(F.expr(_V)), "valid": boolean.logical_nulls(F.expr(_V))}, f"{_V} IS NOT NULL AS b, {_V} IS NOT NULL AS valid")
per_row("bool_intersect_nulls", "events", "event_id", lambda: {"v": _shown(boolean.intersect_and_copy_nulls([F.expr(_V), F.expr(_B)], c("user_id")), "long")}, f"coalesce(CASE WHEN {_V} IS NOT NULL AND ({_B}) IS NOT NULL THEN user_id END, -1) AS v")
per_row("ext_kleene", "events", "event_id", lambda: {"a": _shown(boolean.and_kleene(F.expr(_B), c("user_id") > 50)), "o": _shown(boolean.or_kleene(F.expr(_B), c("user_id") > 50)), "s": _shown(boolean.and_(F.expr(_B), c("user_id") > 50)), "n": _shown(boolean.and_not(F.expr(_B), c("user_id") > 50))}, f"coalesce((({_B}) AND user_id > 50)::INTEGER, -1) AS a, coalesce((({_B}) OR user_id > 50)::INTEGER, -1) AS o, coalesce((CASE WHEN ({_B}) IS NOT NULL THEN ({_B}) AND user_id > 50 END)::INTEGER, -1) AS s, coalesce((CASE WHEN ({_B}) IS NOT NULL THEN ({_B}) AND NOT user_id > 50 END)::INTEGER, -1) AS n")
per_row("ext_nullif_zip", "events", "event_id", lambda: {"n": _shown(boolean.nullif(c("user_id"), c("event_type") == "click"), "long"), "z": boolean.zip_(c("event_type") == "click", c("user_id"), c("event_id"))}, "coalesce(CASE WHEN event_type <> 'click' THEN user_id END, -1) AS n, CASE WHEN event_type = 'click' THEN user_id ELSE event_id END AS z")

# Casts.
per_row("cast_widen", "lineitem", LINE_KEYS, lambda: {"l": cast(c("l_linenumber"), "i32", "i64"), "d": cast(c("l_linenumber"), "i32", "f64"), "f": cast(c("l_quantity"), "f64", "f32").cast("double")}, "l_linenumber::BIGINT AS l, l_linenumber::DOUBLE AS d, l_quantity::FLOAT::DOUBLE AS f")
per_row("cast_truncate", "lineitem", LINE_KEYS, lambda: {"i8": cast(c("l_partkey"), "i64", "i8").cast("int"), "i16": cast(c("l_partkey") * 37, "i64", "i16").cast("int"), "u8": cast(c("l_partkey"), "i64", "u8").cast("int"), "i32": cast(c("l_partkey") * 99991117, "i64", "i32")}, f"{_wrapped('l_partkey::HUGEINT', 8)}::INTEGER AS i8, {_wrapped('l_partkey::HUGEINT * 37', 16)}::INTEGER AS i16, (l_partkey % 256)::INTEGER AS u8, {_wrapped('l_partkey::HUGEINT * 99991117', 32)}::INTEGER AS i32")
per_row("cast_float_int", "lineitem", LINE_KEYS, lambda: {"l": cast(c("l_extendedprice"), "f64", "i64"), "n": cast(-c("l_extendedprice"), "f64", "i32"), "out": cast(c("l_extendedprice"), "f64", "i8").isNull()}, "trunc(l_extendedprice)::BIGINT AS l, trunc(-l_extendedprice)::INTEGER AS n, l_extendedprice >= 128 AS \"out\"")
per_row("cast_bool", "lineitem", LINE_KEYS, lambda: {"b": cast(c("l_discount"), "f64", "bool"), "i": cast(c("l_quantity") > 25, "bool", "i32")}, "l_discount <> 0 AS b, (l_quantity > 25)::INTEGER AS i")
per_row("cast_identity", "lineitem", LINE_KEYS, lambda: {"d": cast(c("l_discount"), "f64", "f64"), "t": cast(c("l_returnflag"), "utf8", "utf8")}, "l_discount AS d, l_returnflag AS t")
per_row("cast_text", "part", "p_partkey", lambda: {"t": cast(cast(c("p_name"), "utf8", "binary"), "binary", "utf8")}, "p_name AS t")
per_row("cast_list", "embeddings", "vec_id", lambda: {"n": lists.list_len(cast(c("embedding"), "list<f32>", "list<f64>")), "first": F.get(cast(c("embedding"), "list<f32>", "list<f64>"), F.lit(0))}, "len(embedding) AS n, embedding[1]::DOUBLE AS first")


@query("SELECT row_number() OVER (ORDER BY min(event_id)) - 1 AS key, event_type AS value FROM events GROUP BY event_type")
def dict_encode(spark, sf_dir):
    return encode.dictionary(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT event_id, event_type AS value FROM events")
def dict_decode(spark, sf_dir):
    keys, values = encode.dictionary_encode(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")
    return encode.dictionary_decode(keys, values)


@query("""WITH e AS (SELECT event_id, event_type, lead(event_type) OVER (ORDER BY event_id) AS n FROM events)
SELECT event_id + 1 AS run_end, event_type AS value FROM e WHERE n IS NULL OR n <> event_type""")
def run_encode(spark, sf_dir):
    return encode.run_length_encode(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT event_id AS _pos, event_type AS value FROM events")
def run_decode(spark, sf_dir):
    return encode.run_length_decode(encode.run_length_encode(table(spark, sf_dir, "events"), "event_type", "event_id"))


# Selection.
@query("SELECT e.event_id, (e.event_id * 7 + e.user_id) % 1000 AS i, o.o_totalprice FROM events e JOIN orders o ON o.o_orderkey = (e.event_id * 7 + e.user_id) % 1000")
def select_take(spark, sf_dir):
    indices = table(spark, sf_dir, "events").select("event_id", ((c("event_id") * 7 + c("user_id")) % 1000).alias("i"))
    return select.take(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), indices, "i", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice > 100000 END")
def select_filter(spark, sf_dir):
    return select.filter_(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.when(c("o_orderkey") % 5 != 0, c("o_totalprice") > 100000))


@query("SELECT 0 AS src, c_custkey AS pos, c_name AS name FROM customer UNION ALL SELECT 1, s_suppkey, s_name FROM supplier")
def select_concat(spark, sf_dir):
    return select.concat([table(spark, sf_dir, "customer").select(c("c_custkey").alias("pos"), c("c_name").alias("name")), table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("pos"), c("s_name").alias("name"))])


@query("""WITH i AS (SELECT event_id, event_id % 2 AS a, user_id % 50 AS i FROM events)
SELECT event_id, a, i, o_totalprice AS v FROM i JOIN orders ON a = 0 AND o_orderkey = i UNION ALL SELECT event_id, a, i, value FROM i JOIN (SELECT event_id AS k, value FROM events) ON a = 1 AND k = i""")
def select_interleave(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    indices = events.select("event_id", (c("event_id") % 2).alias("a"), (c("user_id") % 50).alias("i"))
    parts = [table(spark, sf_dir, "orders").select(c("o_orderkey").alias("_pos"), c("o_totalprice").alias("v")), events.select(c("event_id").alias("_pos"), c("value").alias("v"))]
    return select.interleave(parts, indices)


@query("SELECT o_orderkey % 7 AS part, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY ALL")
def select_partition(spark, sf_dir):
    dealt = select.partition(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c("o_orderkey") % 7)
    return dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


@query("""WITH m AS (SELECT event_id, event_type = 'click' AS f FROM events),
n AS (SELECT event_id, f, CASE WHEN f THEN sum(f::INT) OVER w - 1 ELSE sum((NOT f)::INT) OVER w - 1 END AS i FROM m WINDOW w AS (ORDER BY event_id))
SELECT n.event_id, CASE WHEN f THEN o_totalprice ELSE value END AS v FROM n JOIN orders ON o_orderkey = i JOIN (SELECT event_id AS k, value FROM events) ON k = i""")
def ext_merge(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    mask = events.select("event_id", (c("event_type") == "click").alias("f"))
    true = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("event_id"), c("o_totalprice").alias("v"))
    return select.merge(mask, true, events.select("event_id", c("value").alias("v")), "f", "event_id")


# Sorting.
@query("SELECT row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS LAST, o_orderkey) - 1 AS rank, o_orderkey AS index FROM orders")
def sort_indices(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(c("o_orderstatus"), F.lit("F")).alias("s"))
    return sort.sort_to_indices(df, "s", SortOptions(descending=True), "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_orderpriority NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey) - 1 AS rank, o_orderkey AS index FROM orders")
def sort_multi(spark, sf_dir):
    return sort.multicol_sort_to_indices(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_totalprice"], [SortOptions(), SortOptions(True, True)], "o_orderkey")


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank, o_orderkey AS index FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, sf_dir):
    return sort.topk_indices(table(spark, sf_dir, "orders"), ["o_totalprice"], 20, [SortOptions(descending=True)], "o_orderkey")


@query("SELECT s_suppkey, s_acctbal, (SELECT count(*) FROM customer WHERE c_acctbal < s_acctbal) AS bound FROM supplier")
def lower_bound(spark, sf_dir):
    return sort.lower_bound(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", table(spark, sf_dir, "customer"), "c_acctbal")


@query("""WITH k AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, o_custkey FROM orders)
SELECT row_number() OVER (ORDER BY s NULLS FIRST, o_custkey DESC NULLS LAST, o_orderkey) - 1 AS rank, o_orderkey AS index FROM k""")
def sort_normalized(spark, sf_dir):
    key = sort.normalize_columns([F.nullif(c("o_orderstatus"), F.lit("F")), c("o_custkey")], ["utf8", "i64"], [SortOptions(nulls_first=True), SortOptions(descending=True)])
    return sort.sort_to_indices(table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key")), "key", None, "o_orderkey")


@query("SELECT event_id, rank() OVER (ORDER BY user_id) + count(*) OVER (PARTITION BY user_id) - 1 AS rank FROM events")
def ext_rank(spark, sf_dir):
    return sort.rank(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id").select("event_id", "rank")


@query("SELECT event_id, user_id, coalesce(lag(user_id, 2) OVER (ORDER BY event_id), -1) AS earlier FROM events")
def ext_shift(spark, sf_dir):
    return sort.shift(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 2, "earlier", "event_id").withColumn("earlier", _shown(c("earlier"), "long"))


# Reductions.
@query("SELECT min(l_quantity) AS q, min(l_partkey) AS p, min(l_returnflag) AS f, coalesce(min(CASE WHEN l_quantity < 0 THEN l_partkey END), -1) AS none FROM lineitem")
def red_min(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(compute.minimum(c("l_quantity"), "f64").alias("q"), compute.minimum(c("l_partkey"), "i64").alias("p"), compute.minimum(c("l_returnflag"), "utf8").alias("f"), _shown(compute.minimum(F.when(c("l_quantity") < 0, c("l_partkey")), "i64"), "long").alias("none"))


@query("SELECT max(l_quantity) AS q, max(l_partkey) AS p, max(l_returnflag) AS f FROM lineitem")
def red_max(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(compute.maximum(c("l_quantity"), "f64").alias("q"), compute.maximum(c("l_partkey"), "i64").alias("p"), compute.maximum(c("l_returnflag"), "utf8").alias("f"))


@query(f"SELECT sum(l_quantity) AS real, {_wrapped(f'sum({_I32}::HUGEINT)', 32)}::INTEGER AS narrow, {_wrapped(f'sum({_I64}::HUGEINT * 1000)', 64)}::BIGINT AS wide FROM lineitem")
def red_sum(spark, sf_dir):
    wide = arith.mul_wrapping(_i64(), F.lit(1000), ("i64", "i64"))
    return table(spark, sf_dir, "lineitem").agg(compute.total(c("l_quantity"), "f64").alias("real"), compute.total(_i32(), "i32").alias("narrow"), compute.total(wide, "i64").alias("wide"))


@query("SELECT round(product(1 + s_nationkey / 1000.0), 6) AS real FROM supplier")
def red_product(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select((1 + c("s_nationkey") / 1000.0).cast("double").alias("x"))
    return compute.product(df, "x", "f64", "real").select(F.round("real", 6).alias("real"))


@query("""WITH RECURSIVE f AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, (n_nationkey * 2 + 3)::HUGEINT AS x FROM nation),
r AS (SELECT 0::BIGINT AS i, 1::HUGEINT AS p UNION ALL SELECT f.i, (r.p * f.x) % 4294967296::HUGEINT FROM r JOIN f ON f.i = r.i + 1)
SELECT (CASE WHEN p >= 2147483648 THEN p - 4294967296 ELSE p END)::INTEGER AS product FROM r ORDER BY i DESC LIMIT 1""")
def red_product_wrapping(spark, sf_dir):
    return compute.product(table(spark, sf_dir, "nation").select((c("n_nationkey") * 2 + 3).cast("int").alias("x")), "x", "i32")


@query(f"SELECT arg_min(_pos, (l_quantity, _pos)) AS q, arg_min(_pos, (l_returnflag, _pos)) AS f FROM {LINE_SQL}")
def red_argmin(spark, sf_dir):
    df = line_with_position(spark, sf_dir, "l_quantity", "l_returnflag")
    return df.agg(compute.argmin(c("l_quantity"), c("_pos")).alias("q"), compute.argmin(c("l_returnflag"), c("_pos")).alias("f"))


@query(f"SELECT arg_max(_pos, (l_quantity, -_pos)) AS q, arg_max(_pos, (l_returnflag, -_pos)) AS f FROM {LINE_SQL}")
def red_argmax(spark, sf_dir):
    df = line_with_position(spark, sf_dir, "l_quantity", "l_returnflag")
    return df.agg(compute.argmax(c("l_quantity"), c("_pos")).alias("q"), compute.argmax(c("l_returnflag"), c("_pos")).alias("f"))


@query("""WITH e AS (SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 8193),
n AS (SELECT *, coalesce(event_type <> lag(event_type) OVER (ORDER BY event_id), true)::INT AS new FROM e),
r AS (SELECT sum(new) OVER (ORDER BY event_id) AS run FROM n) SELECT max(c) AS run_length FROM (SELECT count(*) AS c FROM r GROUP BY run)""")
def max_run_length(spark, sf_dir):
    return compute.approx_max_run_length(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("SELECT count(DISTINCT l_partkey) AS keys, count(DISTINCT l_partkey) AS hashes, count(DISTINCT l_suppkey) AS unchained, true AS nulls FROM lineitem")
def hash_props(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.agg(F.countDistinct("l_partkey").alias("keys"), F.countDistinct(hashing.hash_(c("l_partkey"))).alias("hashes"), F.countDistinct(hashing.hash_unchained(c("l_suppkey"), "i64")).alias("unchained"), F.bool_and(hashing.hash_(F.lit(None).cast("long")).isNull()).alias("nulls"))


@query("SELECT bit_and(l_partkey | 8) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x, bool_and(l_quantity > 0) AS every, bool_or(l_quantity > 49) AS any FROM lineitem")
def ext_bit_reductions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(compute.bit_and(c("l_partkey").bitwiseOR(F.lit(8))).alias("a"), compute.bit_or(c("l_partkey")).alias("o"), compute.bit_xor(c("l_partkey")).alias("x"), compute.bool_and(c("l_quantity") > 0).alias("every"), compute.bool_or(c("l_quantity") > 49).alias("any"))


@query('SELECT sum(r_regionkey)::BIGINT AS fits, -1::INTEGER AS "over", product(r_regionkey + 1)::BIGINT AS product FROM region')
def ext_checked(spark, sf_dir):
    key = c("r_regionkey")
    region = table(spark, sf_dir, "region")
    totals = region.agg(compute.checked_total(key.cast("long"), "i64").alias("fits"), _shown(compute.checked_total(key + 2147483640, "i32")).alias("over"))
    return totals.crossJoin(compute.checked_product(region.select((key + 1).cast("long").alias("x")), "x", "i64"))


# Grouped aggregates.
def _aggregates() -> list[Aggregate]:
    return [Aggregate("sum", "total", "l_quantity", "f64"), Aggregate("sum", "keys", "l_linenumber", "i32"), Aggregate("min", "least", "l_partkey", "i64"), Aggregate("max", "most", "l_partkey", "i64"), Aggregate("count", "n")]


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, sum(l_linenumber)::BIGINT AS keys, coalesce(sum(CASE WHEN l_quantity < 0 THEN l_linenumber END), 0)::BIGINT AS none FROM lineitem GROUP BY ALL")
def agg_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(aggregate.grouped_sum(c("l_quantity"), "f64").alias("total"), aggregate.grouped_sum(c("l_linenumber"), "i32").alias("keys"), aggregate.grouped_sum(F.when(c("l_quantity") < 0, c("l_linenumber")), "i32").alias("none"))


@query("SELECT l_returnflag, min(l_partkey) AS p, min(l_linestatus) AS s FROM lineitem GROUP BY ALL")
def agg_min(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(aggregate.grouped_min(c("l_partkey"), "i64").alias("p"), aggregate.grouped_min(c("l_linestatus"), "utf8").alias("s"))


@query("SELECT l_returnflag, max(l_partkey) AS p, max(l_linestatus) AS s FROM lineitem GROUP BY ALL")
def agg_max(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(aggregate.grouped_max(c("l_partkey"), "i64").alias("p"), aggregate.grouped_max(c("l_linestatus"), "utf8").alias("s"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY ALL")
def agg_count(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(aggregate.count().alias("n"))


@query("SELECT user_id, last(nullif(event_type, 'click') ORDER BY event_id) AS latest, last(value ORDER BY event_id) AS value FROM events GROUP BY ALL")
def agg_most_recent(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(aggregate.most_recent(F.nullif(c("event_type"), F.lit("click")), c("event_id")).alias("latest"), aggregate.most_recent(c("value"), c("event_id")).alias("value"))


@query("SELECT l_returnflag, sum(l_quantity) AS total, sum(l_linenumber)::BIGINT AS keys, min(l_partkey) AS least, max(l_partkey) AS most, count(*) AS n FROM lineitem GROUP BY ALL")
def agg_merge(spark, sf_dir):
    df, keys, wanted = table(spark, sf_dir, "lineitem"), ["l_returnflag"], _aggregates()
    halves = [aggregate.ingest(df.where(c("l_orderkey") % 2 == k), keys, wanted) for k in (0, 1)]
    return aggregate.finish(aggregate.merge(halves, keys, wanted), keys, wanted)


@query("SELECT user_id, last(event_type ORDER BY event_id) AS latest, count(*) AS n FROM events GROUP BY ALL")
def agg_merge_most_recent(spark, sf_dir):
    df, wanted = table(spark, sf_dir, "events"), [Aggregate("most_recent", "latest", "event_type", "utf8", "event_id"), Aggregate("count", "n")]
    halves = [aggregate.ingest(df.where(c("event_id") % 2 == k), ["user_id"], wanted) for k in (0, 1)]
    return aggregate.finish(aggregate.merge(halves, ["user_id"], wanted), ["user_id"], wanted)


@query("SELECT l_returnflag, min(l_quantity > 49) AS least, max(l_quantity > 49) AS most FROM lineitem GROUP BY ALL")
def agg_boolean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(aggregate.grouped_min(c("l_quantity") > 49, "bool").alias("least"), aggregate.grouped_max(c("l_quantity") > 49, "bool").alias("most"))


# Lists and vectors.
@query("SELECT vec_id, len(embedding) AS n, floor(embedding[2] * 100000::FLOAT)::BIGINT AS second FROM embeddings WHERE label % 2 = 0")
def list_filter(spark, sf_dir):
    kept = select.filter_(table(spark, sf_dir, "embeddings"), c("label") % 2 == 0)
    return kept.select("vec_id", lists.list_len(c("embedding")).alias("n"), F.floor(F.get("embedding", F.lit(1)) * F.lit(100000.0).cast("float")).alias("second"))


@query("SELECT event_id, event_id % 100 AS i, label, len(embedding) AS n FROM events JOIN embeddings ON vec_id = event_id % 100")
def list_take(spark, sf_dir):
    indices = table(spark, sf_dir, "events").select("event_id", (c("event_id") % 100).alias("i"))
    return select.take(table(spark, sf_dir, "embeddings"), indices, "i", "vec_id").select("event_id", "i", "label", lists.list_len(c("embedding")).alias("n"))


_QUERY = [round(((k * 37) % 64) / 32 - 1, 4) for k in range(64)]
_QUERY_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in _QUERY) + "]"
per_row("list_len", "embeddings", "vec_id", lambda: {"n": lists.list_len(c("embedding")), "none": _shown(lists.list_len(F.when(c("vec_id") < 0, c("embedding"))), "long")}, "len(embedding) AS n, -1::BIGINT AS none")
# Doubles are summed in the lists' order on either side, and shown as whole numbers of a small unit.
_SQUARES = "list_reduce(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)"
_PRODUCTS = f"list_reduce(list_transform(list_zip(embedding::DOUBLE[], {_QUERY_SQL}), lambda z: z[2] * z[1]), lambda a, b: a + b)"
per_row("ext_list_sum", "embeddings", "vec_id", lambda: {"s": F.floor(lists.list_sum(c("embedding")) * 10000)}, "floor(list_reduce(embedding::DOUBLE[], lambda a, b: a + b) * 10000)::BIGINT AS s")
per_row("vec_dot", "embeddings", "vec_id", lambda: {"d": F.floor(vec.dot(vec.literal(_QUERY, "double"), c("embedding"), "double") * 100000)}, f"floor({_PRODUCTS} * 100000)::BIGINT AS d")
per_row("vec_norm", "embeddings", "vec_id", lambda: {"v": F.transform(vec.norm(c("embedding"), "double"), lambda x: F.floor(x * 100000))}, f"list_transform(embedding, lambda x: floor(x::DOUBLE / sqrt({_SQUARES}) * 100000)::BIGINT) AS v")


@query(f"SELECT vec_id AS index FROM embeddings ORDER BY {_SQUARES} - 2 * {_PRODUCTS}, vec_id LIMIT 1")
def vec_nearest(spark, sf_dir):
    return vec.nearest_neighbor(table(spark, sf_dir, "embeddings"), _QUERY, "embedding", "vec_id")


# Values on the driver: the tables are small, as the operator is for.
SHOWN = {"u64": "bigint", "bytes": "string"}
for kind, column, sql in (("i64", "n_regionkey", "n_regionkey::BIGINT"), ("u64", "n_regionkey", "n_regionkey::BIGINT"), ("u8", "n_regionkey", "n_regionkey::SMALLINT"), ("f64", "n_regionkey", "n_regionkey::DOUBLE"), ("bytes", "n_name", "n_name")):
    for nonnull in (False, True):

        def run(spark, sf_dir, kind=kind, column=column, nonnull=nonnull):
            df = table(spark, sf_dir, "nation").select("n_nationkey", F.when(c("n_nationkey") % 5 > 0, c(column)).alias("x"))
            values = [(p, None if v is None else Decimal(v) if kind == "u64" else v) for p, v in iterate(df, "x", kind, "n_nationkey", nonnull, indexed=True)]
            return spark.createDataFrame(values, f"n_nationkey int, v {ITERATED[kind]}").select("n_nationkey", c("v").isNull().alias("null"), F.coalesce(c("v").cast(SHOWN.get(kind, ITERATED[kind])), F.lit("" if kind == "bytes" else 0)).alias("v"))

        name = f"iter_{kind}" + "_nonnull" * nonnull
        QUERIES[name] = run
        ORACLE_SQL[name] = f"SELECT n_nationkey, n_nationkey % 5 = 0 AS null, CASE WHEN n_nationkey % 5 > 0 THEN {sql} ELSE {"''" if kind == 'bytes' else 0} END AS v FROM nation" + " WHERE n_nationkey % 5 > 0" * nonnull


@query("SELECT * FROM (VALUES ('l_orderkey', 'i64'), ('l_linenumber', 'i32'), ('l_quantity', 'f64'), ('l_returnflag', 'utf8')) t(name, logical)")
def type_logical(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    return spark.createDataFrame([(n, logical_type(df, n)) for n in names], "name string, logical string")


@query("""SELECT * FROM (VALUES ('i8', 'i32', 'i32'), ('u8', 'i8', 'i64'), ('i64', 'f32', 'f64'), ('utf8', 'binary', 'utf8'), ('u16', 'u64', 'u64'), ('bool', 'i16', 'i16')) t(a, b, dominant)""")
def type_dominant(spark, sf_dir):
    pairs = [("i8", "i32"), ("u8", "i8"), ("i64", "f32"), ("utf8", "binary"), ("u16", "u64"), ("bool", "i16")]
    return spark.createDataFrame([(a, b, dominant_type(a, b)) for a, b in pairs], "a string, b string, dominant string")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS total, min(l_partkey) AS least, max(l_partkey) AS most FROM lineitem
WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag LIKE 'A%' GROUP BY ALL ORDER BY n DESC, l_returnflag, l_linestatus LIMIT 5""")
def flagship(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where(cmp.between(c("l_quantity"), F.lit(10), F.lit(20)) & cmp.like(c("l_returnflag"), "A%"))
    out = df.groupBy("l_returnflag", "l_linestatus").agg(aggregate.count().alias("n"), aggregate.grouped_sum(c("l_quantity"), "f64").alias("total"), F.min("l_partkey").alias("least"), F.max("l_partkey").alias("most"))
    return out.orderBy(c("n").desc(), "l_returnflag", "l_linestatus").limit(5)
