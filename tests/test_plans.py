"""Plans: what reaches the scan, what is shuffled, and that no Python runs."""

import os
import re

import pytest

from colonnade.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship(spark):
    text = plan(spark, "flagship")
    assert "GreaterThanOrEqual(l_quantity,10.0)" in text and "LessThan(l_quantity,20.0)" in text and "StringStartsWith(l_returnflag,A)" in text
    assert re.search(r"ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_returnflag:string,l_linestatus:string>", text)
    assert "TakeOrderedAndProject" in text and "partial_sum" in text and text.count("Exchange") == 1


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n.startswith(("cmp_", "str_", "arith_", "bool_", "cast_", "vec_", "red_", "agg_", "topk"))])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(spark, name)
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("name", ["cmp_lt", "arith_mul", "bool_not", "cast_truncate", "vec_dot", "str_like_prefix"])
def test_rows_are_not_shuffled(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["red_min", "red_sum", "agg_sum", "agg_most_recent", "vec_nearest"])
def test_sums_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("Exchange") == 1 and "partial_" in text


def test_only_named_columns_are_read(spark):
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan(spark, "bool_is_null")
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan(spark, "select_filter")
