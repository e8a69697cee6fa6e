from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.sources.edge_tables import buckets_for, measured_bytes, sized_join, write_buckets


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[-1]


def _multiset(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture()
def tables_of_edges(spark, small_tables):
    lines = spark.read.parquet(f"{small_tables}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = spark.read.parquet(f"{small_tables}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    for name, df in (("edges_lines", lines), ("edges_orders", orders)):
        write_buckets(df, name, ["l_orderkey"], 8)
    yield lines, orders
    for name in ("edges_lines", "edges_orders"):
        spark.sql(f"drop table {name}")


def test_buckets_are_joined_and_grouped_without_a_shuffle(spark, tables_of_edges):
    lines, orders = tables_of_edges
    a, b = spark.table("edges_lines"), spark.table("edges_orders")
    merged = sized_join(a, b, ["l_orderkey"], sent=0)
    grouped = merged.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    for df in (merged, grouped):
        assert "SortMergeJoin" in _plan(df) and "Exchange" not in _plan(df)
    plain = lines.join(orders, "l_orderkey")
    assert _multiset(merged) == _multiset(plain) and _multiset(grouped) == _multiset(plain.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")))
    # each bucket is one file
    assert len(a.inputFiles()) == 8


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti", "right", "full"])
def test_both_ways_give_the_same_rows(spark, how):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z"), (1, "x")], "k long, w string")
    sent, merged = sized_join(left, right, ["k"], how), sized_join(left, right, ["k"], how, sent=0)
    assert _multiset(sent) == _multiset(merged) == _multiset(left.join(right, "k", how))
    assert "SortMergeJoin" in _plan(merged) and ("BroadcastHashJoin" in _plan(sent)) == (how not in ("right", "full"))


def test_sizes_are_counted_not_guessed(spark):
    few = spark.range(3).select("id", F.lit("é" * 1000).alias("text"), F.array(F.lit(1)).alias("x"))
    assert 3 * 2000 < measured_bytes(few) < 3 * 2200
    assert measured_bytes(few.limit(0)) == 0
    # rows alone can pass the bound, and are not all read then
    assert measured_bytes(spark.range(10**9), 1000) > 1000
    assert [buckets_for(n) for n in (0, 1, 1 << 22, (1 << 22) + 1, 5 << 22, 1 << 60)] == [1, 1, 1, 2, 8, 1 << 14]


def test_an_empty_table_and_nulls_have_buckets(spark):
    none = spark.createDataFrame([], "a long, b long")
    write_buckets(none, "edges_none", ["a"])
    write_buckets(spark.createDataFrame([(None, 1), (None, 2), (3, None)], "a long, b long"), "edges_some", ["a"], 2)
    try:
        assert spark.table("edges_none").count() == 0
        assert _multiset(spark.table("edges_some")) == Counter([(None, 1), (None, 2), (3, None)])
    finally:
        spark.sql("drop table edges_none")
        spark.sql("drop table edges_some")
