import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quern.operators import cubes, parts, projection
from quern.operators.cubes import cube, grouped_distinct
from quern.operators.intervals import overlapping
from quern.plans import aggregate_queries, temporal_queries


def _dealt(df):
    """(expressions, partitions) of each shuffle of the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return [(re.sub(r"#\d+L?", "", what), int(n)) for what, n in re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", plan)]


def test_partitions_follow_the_rows(spark):
    """The session of the tests asks for 4."""
    assert [parts.parts(spark, n) for n in (0, 1, parts.LEAST, 2 * parts.LEAST, 4 * parts.ROWS, 4 * parts.ROWS + 1, 400 * parts.ROWS)] == [1, 1, 1, 2, 4, 5, 400]


def test_copies_for_levels_are_dealt_by_value_in_partitions_of_bounded_size(spark, monkeypatch):
    """Half of the rows have one value; the copies of no other shuffle than that of the counts grow with the rows."""
    monkeypatch.setattr(parts, "ROWS", 500)
    monkeypatch.setattr(cubes, "COPIES", 1000)
    n = 5000
    rows = spark.range(n).select((F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("item"), F.lit(2).cast("long").alias("cents"))
    for size in (None, n):
        got = grouped_distinct(rows, ["a", "b"], cube(["a", "b"]), "item", ["cents"], size)
        assert _dealt(got)[1:] == [("__value", 20), ("__value, __from", 10)] and "__value" not in _dealt(got)[0][0]
        found = {(r["a"], r["b"]): (r["n"], r["n_distinct"], r["cents"]) for r in got.collect()}
        want = {}
        for i in range(n):
            for key in ((i % 3, i % 5), (i % 3, None), (None, i % 5), (None, None)):
                want.setdefault(key, []).append(0 if i % 2 == 0 else i)
        assert found == {k: (len(v), len(set(v)), 2 * len(v)) for k, v in want.items()}


def test_pairs_of_nodes_are_made_and_added_up_in_partitions_of_bounded_size(spark, monkeypatch):
    """2000 groups of four among 4000 nodes, so 12,000 pairs; and 500 groups among four nodes, whose pairs must repeat."""
    monkeypatch.setattr(parts, "ROWS", 500)
    monkeypatch.setattr(projection, "PAIRS", 1000)
    edges = spark.range(8000).select(F.floor(F.col("id") / 4).alias("g"), (F.col("id") * 7 % 4001).alias("n"))
    got = projection.shared_groups(edges, "g", "n")
    assert _dealt(got) == [("a, b", 12), ("g", 32), ("g", 32)]
    want = Counter(tuple(sorted((i * 7 % 4001, j * 7 % 4001))) for g in range(2000) for i, j in combinations(range(4 * g, 4 * g + 4), 2))
    assert {(r["a"], r["b"]): r["weight"] for r in got.collect()} == want
    few = projection.shared_groups(spark.range(2000).select(F.floor(F.col("id") / 4).alias("g"), (F.col("id") % 4).alias("n")), "g", "n")
    assert _dealt(few) == [("a, b", 4), ("g", 8), ("g", 8)]
    assert {(r["a"], r["b"]): r["weight"] for r in few.collect()} == {p: 500 for p in combinations(range(4), 2)}


@pytest.mark.parametrize("limit", [1 << 17, 300])
def test_overlaps_are_dealt_in_partitions_of_bounded_size(spark, monkeypatch, limit):
    """4000 and 2000 intervals of 50 keys, and 2000 of one key, which the lower limit cuts into bins."""
    monkeypatch.setattr(parts, "ROWS", 500)
    rows = lambda n, step: spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), (F.col("id") * step).alias("a"), (F.col("id") * step + 3).alias("b"))
    for size in (None, 6000):
        got = overlapping(rows(4000, 1), rows(2000, 2), (["k"], ["k"]), (("a", "b"), ("a", "b")), limit, size=size)
        dealt = [n for what, n in _dealt(got) if what.startswith("__k0")]
        assert len(dealt) >= 2 and min(dealt[:2]) >= 12
        key = lambda i: 0 if i % 2 == 0 else i % 50
        assert Counter((r["left"]["id"], r["right"]["id"]) for r in got.collect()) == Counter((i, j) for j in range(2000) for i in range(2 * j - 3, 2 * j + 4) if 0 <= i < 4000 and key(i) == key(j))


def test_orders_and_lines_are_joined_in_partitions_of_bounded_size(spark, tables, monkeypatch):
    """15,000 orders and 60,000 lines."""
    monkeypatch.setattr(parts, "ROWS", 7500)
    dealt = _dealt(temporal_queries.order_shipment_overlaps(spark, tables))
    assert {what for what, _ in dealt} == {"__k0", "o_orderkey", "l_orderkey"} and {n for _, n in dealt} == {10}
    dealt = _dealt(aggregate_queries.market_cube(spark, tables))
    assert ("l_orderkey", 10) in dealt and ("o_orderkey", 10) in dealt and ("o_custkey", 2) in dealt
