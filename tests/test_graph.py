import random

import pytest
from compare import duck_rows, spark_rows

from quern.operators.components import connected_components
from quern.operators.graph import bipartite_degrees, k_hop, transition_edges
from quern.operators.projection import shared_groups
from quern.plans import graph_queries


@pytest.mark.parametrize("name", sorted(graph_queries.queries()))
def test_query_equals_its_sql(spark, tables, name):
    assert spark_rows(graph_queries.queries()[name](spark, tables)) == duck_rows(graph_queries.oracle_sql()[name], tables)


def _least(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(2, 1), (2, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(random.Random(4).randrange(200), i) for i in range(150)]])
def test_components_are_those_of_a_union_find(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r["node"]: r["component"] for r in connected_components(df, "u", "v").collect()} == _least(edges)


def test_components_random(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "u long, v long")
    want = _least([*edges, (3, 3)])
    assert {r["node"]: r["component"] for r in connected_components(df, "u", "v").collect()} == want


def test_transitions_with_nulls_and_ties(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, None, 3), (None, "a", 1), (2, "a", 1), (2, "b", 2)]
    df = spark.createDataFrame(rows, "who long, what string, at long")
    assert spark_rows(transition_edges(df, "who", "what", ["at"])) == sorted([("b", "a", 2), (None, "b", 1)], key=repr)


def test_degrees_and_hops_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert bipartite_degrees(none, "a", "b").count() == 0
    assert k_hop(none, "a", "b", none.select("a"), 2).count() == 0


def test_hops_keep_the_least_depth_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "a long, b long")
    starts = spark.createDataFrame([(1,)], "a long")
    assert spark_rows(k_hop(edges, "a", "b", starts, 3)) == [(0, 1, 1), (1, 2, 1), (1, 3, 1)]


@pytest.mark.parametrize("limit", [1 << 12, 4, 1])
@pytest.mark.parametrize("least", [1, 2])
def test_shared_groups_equal_a_plain_count(spark, limit, least):
    from collections import Counter
    from itertools import combinations

    rnd = random.Random(3)
    edges = [(rnd.choice([0, 0, rnd.randrange(20)]), rnd.randrange(30)) for _ in range(150)] + [(None, 1), (1, None), (5, 5), (5, 5)]
    groups = {}
    for g, n in edges:
        if g is not None and n is not None:
            groups.setdefault(g, set()).add(n)
    want = Counter(p for m in groups.values() for p in combinations(sorted(m), 2))
    got = shared_groups(spark.createDataFrame(edges, "g long, n long").repartition(3), "g", "n", least, limit).collect()
    assert {(r["a"], r["b"]): r["weight"] for r in got} == {p: k for p, k in want.items() if k >= least} and len(got) == len({(r["a"], r["b"]) for r in got})
    assert shared_groups(spark.createDataFrame([], "g long, n long"), "g", "n").count() == 0
