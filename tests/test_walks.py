import random

import pytest

from quern.operators.components import connected_components
from quern.operators.walks import cheapest_walks


def _plainly(edges, starts):
    """Bellman-Ford from each start."""
    out = {}
    edges = [e for e in edges if None not in e]
    for s in {x for x in starts if x is not None}:
        cost = {s: 0}
        while True:
            new = dict(cost)
            for u, v, w in edges:
                if u in cost and (v not in new or cost[u] + w < new[v]):
                    new[v] = cost[u] + w
            if new == cost:
                break
            cost = new
        out |= {(s, v): c for v, c in cost.items()}
    return out


def _walks(spark, edges, starts, kind="long", **more):
    df = spark.createDataFrame(edges, f"a long, b long, w {kind}")
    got = cheapest_walks(df, "a", "b", "w", spark.createDataFrame([(s,) for s in starts], "s long"), **more).collect()
    assert len(got) == len({(r["start"], r["node"]) for r in got})
    return {(r["start"], r["node"]): r["cost"] for r in got}


@pytest.mark.parametrize("hub", [1 << 20, 3])
def test_costs_equal_bellman_ford(spark, hub):
    rnd = random.Random(6)
    edges = [(rnd.choice([0, rnd.randrange(40)]), rnd.randrange(40), rnd.randrange(1, 30)) for _ in range(200)]
    edges += [(0, 1, 5), (0, 1, 2), (None, 1, 1), (1, None, 1), (2, 3, None), (4, 4, 1)]
    starts = [0, 0, 5, 17, 99, None]
    assert _walks(spark, edges, starts, hub=hub) == _plainly(edges, starts)


def test_negative_costs_and_cycles(spark):
    edges = [(1, 2, 5), (2, 3, -4), (1, 3, 2), (3, 4, 1), (4, 2, 3)]
    assert _walks(spark, edges, [1]) == _plainly(edges, [1]) == {(1, 1): 0, (1, 2): 5, (1, 3): 1, (1, 4): 2}
    with pytest.raises(RuntimeError):
        _walks(spark, [(1, 2, 1), (2, 1, -2)], [1], max_rounds=6)


def test_empty_tables_and_doubles(spark):
    assert _walks(spark, [], [1]) == {(1, 1): 0}
    assert _walks(spark, [(1, 2, 3)], []) == {}
    assert _walks(spark, [(1, 2, 0.5), (2, 3, 0.25)], [1], "double") == {(1, 1): 0.0, (1, 2): 0.5, (1, 3): 0.75}


def test_a_chain_of_200_nodes(spark):
    edges = [(i, i + 1, 1) for i in range(199)] + [(0, 150, 1000)]
    assert _walks(spark, edges, [0]) == {(0, i): i for i in range(200)}


def test_a_hub_is_dealt_over_tasks(spark):
    """A million edges of one node in 16 parts: each task of the relaxing join reads a small share, and the costs are whole."""
    from pyspark.sql import functions as F

    n = 1_000_000
    edges = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"), (F.col("id") % 7 + 1).alias("w")).unionByName(spark.sql("select 5L as a, 0L as b, 2L as w"))
    got = cheapest_walks(edges, "a", "b", "w", spark.sql("select 5L as s"), hub=n // 16)
    assert got.agg(F.count("*"), F.sum("cost")).first() == (n + 1, 2 + sum(2 + i % 7 + 1 for i in range(1, n + 1) if i != 5))
    parts = edges.where("a = 0").groupBy(F.pmod(F.xxhash64("b"), F.lit(16))).count().toPandas()["count"]
    assert len(parts) == 16 and parts.max() < 1.1 * n / 16


def test_components_stop_only_when_edges_are_the_same(spark):
    """A long path and many pairs: edge counts repeat over rounds while edges still move."""
    path = [(i, i + 1) for i in range(300)]
    random.Random(1).shuffle(path)
    pairs = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(100)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path + pairs, "u long, v long"), "u", "v").collect()}
    assert got == {i: 0 for i in range(301)} | {x: a for a, b in pairs for x in (a, b)}
