import random
from collections import Counter

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from quern.operators import sketches
from quern.operators.cubes import cube, grouped_distinct, rollup
from quern.operators.snapshots import applied, difference
from quern.plans import aggregate_queries
from quern.sources.properties import property_edges


@pytest.mark.parametrize("name", sorted(aggregate_queries.queries()))
def test_query_equals_its_sql(spark, tables, name):
    got = spark_rows(aggregate_queries.queries()[name](spark, tables))
    assert got == duck_rows(aggregate_queries.oracle_sql()[name], tables) and len(got) > 300


def _multiset(df):
    return Counter(tuple(r) for r in df.collect())


def _edges(seed, n):
    rnd = random.Random(seed)
    return [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "x", "y", "z"]), rnd.choice([None, 0.5, 1.5])) for _ in range(n)]


@pytest.mark.parametrize("a, b", [(40, 40), (0, 30), (30, 0), (0, 0), (25, 25)])
def test_a_difference_applied_gives_the_second_snapshot(spark, a, b):
    kind = "u long, v string, w double"
    before, after = _edges(1, a), _edges(1 if a == b == 25 else 2, b)
    old, new = spark.createDataFrame(before, kind).repartition(3), spark.createDataFrame(after, kind).repartition(2)
    changes = difference(old, new, ["u", "v"])
    want = Counter(after)
    want.subtract(Counter(before))
    want = {k: n for k, n in want.items() if n}
    got = {(r["u"], r["v"], r["w"]): (r["n"], r["kind"]) for r in changes.collect()}
    assert {k: n for k, (n, _) in got.items()} == want
    for (u, v, _), (_, k) in got.items():
        signs = {n > 0 for (x, y, _), n in want.items() if (x, y) == (u, v)}
        assert k == ("change" if len(signs) == 2 else "insert" if signs == {True} else "delete")
    assert _multiset(applied(old, changes)) == Counter(after)


def test_changes_that_do_not_fit_and_clashing_names_raise(spark):
    old = spark.createDataFrame([(1, 2)], "u long, v long")
    changes = spark.createDataFrame([(1, 2, -2)], "u long, v long, n long")
    with pytest.raises(Exception, match="more rows are taken"):
        applied(old, changes).collect()
    with pytest.raises(ValueError):
        difference(old.withColumn("n", F.lit(1)), old.withColumn("n", F.lit(1)), ["u"])


def test_equal_rows_cancel_before_the_shuffle(spark):
    """Two snapshots of 20,000 rows that differ in one: what the second shuffle moves is that one."""
    old = spark.range(20000).select((F.col("id") % 100).alias("u"), F.col("id").alias("v"))
    new = old.unionByName(spark.sql("select 5L as u, -1L as v"))
    assert [tuple(r) for r in difference(old, new, ["u"]).collect()] == [(5, -1, 1, "insert")]
    assert _multiset(applied(old, difference(old, new, ["u"]))) == _multiset(new)


@pytest.mark.parametrize("levels", [cube(["a", "b", "c"]), rollup(["a", "b", "c"]), [["b"], []], [["a", "c"], ["b"]]])
def test_groups_of_all_levels_equal_plain_counts(spark, levels):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 2]), rnd.choice(["x", None]), rnd.randrange(3), rnd.choice([None, 1, 2, 3, 4]), rnd.randrange(100)) for _ in range(300)]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in grouped_distinct(spark.createDataFrame(rows, "a long, b string, c long, item long, cents long").repartition(4), ["a", "b", "c"], levels, "item", ["cents"]).collect()}
    want = {}
    for x in levels:
        number = sum(1 << (2 - i) for i, d in enumerate("abc") if d not in x)
        for r in rows:
            n, items, cents = want.setdefault((*(v if d in x else None for d, v in zip("abc", r, strict=False)), number), (0, set(), 0))
            want[(*(v if d in x else None for d, v in zip("abc", r, strict=False)), number)] = (n + 1, items | ({r[3]} - {None}), cents + r[4])
    assert got == {k: (n, len(i), c) for k, (n, i, c) in want.items()}


def test_a_cube_reads_its_table_once(spark, small_tables):
    plan = aggregate_queries.market_cube(spark, small_tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_partkey") and plan.count("lineitem.parquet") == 1
    none = spark.createDataFrame([], "a long, b string, item long, cents long")
    assert grouped_distinct(none, ["a", "b"], cube(["a", "b"]), "item", ["cents"]).count() == 0
    with pytest.raises(ValueError):
        grouped_distinct(none, ["a"], [["z"]], "item", [])


def test_nested_and_wrong_properties(spark):
    rows = [(1, '{"a": 1, "b": {"c": "x", "d": [1, 1, 2, {"e": true}]}, "n": null}'), (1, '{"a": 1}'), (1, '{"a": "1"}'), (2, '{"p": {"q": {"r": {"s": {"t": 1}}}}}'), (2, "{}"), (2, '{"l": []}')]
    wrong = [(3, "{bad"), (3, "{bad"), (3, ""), (3, None), (3, "17"), (3, "[1]"), (None, '{"a": 1}'), (3, "null")]
    edges, rejected = property_edges(spark.createDataFrame(rows + wrong, "u long, props string"), "u", "props")
    got = {(r["node"], r["path"], r["kind"], r["value"]): r["weight"] for r in edges.collect()}
    assert got == {
        (1, "a", "number", "1"): 2, (1, "a", "string", "1"): 1, (1, "b.c", "string", "x"): 1, (1, "b.d[]", "number", "1"): 2, (1, "b.d[]", "number", "2"): 1,
        (1, "b.d[].e", "boolean", "true"): 1, (1, "n", "null", None): 1, (2, "p.q.r.s", "nested", '{"t":1}'): 1,
    }
    assert Counter({(r["node"], r["json"], r["reason"]): r["weight"] for r in rejected.collect()}) == {(3, "{bad", "not JSON"): 2, (3, "", "empty text"): 1, (3, None, "no properties"): 1, (3, "17", "no object"): 1, (3, "[1]", "no object"): 1, (None, '{"a": 1}', "no node"): 1, (3, "null", "no object"): 1}


def test_daily_sketches_are_merged_within_their_bounds_and_grow_by_a_day(spark, tmp_path):
    folder = str(tmp_path / "sketches")
    n = 120_000
    rows = spark.range(n).select(F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id % 21 as int))").alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") % 30011).alias("who"), (F.col("id") * 7919 % n).alias("value"))
    day = F.to_date("ts")
    sketches.add_days(sketches.daily(rows.where(day < "2024-01-20"), "ts", "kind", "who", "value"), folder)
    old = {f for f in sketches.kept(spark, folder).inputFiles()}
    sketches.add_days(sketches.daily(rows.where(day >= "2024-01-20"), "ts", "kind", "who", "value"), folder)
    assert old < {f for f in sketches.kept(spark, folder).inputFiles()}
    got = {(str(r["period"]), r["key"]): r for r in sketches.merged(sketches.kept(spark, folder), "week", [0.1, 0.5, 0.99]).collect()}
    exact = rows.groupBy(F.date_trunc("week", "ts").cast("date").alias("period"), F.col("kind").alias("key")).agg(F.count("*").alias("n"), F.count_distinct("who").alias("d"), F.array_sort(F.collect_list("value")).alias("v")).collect()
    assert len(got) == len(exact) == 6
    for r in exact:
        g = got[str(r["period"]), r["key"]]
        assert g["n"] == r["n"] and abs(g["n_items"] - r["d"]) <= 4 * 1.04 / 64 * r["d"]
        for i, q in enumerate((0.1, 0.5, 0.99)):
            rank = sum(v <= g[f"q{i}"] for v in r["v"]) / r["n"]
            assert abs(rank - q) <= 0.02, (q, rank)


def test_sketches_of_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "ts timestamp, kind string, who long, value double")
    assert sketches.daily(none, "ts", "kind", "who", "value").count() == 0
    rows = spark.sql("select timestamp'2024-01-01' as ts, cast(null as string) as kind, cast(null as long) as who, 1D as value union all select null, 'a', 1, 2D")
    got = sketches.merged(sketches.daily(rows, "ts", "kind", "who", "value"), "month", [0.5]).collect()
    assert [(str(r["period"]), r["key"], r["n"], r["n_items"], r["q0"]) for r in got] == [("2024-01-01", None, 1, 0, 1.0)]
