import datetime
import random

import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from quern.operators import asof, intervals, slices
from quern.operators.asof import Stream, as_of
from quern.operators.intervals import overlapping
from quern.plans import temporal_queries


@pytest.mark.parametrize("name", sorted(temporal_queries.queries()))
def test_query_equals_its_sql(spark, tables, name):
    got = spark_rows(temporal_queries.queries()[name](spark, tables))
    assert got == duck_rows(temporal_queries.oracle_sql()[name], tables) and len(got) > 300


def _found(rows, events, strict=True):
    """For each (id, key, at): value of the event of its key that is last before it, ties to the larger value."""
    out = []
    for i, k, t in rows:
        before = [(x, v) for j, x, v in events if None not in (k, t, x, j) and j == k and (x < t if strict else x <= t)]
        out.append((i, max(before)[1] if before else None))
    return sorted(out, key=repr)


def _case(seed, keys, n=300):
    rnd = random.Random(seed)
    maybe = lambda x: None if rnd.random() < 0.05 else x
    left = [(i, maybe(rnd.choice(keys)), maybe(rnd.randrange(60))) for i in range(n)] + [(0, keys[0], 30)] * 2
    right = [(maybe(rnd.choice(keys)), maybe(rnd.randrange(60)), v) for v in range(n)]
    return left, right


def _run(spark, left, right, **more):
    a = spark.createDataFrame(left, "id long, k long, t long").repartition(3)
    b = spark.createDataFrame(right, "who long, x long, v long").repartition(3)
    got = as_of(a, ["k"], "t", [Stream("s", b, ["who"], "x", ["v"], ["v"])], **more)
    assert got.columns == ["id", "k", "t", "s"]
    return sorted(((r["id"], r["s"] and r["s"]["v"]) for r in got.collect()), key=repr)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("limit", [1 << 20, 40, 3])
def test_as_of_equals_a_plain_search(spark, strict, limit):
    for seed, keys in ((1, [1, 2, 3]), (2, [7] * 9 + [8])):
        left, right = _case(seed, keys)
        assert _run(spark, left, right, strict=strict, limit=limit) == _found(left, right, strict)


@pytest.mark.parametrize("left, right", [([], []), ([(1, 1, 1)], []), ([], [(1, 1, 1)]), ([(1, None, None)], [(None, None, 1)])])
def test_as_of_with_empty_sides(spark, left, right):
    assert _run(spark, left, right, limit=1) == _found(left, right)


def test_several_streams_of_different_kinds_take_one_shuffle(spark):
    left = spark.sql("select * from values (1, 10), (1, 20), (2, 5) as t(k, at)")
    one = spark.sql("select * from values (1, 5, 'a', 1.5D), (1, 15, 'b', 2.5D), (1, 15, 'c', 0.5D) as t(k, at, s, d)")
    two = spark.sql("select * from values (1, 11, true), (2, 4, false) as t(who, w, flag)")
    got = as_of(left, ["k"], "at", [Stream("one", one, ["k"], "at", ["s", "d"], ["d"]), Stream("two", two, ["who"], "w", ["flag"])])
    assert sorted(((r["k"], r["at"], r["one"] and tuple(r["one"]), r["two"] and tuple(r["two"])) for r in got.collect()), key=repr) == [(1, 10, ("a", 1.5), None), (1, 20, ("b", 2.5), (True,)), (2, 5, None, (False,))]
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_a_user_with_half_of_all_rows_is_cut_into_slices(spark):
    """Counts the rows that are sorted together, and the rows of each task that the sort reads."""
    n, limit = 20000, 1000
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"), "id")
    events = spark.range(n).select((F.col("id") % 50).alias("who"), (F.col("id") + 1).alias("x"))
    merged, keys, _ = asof.merged(rows, ["k"], "t", [Stream("s", events, ["who"], "x", ["x"])], True)
    cuts = slices.bounds(merged, keys, "__at", limit)
    together = merged.join(cuts, keys, "left").groupBy(*keys, slices.slice_of(F.col("__at"), F.col("bounds")).alias("slice")).count().toPandas()
    hot = together[together["__k0"] == 0]
    assert len(hot) >= 10 and hot["count"].max() <= 1.2 * limit and hot["count"].sum() == n // 2 + n // 50
    got = as_of(rows, ["k"], "t", [Stream("s", events, ["who"], "x", ["x"])], limit=limit)
    tasks = got.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert tasks.max() < 0.45 * n
    want = {(k, t): max((x for x in range((t - 1) // 50 * 50 + k % 50 + 1 - 100, t, 50) if 0 < x < t and (x - 1) % 50 == k), default=None) for k, t in ((0 if i % 2 == 0 else i, i) for i in range(n)) if k < 50}
    assert {(r["k"], r["t"]): r["s"] and r["s"]["x"] for r in got.where("k < 50").collect()} == want


def _pairs(left, right):
    return sorted(((i, j) for i, k, a, b in left for j, m, c, d in right if k is not None and k == m and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b), key=repr)


def _spans(seed, n, keys, longest):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a = rnd.randrange(1000)
        out.append((i, rnd.choice(keys), a, a + rnd.choice([-1, 0, 1, 5, longest])))
    return out + [(n, keys[0], None, 4), (n + 1, keys[0], 4, None), (n + 2, None, 1, 2), (0, keys[0], 5, 500), (0, keys[0], 5, 500)]


@pytest.mark.parametrize("limit", [1 << 20, 60, 9])
def test_overlaps_equal_all_pairs(spark, limit):
    kind = "id long, k long, a long, b long"
    for seed, keys, longest in ((1, [1, 2, 3, None], 50), (2, [5] * 9 + [6], 20), (3, [1], 900)):
        left, right = _spans(seed, 150, keys, longest), _spans(seed + 10, 120, keys, longest)
        a, b = spark.createDataFrame(left, kind).repartition(3), spark.createDataFrame(right, kind).repartition(2)
        got = overlapping(a, b, (["k"], ["k"]), (("a", "b"), ("a", "b")), limit)
        assert sorted(((r["left"]["id"], r["right"]["id"]) for r in got.collect()), key=repr) == _pairs(left, right)


def test_overlaps_without_a_key_and_with_times(spark):
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    left, right = [(i, 1, a, b) for i, k, a, b in _spans(4, 200, [1], 40) if a and b], [(i, 1, a, b) for i, k, a, b in _spans(5, 200, [1], 40) if a and b]
    frame = lambda rows: spark.createDataFrame([(i, day(a), day(b)) for i, _, a, b in rows], "id long, a timestamp_ntz, b timestamp_ntz")
    got = overlapping(frame(left), frame(right), ([], []), (("a", "b"), ("a", "b")), 25)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(((r["left"]["id"], r["right"]["id"]) for r in got.collect()), key=repr) == _pairs(left, right)


def test_overlaps_of_nothing(spark):
    none = spark.createDataFrame([], "k long, a long, b long")
    some = spark.createDataFrame([(1, 1, 2)], "k long, a long, b long")
    assert overlapping(none, some, (["k"], ["k"]), (("a", "b"), ("a", "b")), 1).count() == 0
    assert overlapping(some, none, ([], []), (("a", "b"), ("a", "b")), 1).count() == 0


def test_a_crowded_bin_is_cut_into_tiles(spark):
    """All intervals are long, so every bin holds nearly all rows; no tile has many more than the limit of either side."""
    rows = spark.range(4000).select("id", F.lit(1).alias("k"), F.col("id").alias("a"), (F.col("id") + 100000).alias("b"))
    few = spark.range(40).select("id", F.lit(1).alias("k"), (F.col("id") * 100).alias("a"), (F.col("id") * 100).alias("b"))
    got = overlapping(rows, few, (["k"], ["k"]), (("a", "b"), ("a", "b")), 500)
    assert got.count() == sum(1 for i in range(4000) for j in range(40) if i <= j * 100)
    keys = ["__k0"]
    cuts = slices.bounds(rows.select(F.lit(False).alias("__k0"), F.col("a").alias("at")), keys, "at", 500)
    laid = intervals._laid(rows.drop("k"), [], ("a", "b"), cuts, "left")
    loads = laid.groupBy("__k0", "bin").agg(F.ceil(F.count("*") / 500).cast("int").alias("i"), F.lit(1).alias("j"))
    tiles = intervals._tiled(laid, loads, keys, "left", "i", "j").groupBy("bin", "i").count().toPandas()["count"]
    assert tiles.max() < 700 and tiles.sum() == laid.count()
