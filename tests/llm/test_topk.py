import math
import random

import numpy as np
import pytest
from compare import duck_rows, spark_rows

from quern.llm import registry, topk
from quern.llm.topk import products, search, top_inner_products


def plainly(rows, every=50, top=5):
    """Rows (query_id, rank, vec_id, score) as the contract says them; Python's integers throughout."""
    usable = [(i, [math.floor(256 * c) for c in x]) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for n, (q, a) in enumerate(usable):
        if q is not None and q % every == 0:
            scored = sorted(((-min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1), i is None, i or 0) for m, (i, b) in enumerate(usable) if m != n))
            out += [(q, r, None if no else i, -s) for r, (s, no, i) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def _rows(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=repr)


def test_query_equals_its_sql(spark, tables):
    got = spark_rows(registry.queries()["op12_exact_topk"](spark, tables))
    assert got == duck_rows(registry.oracle_sql()["op12_exact_topk"], tables) and len(got) == 50


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_a_plain_version_on_odd_rows(spark, kind):
    rnd = random.Random(12)
    rows = [(i, [rnd.choice([-1.0, -0.001, 0.0, 0.25, 1.0]) for _ in range(8)]) for i in range(400)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (None, rows[50][1]), (None, rows[50][1]), (100, None), (150, [0.1, None]), (200, [math.nan] * 8), (250, [math.inf] + [0.0] * 7)]
    rows += [(300, []), (301, [1.0]), (350, [0.5] * 11), (-50, [0.0] * 8), (0, [-2.0] * 8)]
    df = spark.createDataFrame([(*r, 1, 2, "v") for r in rows], f"vec_id long, embedding array<{kind}>, part int, at int, v string").repartition(3)
    assert _rows(top_inner_products(df)) == plainly(rows)


def test_large_components_are_added_exactly(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.choice([3, 20, 24]) for _ in range(6)]) for i in range(300)]
    rows += [(1000, [2.0**50, -3.0]), (1050, [2.0**50, 5.0]), (1051, [-(2.0**60), 1.0])]
    assert _rows(top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))) == plainly(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, [1.0]), (50, [1.0])], [(50, [0.5, 0.5])] * 7])
def test_few_rows(spark, rows):
    assert _rows(top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))) == plainly(rows)


def test_strips_groups_and_small_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 16)))]
    for name, value in (("BLOCK", 7), ("STRIP", 16 * 50), ("GROUP", 3), ("AT_ONCE", 2)):
        monkeypatch.setattr(topk, name, value)
    assert _rows(top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, 6)) == plainly(rows, 10, 6)


def test_blocks_below_the_kth_score_are_not_scored():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32)) * 60
    v = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 32)) * 4)
    q, cuts = v[::200], np.arange(0, 4001, 100)
    got = search(q, np.arange(0, 4000, 200), np.full(20, -np.inf), v, np.arange(4000), cuts, 5)
    s = products(q, v)
    s[np.arange(20), np.arange(0, 4000, 200)] = -np.inf
    want = [(-s[i], np.arange(4000)) for i in range(20)]
    assert [sorted(got.place[got.query == i].tolist()) for i in range(20)] == [sorted(np.lexsort((p, x))[:5].tolist()) for x, p in want]
    assert got.met < 20 * 40 / 4
