import numpy as np
import pytest

from quern.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, score string"


def _found(spark, rows, **more):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s") for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(A.nearest(df, **more).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def _true(rows, q, top=20):
    v = dict(rows)
    x = np.float32(v[q]).astype(float)
    scored = sorted(((-(np.float32(y).astype(float) * x).sum(), i) for i, y in rows if i != q))
    return [(k + 1, i, -s) for k, (s, i) in enumerate(scored[:top])]


def test_recall_against_brute_force(spark, tables):
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    hits, total = 0, 0
    got = {}
    for r in A.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for q, found in got.items():
        want = {i: s for _, i, s in _true(rows, q)}
        hits, total = hits + len(set(want) & set(found)), total + len(want)
        assert all(abs(found[i] - want[i]) < 1e-12 for i in set(want) & set(found))
    assert hits / total >= 0.9


@pytest.mark.parametrize("shard", [20_000, 30])
def test_ties_go_to_the_smaller_id_and_hot_cells_are_dealt_out(spark, monkeypatch, shard):
    monkeypatch.setattr(A, "SHARD", shard)
    monkeypatch.setattr(A, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6)) for i in range(0, 100)] + [(i, np.ones(6)) for i in range(100, 260)]
    got = _found(spark, rows)
    assert [i for _, i, _ in got[120]] == list(range(100, 120)) and len({s for _, _, s in got[120]}) == 1
    assert [i for _, i, _ in got[100]] == list(range(101, 121))


def test_fewer_rows_than_asked_for(spark):
    rows = [(i, [1.0, i, 2.0]) for i in range(5)]
    got = _found(spark, rows)
    want = _true(rows, 0)
    assert [(k, i) for k, i, _ in got[0]] == [(k, i) for k, i, _ in want] and set(got) == {0}
    assert _found(spark, [(0, [1.0])]) == {}


def test_vectors_of_no_use_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [None, 1.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (2, []), (3, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (5, [-1.0, 0.5]), (0, [1.0, 2.0])]
    got = _found(spark, rows)
    assert {q: [i for _, i, _ in x] for q, x in got.items()} == {0: [1, 5]}
    assert _found(spark, []) == {} and _found(spark, [(0, None)]) == {}


def test_recall_on_the_larger_table(spark):
    """Every query of 2,000 vectors beside brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = sorted((r["vec_id"], np.array(r["embedding"], float)) for r in rows.collect())
    ids, v = np.array([i for i, _ in table]), np.stack([x for _, x in table])
    got = {}
    for r in A.nearest(rows).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert len(got) == 100 and hits / (20 * len(got)) >= 0.9


def test_of_several_vectors_of_one_id_the_least_bytes_ask(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0])]
    asks = min((np.array(v).tobytes(), v) for i, v in rows if i == 0)[1]
    want = sorted(((-float(np.dot(asks, v)), i) for i, v in rows if i))
    assert [i for _, i, _ in _found(spark, rows)[0]] == [i for _, i in want]
