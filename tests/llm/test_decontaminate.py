import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from test_licenses import _words

from quern.llm import _text as T
from quern.llm import decontaminate as D


def brute(docs, items, window=13):
    windows = {}
    for i, t in items:
        w = _words(t)
        k = min(window, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(k, {}).setdefault(tuple(w[s : s + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, found = _words(t), set()
        hit = np.zeros(len(w), bool)
        for k, at in windows.items():
            for s in range(len(w) - k + 1):
                if x := at.get(tuple(w[s : s + k])):
                    hit[s : s + k] = True
                    found |= {str(i) for i in x if i is not None}
        n = int(hit.sum())
        out.append((d, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return sorted(out, key=repr)


def _made(seed=3):
    rnd = random.Random(seed)
    text = lambda n, v: " ".join(rnd.choice("abcdefgh"[:v]) for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60), 2 if i % 3 else 4)) for i in range(150)]
    docs += [(None, "a b"), (5, None), (7, ""), (7, ""), (8, "zzz " * 4000), (9, "É, é! zzz")]
    items = [(1, text(20, 2)), (2, text(5, 2)), (3, "zzz"), (4, ""), (5, None), (10, text(14, 4)), (None, text(13, 2)), (1, "h")]
    return docs, items


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("item_bytes", [1 << 20, 30])
def test_report_is_that_of_a_plain_search(spark, monkeypatch, item_bytes):
    monkeypatch.setattr(D, "ITEM_BYTES", item_bytes)
    docs, items = _made()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert _rows(D.contamination(d, b)) == want
    kept = D.decontaminated(d.selectExpr("doc_id", "text", "1 as n_words", "'x' as items"), b)
    assert kept.columns == ["doc_id", "text", "n_words", "items"] and kept.count() == len(docs) - sum(w[5] for w in want)


def test_items_without_words_stay_where_they_are_and_ids_count(spark, monkeypatch):
    """100,000 empty items with ids: none comes to the driver; items of one word each are dealt into blocks by the bytes of their ids too."""
    seen = []
    real = D.Items.__init__
    monkeypatch.setattr(D.Items, "__init__", lambda self, ids, texts, window: (seen.append(len(ids)), real(self, ids, texts, window))[1])
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, text string")
    empty = spark.range(100_000).selectExpr("cast(id as string) as item_id", "case id % 3 when 0 then null when 1 then '' else ' .,' end as text")
    some = spark.createDataFrame([("a", "alpha"), ("b", "é")], "item_id string, text string")
    assert [tuple(r)[:4] for r in D.contamination(docs, empty.unionByName(some)).orderBy("doc_id").collect()] == [(1, 2, 1, 1), (2, 1, 0, 0)] and seen == [2]
    assert D.contamination(docs, empty).where("n_hit > 0").count() == 0
    monkeypatch.setattr(D, "ITEM_BYTES", 4000)
    seen.clear()
    named = spark.range(40).selectExpr("repeat('x', 400) || id as item_id", "'w' || id as text")
    assert D.contamination(docs, named).where("n_hit > 0").count() == 0 and sum(seen) == 40 and max(seen) < 25


def test_shards_cut_no_window(monkeypatch):
    monkeypatch.setattr(D, "SHARD", 40)
    docs, items = _made(5)
    it = D.Items([None if a is None else str(a) for a, _ in items], [t for _, t in items], 13)
    h, at = T.words(*T.utf8(pa.array([t for _, t in docs], pa.string())), T.ALNUM)
    hit, found = D._marks(it, h, at)
    got = sorted(((d, int(n), int(k), len(f)) for (d, _), n, k, f in zip(docs, np.diff(at), D._per_row(hit, at), found, strict=True)), key=repr)
    assert got == sorted((w[:4] for w in brute(docs, items)), key=repr)


def test_tables_against_a_plain_search(spark, small_tables):
    docs, items = (spark.read.parquet(f"{small_tables}/{x}.parquet") for x in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert _rows(D.contamination(docs, items)) == want and any(w[5] for w in want)


@pytest.mark.parametrize("bits", [16, 3])
def test_words_of_one_code_hide_no_match(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "_codes", lambda h: np.maximum(h >> np.uint64(64 - bits), np.uint64(1)))
    docs, items = _made(6)
    it = D.Items([None if a is None else str(a) for a, _ in items], [t for _, t in items], 13)
    h, at = T.words(*T.utf8(pa.array([t for _, t in docs], pa.string())), T.ALNUM)
    hit, found = D._marks(it, h, at)
    got = sorted(((d, int(n), int(k), len(f)) for (d, _), n, k, f in zip(docs, np.diff(at), D._per_row(hit, at), found, strict=True)), key=repr)
    assert got == sorted((w[:4] for w in brute(docs, items)), key=repr)
    for _, s, _ in D._shards(h[:3000], at[at <= 3000], it.depth, 0):
        best, where = it.longest(s)
        plain = [max(next((k for k in range(int(n)) if s.at[p + k] != it.at[q + k]), int(n)) for p in range(s.total)) for q, n in zip(it.place, it.length, strict=True)]
        assert best.tolist() == plain and (it.common(s, where, it.place, it.length) >= best).all()


def test_no_items_or_no_documents(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert _rows(D.contamination(d, b)) == brute([(1, "a b c")], [])
    assert D.contamination(d.limit(0), b).count() == 0 and D.decontaminated(d, b).count() == 1


def test_longest_matches_are_those_of_a_plain_search(spark):
    rnd = random.Random(9)
    words = [str(rnd.randrange(50)) for _ in range(400)]
    item = [*words[100:130], "zz", *words[200:216]]
    d, b = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(r["item_start"], r["length"], r["doc_start"]) for r in D.longest_matches(d, b, 10).collect()}
    assert got == {(i, 30 - i, 100 + i) for i in range(21)} | {(31 + i, 16 - i, 200 + i) for i in range(7)}


def test_repeated_items_are_one_and_blocks_are_made_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(D, "ITEM_BYTES", 60)
    docs, items = _made()
    made = []

    def counted(self, ids, texts, window, real=D.Items.__init__):
        made.append(len(ids))
        real(self, ids, texts, window)

    b = spark.createDataFrame(items, "item_id long, text string")
    repeated = b.union(spark.range(10_000).selectExpr("3L", "'same words over and over again'"))
    monkeypatch.setattr(D.Items, "__init__", counted)
    n, blocks = D._blocks(repeated, 13)
    assert n > 1 and not made
    next(blocks)
    assert len(made) == 1
    list(blocks)
    assert sum(made) == repeated.distinct().count()


def test_longest_matches_of_the_tables_equal_their_sql(spark, tables):
    from compare import duck_rows, spark_rows

    from quern.llm import registry

    got = spark_rows(registry.queries()["benchmark_longest_matches"](spark, tables))
    assert got == duck_rows(registry.oracle_sql()["benchmark_longest_matches"], tables) and len(got) > 100


def test_longest_matches_of_odd_items(spark):
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(w[:30])), (None, " ".join(w[5:40])), (1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([("a", " ".join(w)), ("a", " ".join(w[20:38])), (None, " ".join(w)), ("b", None), ("c", "w1 w2")], "item_id string, text string")
    got = {(r["item_id"], r["item_start"]): r["length"] for r in D.longest_by_suffix(docs, items).collect()}
    assert got == {("a", s): 30 - s if s < 5 else 40 - s for s in range(28)}
    assert D.longest_by_suffix(docs.limit(0), items).count() == 0 and D.longest_by_suffix(docs, items.limit(0)).count() == 0
