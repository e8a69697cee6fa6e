import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import language as L
from quern.llm import quality as Q


@pytest.fixture(scope="module")
def docs(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def test_held_out_accuracy_of_languages(docs):
    rows = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and len(held) > 150 and np.mean(held) > 0.97


def test_held_out_languages_are_not_learned_from(docs):
    changed = docs.withColumn("lang", F.when(L.held_out(2, 4), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.languages(x.where("doc_id < 200")).collect()} for x in (docs, changed))
    assert a == b


def test_a_language_net_learns_and_folds_to_the_same_responses():
    rng = np.random.default_rng(0)
    x = rng.integers(97, 123, (60, L.WINDOW + 3), dtype=np.uint8)
    x[30:, ::3] = 0xC3
    net = L.Net(["a", "b"])
    net.fit(x, np.repeat([0, 1], 30), epochs=5)
    s = L.Scorer(net)
    got = s._windows(x)
    r = [sum(t[j][x[:, j : L.WINDOW + j]] for j in range(w)).max(axis=1) for w, t in zip(L.WIDTHS, net.tables, strict=True)]
    z = np.maximum(np.concatenate(r, axis=1) + net.bias, 0) @ net.out + net.out_bias
    assert np.allclose(got, z - np.log(np.exp(z).sum(axis=1, keepdims=True)), atol=1e-3)
    assert (got.argmax(axis=1) == np.repeat([0, 1], 30)).all()


def test_languages_of_odd_rows(spark):
    known = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("le chat et les chiens", "fr")] * 30)]
    odd = [(None, "the dog", "en"), (900, None, "en"), (901, "", None), (902, "12 !?", "fr"), (903, "日本", None), (904, "the cat " * 20_000, None), (905, "the dog", None), (905, "the dog", None)]
    df = spark.createDataFrame([(*r, 1) for r in [*known, *odd]], "doc_id long, text string, lang string, score int")
    rows = L.languages(df).collect()
    assert len(rows) == 68
    by = {r["doc_id"]: r for r in rows}
    assert [(by[i]["lang_pred"], by[i]["score"]) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert by[903]["lang_pred"] in ("en", "fr") and by[904]["lang_pred"] == by[905]["lang_pred"] == "en" and by[None]["held_out"]
    kept = L.in_language(df)
    assert kept.columns == df.columns and kept.count() == 65 and L.in_language(df, ["fr"]).count() < 40
    assert L.languages(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_language_of_mostly_empty_texts_is_learned(spark):
    rows = [(i, None if i % 2 else "", "fr") for i in range(600)] + [(1000 + i, "le chat et les chiens", "fr") for i in range(4)] + [(2000 + i, "the cat and the dog", "en") for i in range(20)]
    assert L.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=5).langs == ["en", "fr"]


def test_held_out_accuracy_of_quality(docs, spark, tables):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows = Q.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], r["quality"]) for r in rows if r["held_out"]]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.95


def test_held_out_quality_is_not_learned_from(docs, spark, tables):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    few = docs.where("doc_id < 400")
    changed = labels.withColumn("quality", F.when(L.held_out(1, 3), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in Q.quality_scores(few.withColumn("lang", F.lit(x)), y).collect()} for x, y in (("a", labels), ("b", changed)))
    assert a == b and len(a) == 400


def test_trees_walk_as_one_row_would():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    t = Q.Trees()
    t.fit(x, y)
    score = t.score(x)
    assert np.mean((score > 0.5) == y) > 0.95
    for r in range(0, 500, 83):
        total = t.base
        for f, c, v in zip(t.feature, t.threshold, t.value, strict=True):
            node = 0
            for _ in range(Q.DEPTH):
                node = 2 * node + (2 if x[r, f[node]] > c[node] else 1)
            total += v[node - (2**Q.DEPTH - 1)]
        assert np.isclose(score[r], 1 / (1 + np.exp(-total)))


def test_statistics_do_not_depend_on_blocks(monkeypatch):
    import pyarrow as pa

    from quern.llm import _text as T

    data, offsets = T.utf8(pa.array(["", "The cat.\nThe cat.\n", None, "a a a " * 50, "É|{}" * 9]))
    whole = Q.statistics(data, offsets)
    monkeypatch.setattr(T, "BLOCK", 16)
    assert np.array_equal(whole, Q.statistics(data, offsets)) and np.isfinite(whole).all()


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a", 1), (1, None, 1), (1, None, 1), (2, "", None), (3, "x " * 50_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_what_reaches_the_driver_is_bounded_where_a_document_is_repeated(spark, monkeypatch):
    seen = []

    class Seen(L.Net):
        def fit(self, windows, targets):
            seen.append(len(windows))

    monkeypatch.setattr(L, "Net", Seen)
    df = spark.range(10_000).selectExpr("1L as doc_id", "concat('the words of text ', id) as text", "'en' as lang").union(spark.range(50).selectExpr("id + 10", "concat('les mots ', id)", "'fr'"))
    L.trained(df)
    assert seen and seen[0] <= 2 * L.FIT_WINDOWS * 51


def test_no_language_can_be_learned(spark):
    df = spark.createDataFrame([(1, "some text", None, 1), (2, "1 2", None, 2), (3, None, None, 3), (4, "", None, 4)], "doc_id long, text string, lang string, score int")
    assert [tuple(r) for r in L.in_language(df).collect()] == [(1, "some text", None, 1)]
    assert {(r["lang_pred"], r["score"]) for r in L.languages(df).collect()} == {("und", 0.0)}
    with pytest.raises(ValueError):
        L.in_language(df, ["en"])
    assert L.in_language(df.limit(0), ["en"]).count() == 0


def _plain_statistics(text):
    """Q.STATISTICS of one text, counted byte by byte and word by word."""
    raw = (text or "").encode()
    kinds = [Q._KINDS[Q._KIND[b]] for b in raw]
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words, lines = [x for x in re.split(rb"[\x20\x09-\x0D]+", low) if x], [x for x in re.split(rb"[\n\r]+", low) if x]
    size, n, m = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip([None, *words], words, strict=False)))
    share = [kinds.count(k) / size for k in Q._KINDS]
    most = max((words.count(w) for w in set(words)), default=0)
    return [math.log1p(len(raw)), *share, math.log1p(len(words)), (len(raw) - kinds.count("space")) / n, len(set(words)) / n, most / n, again / n, pairs / n, math.log1p(len(lines)), len(words) / m, len(set(lines)) / m, len(words) / max(1, kinds.count("stop")), kinds.count("upper") / n, math.log1p(len(set(words)))]


def test_the_quality_query_equals_a_plain_version(spark, small_tables, monkeypatch):
    """The same trees, walked node by node over plainly counted statistics, for every row of the table."""
    grown = []
    real = Q.Trees.fit
    monkeypatch.setattr(Q.Trees, "fit", lambda self, x, y: (real(self, x, y), grown.append(self))[0])
    docs, labels = (spark.read.parquet(f"{small_tables}/{x}.parquet") for x in ("documents", "labels"))
    got = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).collect()}
    (t,) = grown
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and len(t.feature) == Q.TREES
    for r in rows:
        x, total = np.array(_plain_statistics(r["text"]), np.float32), t.base
        for f, c, v in zip(t.feature, t.threshold, t.value, strict=True):
            node = 0
            for _ in range(Q.DEPTH):
                node = 2 * node + (2 if x[f[node]] > c[node] else 1)
            total += v[node - (2**Q.DEPTH - 1)]
        want = 1 / (1 + math.exp(-total))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9 and got[r["doc_id"]]["predicted"] == int(want >= 0.5), r["doc_id"]


def test_the_language_query_equals_a_plain_version(spark, small_tables, monkeypatch):
    """The same network, its filters laid on each window in turn, for every row of the table."""
    nets = []
    real = L.trained
    monkeypatch.setattr(L, "trained", lambda *a, **b: nets.append(real(*a, **b)) or nets[-1])
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    got = {r["doc_id"]: r for r in L.languages(docs).collect()}
    (net,) = nets
    for r in docs.select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        total = np.zeros(len(net.langs))
        for a in range(0, len(raw), L.WINDOW):
            part = np.frombuffer(raw[a : a + L.WINDOW], np.uint8)
            x = np.zeros(L.WINDOW + 3, np.uint8)
            x[: len(part)] = part
            pooled = [sum(table[j][x[j : L.WINDOW + j]] for j in range(w)).max(axis=0) for w, table in zip(L.WIDTHS, net.tables, strict=True)]
            z = np.maximum(np.concatenate(pooled) + net.bias, 0).astype(float) @ net.out + net.out_bias
            total += len(part) * (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        p = np.exp(total / len(raw) - (total / len(raw)).max())
        p /= p.sum()
        assert got[r["doc_id"]]["lang_pred"] == net.langs[int(p.argmax())] and abs(got[r["doc_id"]]["score"] - p.max()) < 1e-3, r["doc_id"]
