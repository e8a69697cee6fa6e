import random

import numpy as np
import pytest

from quern.llm import _text as T
from quern.llm import ngram_join as N


def _words(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split(" ")


def brute(docs, percent=80):
    sets = []
    for _, t in docs:
        for c in "\t\n\v\f\r":
            t = (t or "").replace(c, " ")
        w = [x for x in _words(t) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))], key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _families(seed, n=160):
    """Near copies on both sides of the threshold, chains of them, and texts made of common lines."""
    rnd = random.Random(seed)
    text = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    common, roots, docs = [text(12) for _ in range(5)], [text(rnd.choice([5, 9, 40, 120, 300])) for _ in range(8)], []
    for i in range(n):
        if i % 4 == 0:
            w = [x for line in rnd.sample(common, rnd.randint(1, 5)) for x in line]
        else:
            w = list(rnd.choice(roots))
            if i % 5 == 0:
                roots.append(w)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
        if i % 6 == 0:
            w = w + text(rnd.randint(1, 8))
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize(("seed", "frequent", "often", "step", "few"), [(1, 1 << 20, 64, 8, 3), (2, 60, 2, 2, 0), (3, 1 << 20, 2, 8, 1)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, frequent, often, step, few):
    monkeypatch.setattr(N, "FREQUENT", frequent)
    monkeypatch.setattr(N, "OFTEN", often)
    monkeypatch.setattr(N, "STEP", step)
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "TOGETHER", 300)
    docs = _families(seed)
    assert _rows(N.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


@pytest.mark.parametrize("percent", [67, 80, 95])
def test_index_keys_meet_for_every_similar_pair_within_their_bounds(percent):
    rng, met = np.random.default_rng(4), 0
    for trial in range(2500):
        n = int(rng.integers(1, 400 if trial % 5 == 0 else 60))
        pool = rng.integers(1, 1 << 63, 3 * n + 30, dtype=np.uint64) * np.uint64(2)
        frequent = pool[: int(rng.integers(0, len(pool)))]
        order = N.Order(frequent, rng.integers(3, 9, len(frequent)) ** rng.integers(1, 6, len(frequent)))
        x = rng.choice(pool, n, replace=False)
        y = np.unique(np.concatenate([x[rng.random(n) > 0.1 * (trial % 3)], rng.choice(pool, int(rng.integers(0, 1 + n // 4)))]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and both < max(n, len(y)):
            (a, p, _), (b, q, _) = N.index_keys(order, np.sort(x), percent), N.index_keys(order, y, percent)
            shared = np.intersect1d(a, b)
            assert any(p[a == k].max() >= both and q[b == k].max() >= both for k in shared), (n, len(y), both)
            met += 1
    assert met > 100


def test_one_large_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    sent = []

    def counted(pairs, sets, percent, real=N._verified):
        sent[-1] += pairs.count()
        return real(pairs, sets, percent)

    monkeypatch.setattr(N, "_verified", counted)
    for n in (1000, 2000):
        rnd = random.Random(5)
        root, docs = [f"w{i}" for i in range(80)], []
        for i in range(n):
            w = list(root)
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(80)] = f"x{rnd.randrange(10**9)}"
            docs.append((i, " ".join(w)))
        sent.append(0)
        assert len({r["component_id"] for r in N.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}) < 0.6 * n
    assert sent[1] <= 2.3 * sent[0] and sent[1] < 2 * n


def test_texts_of_100_000_words(spark):
    rnd = random.Random(8)
    line = [f"w{rnd.randrange(50_000)}" for _ in range(100_000)]
    other = [w if rnd.random() > 0.02 else "edit" for w in line]
    far = [w if rnd.random() > 0.06 else "edit" for w in line]
    docs = [(i, " ".join(x)) for i, x in enumerate([line, other, far, line[:90_000], line[:70_000]])]
    assert _rows(N.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == brute(docs)


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 1 << 63, 1400, dtype=np.uint64), rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = np.unique(np.concatenate([x, y])), np.unique(x)
    p, q = (np.array(N.parity(s)) for s in (a, b))
    differ = sum(bin(int(v) & (1 << 64) - 1).count("1") for v in p.reshape(-1, len(q))[0] ^ q ^ (p.reshape(-1, len(q))[1] if len(p) > len(q) else 0))
    assert 0 < differ <= len(np.setxor1d(a, b))


def test_nulls_short_texts_repeats_clashing_columns_and_no_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n\t "), (9, "a b c"), (4, "A  b\nc"), (5, "a b c d e"), (6, "a b c d e"), (6, "a b c d e"), (None, "a b c d e"), (None, "lone text of its own here"), (8, "a b c d e f")]
    df = spark.createDataFrame([(a, b, 7, 7) for a, b in docs], "doc_id long, text string, n int, component_id int")
    assert _rows(N.jaccard_components(df)) == brute(docs)
    assert N.jaccard_components(df.limit(0)).count() == 0
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 5, None, None, 8], key=repr)
    assert N.one_of_each(df.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    words = lambda k, n=60: [f"{k}{i}" for i in range(n)]
    a, b, c = words("a"), words("b"), words("c")
    docs = [(3, " ".join(a)), (5, " ".join([*a[:-1], "x"])), (5, " ".join(b)), (7, " ".join(c)), (7, " ".join([*c[:-1], "y"])), (7, " ".join(c).upper()), (7, " ".join([*b, "z"])), (7, ""), (7, None), (7, None), (9, "own words of nine alone"), (9, " ".join([*c, "w"]))]
    df = spark.createDataFrame([(d, t, [d], "k") for d, t in docs], "doc_id int, text string, list array<int>, cid string").repartition(3)
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert set(got) < set(docs) and len(got) == len(set(got))
    of = lambda k: sorted((d for d, t in got if t and t.lower().startswith(k)))
    assert (of("a"), of("b"), of("c"), of("own")) == ([3], [5], [7], [9])
    assert {x for x in got if not x[1]} == {(7, ""), (7, None)} and len(got) == 6


@pytest.mark.parametrize("bits", [1 << 26, 1 << 11])
def test_rows_that_filters_leave_in_doubt_are_told_apart(spark, monkeypatch, bits):
    monkeypatch.setattr(N, "FILTER_BITS", bits)
    docs = [(i, f"text {i}") for i in range(3000)] + [(None, "no id"), (7, "again")]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id int, text string, out string").repartition(5)
    ids = spark.range(3000).selectExpr("id as __quern_doc", "id % 3 = 0 as out")
    kept = N._without(df, ids)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted((x for x in docs if x[0] is None or x[0] % 3), key=repr)
    assert N._without(df, ids.withColumn("out", ids["out"] & False)).count() == len(docs) and N._without(df.limit(0), ids.limit(0)).count() == 0
    plan = N._without(df, ids)._jdf.queryExecution().executedPlan().toString()
    assert ("Join" in plan) == (bits < 1 << 26)


def test_tables_against_all_pairs(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text")
    assert _rows(N.jaccard_components(docs)) == brute([tuple(r) for r in docs.collect()])


def test_words_are_hashed_alike_in_any_block():
    import pyarrow as pa

    texts = ["Hello, wörld hello", None, "a b  c", "É x", "", "ab" * 100 + " q", "w " * 50]
    data, offsets = T.utf8(pa.array(texts))
    whole = T.words(data, offsets, T.ALNUM)
    for size in (1, 7, 30):
        before = T.blocks.__defaults__
        T.blocks.__defaults__ = (size,)
        try:
            part = T.words(data, offsets, T.ALNUM)
        finally:
            T.blocks.__defaults__ = before
        assert all(np.array_equal(a, b) for a, b in zip(whole, part, strict=True))


def test_no_combination_of_template_tokens_alone_is_indexed():
    """Texts of one template, ten fields of ten values: no key is one of all texts, and those who share one are fewer than half of all pairs; keys of one set of members are counted once."""
    import pyarrow as pa

    rnd = random.Random(7)
    texts = []
    for _ in range(1500):
        w = [f"t{i}" for i in range(120)]
        for f in range(10):
            w[f * 12 + 5] = f"f{f}v{rnd.randrange(10)}"
        texts.append(" ".join(w))
    tokens, at = N.shingle_sets(*T.utf8(pa.array(texts)))
    distinct, hits = np.unique(tokens, return_counts=True)
    order, members = N.Order(distinct[hits > 64], hits[hits > 64]), {}
    for i in range(len(texts)):
        for k in np.unique(N.index_keys(order, tokens[at[i] : at[i + 1]], 80)[0]).tolist():
            members.setdefault(k, []).append(i)
    sizes = [len(m) for m in set(map(tuple, members.values()))]
    assert max(sizes) < 1500 / 8 and sum(n * (n - 1) // 2 for n in sizes) < 1500 * 1499 / 4
