import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from quern.llm import collocations as module
from quern.llm import registry
from quern.llm.collocations import _score, collocations


def plainly(rows, least=10, inside=50, first=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) as the contract says them."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = {}
    for (lang, p), a in candidates.items():
        if any(100 * b >= inside * a for (o, q), b in candidates.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, part in found.items() for i, x in enumerate(sorted(part)[:first], 1)), key=repr)


def _rows(df):
    return sorted((tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect()), key=repr)


def _odd_rows():
    rnd = random.Random(13)
    names = ["the", "The", "of", "ÉTÉ", "été", "new", "york", "x\x00y", "日本", "a", "\x7f", "don't"]
    gaps = [" ", " ", " ", "\t", "  ", ". ", "\n", "\r\n", "?!", ", "]
    rows = []
    for _ in range(150):
        text = "".join(rnd.choice(names) + rnd.choice(gaps) for _ in range(rnd.choice([0, 1, 2, 3, 30, 200])))
        rows.append((rnd.choice(["en", "en", "en", "fr", None, "und", ""]), text))
    rows += [("en", "new york city " * 40)] * 3 + [("de", "new york")] * 9 + [("es", "uno dos")] * 10 + [("en", None), ("en", ""), (None, None), ("en", "one two three " * 5000)]
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "h", 2) for r in rows], "lang string, text string, a int, h string, n int").repartition(4)


def test_query_equals_its_sql(spark, tables):
    got = spark_rows(registry.queries()["op13_phrase_collocations"](spark, tables))
    assert got == duck_rows(registry.oracle_sql()["op13_phrase_collocations"], tables) and len(got) > 1000


def test_equals_a_plain_version_on_odd_rows(spark):
    rows = _odd_rows()
    got = _rows(collocations(_frame(spark, rows)))
    assert got == plainly(rows) and {r[0] for r in got} >= {"en", "und", "es", ""} and "de" not in {r[0] for r in got}


@pytest.mark.parametrize("sizes", [{"PART": 5}, {"CODED": 6}, {"CODED": 0, "TEXT": 300}, {"COMBINED": 7, "TEXT": 1000, "PART": 40}])
def test_parts_codes_and_slices_change_nothing(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(module, name, value)
    rows = _odd_rows()
    assert _rows(collocations(_frame(spark, rows), first=30)) == plainly(rows, first=30)


@pytest.mark.parametrize("rows", [[], [("en", None)], [("en", "a b c")] * 9, [("en", "a b c")] * 10, [(None, "x " * 12)]])
def test_few_rows(spark, rows):
    assert _rows(collocations(spark.createDataFrame(rows, "lang string, text string"))) == plainly(rows)


def test_words_of_one_hash_are_seen_and_hashed_again(spark, monkeypatch):
    """With hashes of 8 bits two words of 40 are alike; the next seed's are whole here."""
    real = module._counted

    def narrow(seed):
        def f(batches):
            import pyarrow as pa

            for b in real(seed)(batches):
                h = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h % 256 if seed == 0 else h), *b.columns[1:]], names=b.schema.names)

        return f

    monkeypatch.setattr(module, "_counted", narrow)
    rows = [("en", " ".join(f"w{i}" for i in range(400)))] * 12
    seed, words = module.counted_words(spark.createDataFrame(rows, "lang string, text string"))
    assert seed == 1 and words.count() == 400


def test_scores_are_exact_beyond_64_bits(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(300):
        a = rnd.randrange(1, 10 ** rnd.randrange(1, 16))
        rows.append((a, a + rnd.randrange(10**14), a + rnd.randrange(10 ** rnd.randrange(1, 15))))
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", _score("a", "l", "r").alias("s")).collect()
    assert all(r["s"] == 1000000 * r["a"] * r["a"] // (r["l"] * r["r"]) for r in got)


def test_a_prefix_in_many_parts_is_no_task_of_its_own(spark, monkeypatch):
    """A third of all pointers have one prefix. Dealt by the next word, and by the one after it where the next is as frequent, no task gets more than a small part of them."""
    monkeypatch.setattr(module, "PART", 1000)
    rnd = random.Random(5)
    text = " ".join(w for _ in range(15000) for w in ("hot", f"w{rnd.randrange(400)}", f"v{rnd.randrange(400)}", "hot", "cold", f"u{rnd.randrange(400)}"))
    docs = spark.createDataFrame([("en", text)], "lang string, text string")
    seed, words = module.counted_words(docs)
    shared = spark.sparkContext.broadcast(module.codes(words, 10))
    pointers = docs.mapInArrow(module._pointers(seed, shared), "a long, part int, b long, c long, n long").where("a = 1")
    for chosen in ("part < 0", "part >= 0"):
        rows = pointers.where(chosen).groupBy("part").agg(F.count("*").alias("n")).toPandas()["n"]
        assert len(rows) == 30 and rows.max() < 3 * np.median(rows), chosen
    # the pair hot, cold is dealt by what follows it; of all others each is in one part
    assert pointers.where("part >= 0").select("b").distinct().count() == 1 and pointers.where("part < 0").groupBy("b").agg(F.count_distinct("part").alias("k")).where("k > 1").isEmpty()
