import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quern.llm import _text as T
from quern.llm import pack as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    import random

    rnd = random.Random(1)
    signs = ["a", "b", "e", "T", "H", " ", " ", "\n", "é", "É", "ß", "'", "'s", "😀", "日", "th", "ing", "The ", "=", "--", "1", "23", "#", ".", ",", "!", "́", "<|endoftext|>", "ª", "_"]
    texts = ["", None, "  ", "It's they're said' 'said ''s", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "Kelvin K ﬁ é é \xa0x J̌ İstanbul ΑΣ Σ", "x1234 12a ½ ²", "日本語 text 😀😀 ok", " a　b\x85c", "naïve ÉCOLE, Straße!!! ÿ_ __init__ a.b,c", "don't", "x" * 200]
    texts += ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    words = P.Words(open(PATH, encoding="utf-8").read())
    for part in (texts[:300], texts):
        ids, at = words.of_texts(*T.utf8(pa.array(part, pa.string())))
        want = [x.ids for x in library.encode_batch([t or "" for t in part], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def _check(rows, texts, library, length):
    """Round trip of all pieces, and sequences without gaps."""
    ids = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in texts]
    want = sorted((d, k, k * length, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for d, x in ids for k, p in enumerate(x[i : i + length] for i in range(0, len(x), length)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by), sum(r["length"] for r in rows) / length


@pytest.mark.parametrize("group", [50_000, 40])
def test_round_trip_of_tables(spark, small_tables, library, monkeypatch, group):
    monkeypatch.setattr(P, "GROUP", group)
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text")
    used, least = _check(P.packed(docs, PATH).collect(), [tuple(r) for r in docs.collect()], library, 2048)
    assert used <= np.ceil(least) + (1 if group > 40 else 12)


def test_nulls_repeats_long_texts_clashing_columns_and_no_rows(spark, library):
    texts = [(1, None), (2, ""), (3, "a b " * 3000), (4, "a b"), (4, "a b"), (5, "word " * 15), (6, "word " * 16)]
    df = spark.createDataFrame([(a, b, 1) for a, b in texts], "doc_id long, text string, length int")
    assert _check(P.packed(df, PATH, 16).collect(), texts, library, 16)[0] > 300
    assert P.packed(spark.createDataFrame([(None, "a")], "doc_id long, text string"), PATH).first()["doc_id"] is None
    assert P.packed(df.limit(0), PATH).count() == 0


def test_a_piece_goes_where_the_sum_of_squares_becomes_least():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, 400)
    sequence, offset = P.sum_of_squares(sizes, 30)
    gaps = {}
    for i in np.argsort(-sizes, kind="stable"):
        s, counts = int(sizes[i]), np.bincount(list(gaps.values()), minlength=31)
        fits = [g for g in set(gaps.values()) if g >= s]
        if fits:
            after = {g: sum(int(c) ** 2 for k, c in enumerate(counts - (np.arange(31) == g) + (np.arange(31) == g - s)) if k) for g in fits}
            assert gaps[sequence[i]] in fits and after[gaps[sequence[i]]] == min(after.values())
        else:
            assert sequence[i] not in gaps
        gap = gaps.get(sequence[i], 30)
        assert offset[i] == 30 - gap
        gaps[sequence[i]] = gap - s
