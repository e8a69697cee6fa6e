import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from quern.llm import _text as T
from quern.llm import token_counts as C

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\tb", "Kelvin K ﬁ é é \xa0x ▁a <s> </s> <unk> <0x0A>", "▁", "▁▁▁ x", "x▁", " " * 7, "a" + " " * 33 + "b", "日本語 text 😀😀 ok", "aaaa" * 100, None, "\u0000x", "x" * 300 + " y", "    def f(x):\n        return x\n\n\n", "ab" * 30_000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _random(n, seed):
    rnd = random.Random(seed)
    signs = ["a", "b", "e", "t", "h", " ", "  ", "\n", "é", "ß", "▁", "😀", "日", "th", "ing", "the ", "=", "--", "1", "23", "#"]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(n)] + ["".join(rnd.choice(signs[:5]) for _ in range(rnd.randint(60, 400))) for _ in range(20)]


@pytest.mark.parametrize("held", [1 << 20, 300])
def test_counts_are_the_librarys(library, monkeypatch, held):
    monkeypatch.setattr(C, "BYTES", held)
    texts = [*ODD, *_random(600, held)]
    counter = C.Counter(C.merges_of(PATH))
    for part in (texts[:200], texts):
        assert counter.of_texts(*T.utf8(pa.array(part, pa.string()))).tolist() == [len(library.encode(t or "")) for t in part]


def test_long_texts_without_spaces(library):
    rnd = random.Random(3)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = ["".join(rnd.choice(signs) for _ in range(100_000)), "".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(50_000)), "".join(rnd.choice(["的", "是", "在", "日", "本", "語", "の", "は"]) for _ in range(50_000)), "a" * 99_999, "".join(rnd.choice(["th", "e", "ing", "er", "s"]) for _ in range(60_000))]
    counter = C.Counter(C.merges_of(PATH))
    assert counter.of_texts(*T.utf8(pa.array(texts))).tolist() == [len(library.encode(t)) for t in texts]


def test_kept_words_do_not_change_counts(library, monkeypatch):
    monkeypatch.setattr(C, "KEPT", 50)
    counter = C.Counter(C.merges_of(PATH))
    for seed in range(4):
        texts = _random(100, seed)
        assert counter.of_texts(*T.utf8(pa.array(texts))).tolist() == [len(library.encode(t)) for t in texts]


def test_rows_of_tables(spark, small_tables, library):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    got = {r["doc_id"]: r for r in C.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        n = len(library.encode(r["text"] or ""))
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 4096)


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (1, "a b", 1), (1, "a b", None)], "doc_id long, text string, n_tokens int")
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in C.token_counts(df, PATH).collect()) == [(0, 0), (3, 2), (3, 2), (3, 2)]
    assert C.token_counts(df.limit(0), PATH).count() == 0
