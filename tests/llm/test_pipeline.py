import zlib

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest
from compare import duck_rows, spark_rows
from test_decontaminate import brute as contaminated
from test_ngram_join import brute as components
from tokenizers import Tokenizer

from quern.llm import line_dedup, registry


@pytest.fixture(scope="module")
def steps(spark, small_tables, tmp_path_factory):
    """What each stage had and gave, as lists of rows."""
    docs, out = spark.read.parquet(f"{small_tables}/documents.parquet"), []
    odd = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "12 34", "en", "s", 5), (900_003, "", None, None, None)], docs.schema)
    docs = docs.unionByName(odd)
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in C.STAGES:
        path = str(folder / name)
        stage(spark, docs, small_tables).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def _texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_are_the_given_ones_and_keep_the_columns(steps):
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for before, after in steps[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_language_stage_rejects_texts_without_language_alone(steps):
    before, after = (dict(_texts(x)) for x in steps[0])
    assert set(before) - set(after) == {i for i, t in before.items() if not any(c.isalpha() for c in t or "")} == {900_001, 900_002, 900_003}


def test_line_stage_is_the_sql(steps):
    before, after = steps[1]
    rows = duck_rows(line_dedup.SQL, frames={"documents": before.select("doc_id", "text").toPandas()})
    want = sorted((i, text) for i, n, gone, text in rows if n > gone)
    assert sorted(_texts(after)) == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_duplicate_stage_keeps_one_of_each(steps):
    before, after = steps[2]
    keep = {d for d, _, c in components(_texts(before)) if d == c}
    assert sorted(_texts(after)) == sorted(x for x in _texts(before) if x[0] in keep) and len(keep) < before.count()


def test_benchmark_stage_drops_contaminated_documents_alone(steps, spark, small_tables):
    before, after = steps[3]
    items = [tuple(r) for r in spark.read.parquet(f"{small_tables}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in contaminated(_texts(before), items) if r[5]}
    assert bad and sorted(_texts(after)) == sorted(x for x in _texts(before) if x[0] not in bad)


def test_packing_stage_holds_all_that_is_left(steps):
    before, after = steps[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in _texts(before):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, k, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in after.collect()) == sorted(want)


def test_run_applies_all_stages(spark, small_tables):
    got = C.run(spark, small_tables)
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, small_tables)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert spark_rows(got.select(columns)) == spark_rows(docs.select(columns)) and got.count()


def _tables(spark, small_tables, folder, docs):
    """A folder with the tables that the pipeline reads, of its own."""
    spark.read.parquet(f"{small_tables}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_no_documents(spark, small_tables, tmp_path):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    assert C.run(spark, _tables(spark, small_tables, tmp_path, docs.limit(0))).count() == 0


def test_documents_without_lang_are_kept(spark, small_tables, tmp_path):
    docs = spark.createDataFrame([(i, f"words of text {i} that stand alone here", None, None, None) for i in range(5)] + [(9, "12 34", None, None, None), (10, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in C.run(spark, _tables(spark, small_tables, tmp_path, docs)).collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, tables, name):
    assert spark_rows(registry.queries()[name](spark, tables)) == duck_rows(registry.oracle_sql()[name], tables)
