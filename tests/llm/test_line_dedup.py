import random

import pandas as pd
from compare import duck_rows, spark_rows

from quern.llm import line_dedup as L

PASSAGE = [f"line {i} of a passage that is shared" for i in range(12)]


def _docs():
    rnd = random.Random(2)
    out = []
    for i in range(60):
        own = [f"own line {i} {k}" for k in range(rnd.randint(0, 6))]
        out.append((i, "\n".join([*own, *(PASSAGE if i % 3 else PASSAGE[: rnd.randint(1, 12)]), *own[:2]])))
    return [*out, (100, None), (101, ""), (102, "\n\n\n"), (103, "one"), (104, "a\nb"), (105, "a\nb"), (106, "x\n" * 3000)]


def test_equals_its_sql(spark):
    docs = _docs()
    frame = pd.DataFrame(docs, columns=["doc_id", "text"])
    assert spark_rows(L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"))) == duck_rows(L.SQL, frames={"documents": frame})


def test_equals_its_sql_on_the_tables(spark, tables):
    assert spark_rows(L.line_dedup(spark.read.parquet(f"{tables}/documents.parquet"))) == duck_rows(L.SQL, tables)


def test_shared_passages_go_but_once_and_nothing_else(spark):
    got = {r["doc_id"]: r for r in L.line_dedup(spark.createDataFrame(_docs(), "doc_id long, text string")).collect()}
    texts = dict(_docs())
    seen = set()
    for i in sorted(texts):
        before, after = (texts[i] or "").split("\n"), got[i]["text"].split("\n")
        rest = iter(before)
        assert got[i]["text"] == "" or all(any(x == y for y in rest) for x in after)
        # a line goes only if an earlier document, or an earlier place, has it
        for x in set(before) - set(after):
            assert x in seen or before.count(x) > 1 or x == ""
        seen |= set(before)
    assert sum(r["n_removed"] for r in got.values()) > 300
    assert got[100]["text"] == "" and got[103]["text"] == "one" and got[105]["n_removed"] == 2


def test_boundaries_do_not_shift(spark):
    body = [f"text {i * i}" for i in range(40)]
    docs = [(1, "\n".join(body)), (2, "\n".join(["new first line", *body]))]
    got = {r["doc_id"]: r for r in L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] > 30


def test_runs_of_equal_lines_of_any_length_are_mostly_removed(spark):
    around = lambda k: [f"{k} own {i}" for i in range(3)]
    docs = [(k, "\n".join([*around(k), *["same"] * n, *around(-k)])) for k, n in enumerate((50, 60, 3, 4, 5, 6, 7, 8, 9, 200), 1)]
    docs += [(20 + k, "\n".join(["x"] * k)) for k in range(12)] + [(40, "\n".join(["a", "b"] * 30)), (41, "\n".join(["a"] * 9 + ["b"] * 9 + ["a"] * 9))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = spark_rows(L.line_dedup(df))
    assert rows == duck_rows(L.SQL, frames={"documents": pd.DataFrame(docs, columns=["doc_id", "text"])})
    got = {r["doc_id"]: r for r in L.line_dedup(df).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, 10)] == [44, 58, 196] and all(x in got[k]["text"] for k in range(1, 11) for x in around(k))


def test_nulls_repeated_rows_and_clashing_columns(spark):
    text = "\n".join(PASSAGE)
    rows = [(None, text, "g", 5), (3, text, "g", 5), (3, text, "g", 5), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string, n_chars long")
    got = spark_rows(L.line_dedup(df).select("doc_id", "n_removed"))
    assert got == sorted([(None, 0), (3, 12), (3, 12), (None, 0)], key=repr)
    kept = L.without_repeated_lines(df)
    assert kept.columns == df.columns and kept.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert sorted((r["doc_id"], r["hash"]) for r in kept.collect() if r["hash"]) == [(None, "g")]
    clash = df.selectExpr("*", "1 as i", "2 as h", "3 as c", "4 as again", "5 as first", "6 as no", "7 as body")
    assert L.without_repeated_lines(clash).columns == clash.columns and L.without_repeated_lines(clash).count() == kept.count()
    assert L.line_dedup(df.limit(0)).count() == 0 and L.without_repeated_lines(df.limit(0)).count() == 0


def test_a_passage_within_other_text_is_cut_out_and_n_chars_follows(spark):
    a, b = "\n".join(["a1", *PASSAGE, "a2"]), "\n".join(["b1", "b2", *PASSAGE, "b3"])
    df = spark.createDataFrame([(1, a, len(a)), (2, b, len(b))], "doc_id long, text string, n_chars int")
    rows = {r["doc_id"]: r for r in L.without_repeated_lines(df).collect()}
    assert rows[1]["text"] == a and rows[2]["text"] != b and rows[2]["n_chars"] == len(rows[2]["text"])
    assert {"b1", "b3"} <= set(rows[2]["text"].split("\n"))


def test_texts_of_200_000_lines_and_a_hot_chunk(spark):
    import time

    took = []
    for n in (50_000, 200_000):
        lines = [f"line {i * i % 1_000_003}" for i in range(n)]
        docs = [(1, "\n".join(lines)), (2, "\n".join(["other", *lines[: n // 2], "in between", *lines[n // 2 :]])), *((i, "\n".join([*PASSAGE, f"own {i}", f"more {i}", f"last {i}"])) for i in range(10, 60))]
        began = time.time()
        got = {r["doc_id"]: r for r in L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()}
        took.append(time.time() - began)
        assert got[1]["n_removed"] == 0 and got[1]["text"] == docs[0][1] and n - 20 < got[2]["n_removed"] <= n
        assert got[2]["n_lines"] - got[2]["n_removed"] == len(got[2]["text"].split("\n")) and got[59]["n_removed"] > 3
    assert took[1] < 8 * took[0] + 10


def test_columns_that_have_no_hash(spark):
    text = "\n".join(PASSAGE)
    df = spark.createDataFrame([(1, text, {"a": 1}), (2, text, None)], "doc_id long, text string, facts map<string,int>")
    assert [tuple(r) for r in L.without_repeated_lines(df).collect()] == [(1, text, {"a": 1})]
