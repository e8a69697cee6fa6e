import datetime
import json

import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from quern.streaming.paths import paths, streamed_paths
from quern.streaming.sessions import sessions, sliding_edges

GAP = datetime.timedelta(hours=12)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def _file(folder, name, rows):
    (folder / f"{name}.json").write_text("".join(json.dumps({"at": t, "who": w, "id": i, "state": s}) + "\n" for t, w, i, s in rows))


def _source(spark, folder):
    return spark.readStream.schema("at timestamp, who long, id long, state string").option("maxFilesPerTrigger", 1).json(str(folder))


def _drain(frame, out, checkpoint):
    """Run a stream until its folder is read, and stop it; its last report."""
    query = frame.writeStream.outputMode("append").format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).start()
    try:
        query.processAllAvailable()
        return query.lastProgress
    finally:
        query.stop()


def _day(d, h=0, m=0):
    return f"2024-01-{d:02d}T{h:02d}:{m:02d}:00Z"


def test_streamed_paths_end_by_state_and_by_timer_and_go_on_after_a_restart(spark, rocks, tmp_path):
    folder, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    folder.mkdir()
    frame = streamed_paths(_source(spark, folder), "who", "at", "id", "state", ["buy"], GAP, "1 day")
    first = [
        [(_day(1, 10), 1, 1, "view"), (_day(1, 11), 1, 2, "click"), (_day(1, 10), 2, 3, "view")],
        # one row that comes late and in between, one that ends a path, ties in time taken by id
        [(_day(1, 10, 30), 1, 4, "late"), (_day(1, 12), 1, 6, "buy"), (_day(1, 12), 1, 5, "cart"), (_day(2, 8), 3, 7, "view")],
    ]
    second = [
        [(_day(1, 13), 1, 8, "view"), (_day(4), 4, 9, "view"), (None, 1, 10, "view"), (_day(4), None, 11, "view")],
        [(_day(6), 4, 12, "buy")],
        [(_day(20), 9, 13, "view")],
        [(_day(28), 9, 14, "view")],
    ]
    for i, rows in enumerate(first):
        _file(folder, f"a{i}", rows)
        _drain(frame, out, check)
    for i, rows in enumerate(second):
        _file(folder, f"b{i}", rows)
        last = _drain(frame, out, check)
    got = sorted((r["who"], r["steps"], r["ended"]) for r in spark.read.parquet(str(out)).collect())
    assert got == [(1, ["view"], "gap"), (1, ["view", "late", "click", "cart", "buy"], "state"), (2, ["view"], "gap"), (3, ["view"], "gap"), (4, ["buy"], "state"), (4, ["view"], "gap"), (9, ["view"], "gap")]
    # only actor 9's last row and its timer are left
    kept = last["stateOperators"][0]
    assert kept["numRowsTotal"] <= 4, kept
    table = spark.read.schema("at timestamp, who long, id long, state string").json(str(folder))
    whole = sorted((r["who"], r["steps"], r["ended"]) for r in paths(table, "who", "at", "id", "state", ["buy"], GAP).collect())
    assert whole == sorted([*got, (9, ["view"], "gap")])


def test_a_stream_of_events_has_the_paths_of_its_table(spark, rocks, small_tables, tmp_path):
    events = spark.read.parquet(f"{small_tables}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.sql("select -1L as event_id, timestamp'2030-01-01' as ts, 0L as user_id, 'view' as event_type, 0D as value, '' as props")
    folder = tmp_path / "in"
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(folder))
    end.write.mode("append").parquet(str(folder))
    end.withColumn("ts", F.expr("ts + interval 1 day")).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    _drain(streamed_paths(stream, "user_id", "ts", "event_id", "event_type", ["purchase"], GAP, "40 days"), tmp_path / "out", tmp_path / "checkpoint")
    want = spark_rows(paths(events, "user_id", "ts", "event_id", "event_type", ["purchase"], GAP))
    got = spark.read.parquet(str(tmp_path / "out")).where("begin < timestamp'2029-01-01'")
    assert spark_rows(got) == want and len(want) > 100


def test_paths_of_odd_tables(spark):
    none = spark.createDataFrame([], "who long, at timestamp_ntz, id long, state string")
    assert paths(none, "who", "at", "id", "state", ["buy"], GAP).count() == 0
    t = datetime.datetime(2024, 1, 1)
    rows = [(1, t, 1, "a"), (1, t, 1, "a"), (1, t + GAP, 2, "b"), (1, t + 2 * GAP + datetime.timedelta(microseconds=1), 3, "c"), (None, t, 1, "a"), (2, None, 1, "a"), (3, t, 4, None)]
    got = paths(spark.createDataFrame(rows, none.schema), "who", "at", "id", "state", ["buy"], GAP).collect()
    assert sorted((r["steps"], r["ended"]) for r in got) == [(["a", "a", "b"], "gap"), (["c"], "gap")]


def test_a_late_row_joins_two_sessions(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    frame = sessions(_source(spark, folder), "at", "who", "state", "2 hours", "1 day")
    arrivals = [
        [(_day(1, 8), 1, 1, "a"), (_day(1, 11), 1, 2, "b"), (_day(1, 9), 2, 3, "a")],
        # between the two sessions of actor 1; then one for a closed session, which is dropped
        [(_day(1, 9, 30), 1, 4, "c"), (_day(4), 3, 5, "a")],
        [(_day(1, 9), 1, 6, "x"), (_day(10), 3, 7, "a")],
        [(_day(20), 3, 8, "a")],
    ]
    for i, rows in enumerate(arrivals):
        _file(folder, str(i), rows)
        _drain(frame, tmp_path / "out", tmp_path / "checkpoint")
    got = sorted((r["who"], str(r["begin"])[8:16], r["n"], r["edges"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "01 08:00", 3, {"a>c": 1, "c>b": 1}), (2, "01 09:00", 1, {}), (3, "04 00:00", 1, {}), (3, "10 00:00", 1, {})]


def test_sessions_of_odd_tables(spark):
    kind = "at timestamp, who long, state string"
    assert sessions(spark.createDataFrame([], kind), "at", "who", "state", "2 hours", "1 day").count() == 0
    t = lambda h, us=0: datetime.datetime(2024, 1, 1, h, 0, 0, us, datetime.timezone.utc)
    rows = [(t(1), 1, "a"), (t(3), 1, "b"), (t(5, 1), 1, "c"), (t(1), 2, "a"), (t(1), 2, "a"), (t(1), 2, "b"), (None, 1, "x"), (t(1), None, "x"), (t(1), 1, None)]
    got = sorted((r["who"], r["n"], sorted(r["edges"].items())) for r in sessions(spark.createDataFrame(rows, kind), "at", "who", "state", "2 hours", "1 day").collect())
    assert got == [(1, 1, []), (1, 2, [("a>b", 1)]), (2, 3, [("a>a", 1), ("a>b", 1)])]


def test_sliding_windows_of_a_stream_are_those_of_its_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    arrivals = [[(_day(1, h), 1, h, "a") for h in range(5)], [(_day(2), 1, 10, "a"), (_day(1, 3), 1, 11, "b"), (_day(3, 5), 2, 12, "a")], [(_day(1, 23), 1, 13, "a")], [(_day(25), 9, 14, "z")], [(_day(30), 9, 15, "z")]]
    frame = sliding_edges(_source(spark, folder), "at", "who", "state", "3 days", "1 day", "2 days")
    for i, rows in enumerate(arrivals):
        _file(folder, str(i), rows)
        _drain(frame, tmp_path / "out", tmp_path / "checkpoint")
    table = spark.read.schema("at timestamp, who long, id long, state string").json(str(folder))
    whole = sliding_edges(table, "at", "who", "state", "3 days", "1 day", "2 days").where("src <> 9")
    assert spark_rows(spark.read.parquet(str(tmp_path / "out")).where("src <> 9")) == spark_rows(whole) and whole.count() > 5
    hot = {(str(r["begin"])[:10], r["src"], r["dst"]): r["weight"] for r in whole.collect()}
    assert hot["2023-12-31", 1, "a"] == 6 + 1 and hot["2024-01-02", 1, "a"] == 1 and hot["2024-01-01", 1, "b"] == 1
