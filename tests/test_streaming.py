from compare import spark_rows
from pyspark.sql import functions as F

from quern.streaming.edges import windowed_edges


def test_a_stream_counts_as_its_table_does(spark, small_tables, tmp_path):
    events = spark.read.parquet(f"{small_tables}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = windowed_edges(stream, "ts", "user_id", "event_type", "1 day", "40 days")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("edges").start()
    try:
        query.processAllAvailable()
        got = spark_rows(spark.table("edges"))
    finally:
        query.stop()
    assert got == spark_rows(windowed_edges(events, "ts", "user_id", "event_type", "1 day", "40 days")) and got


def test_nulls_are_left_out(spark):
    rows = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 1 as a, 'x' as b union all select null, 1, 'x' union all select timestamp'2024-01-01 11:00:00', null, 'x'")
    assert [r["weight"] for r in windowed_edges(rows, "ts", "a", "b", "1 day", "1 day").collect()] == [1]


def test_a_stream_closes_windows_and_drops_what_comes_later(spark, tmp_path):
    """In append mode a window comes out once, when the watermark has passed it; rows for closed windows are not counted, late ones for open windows are."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("ts timestamp, a long, b string").option("maxFilesPerTrigger", 1).json(str(folder))
    # files in the order in which they come: two days on, one row late for an open day and one for a closed day, one that closes all
    arrivals = [["2024-01-01T10:00:00", "2024-01-02T10:00:00"], ["2024-01-03T12:00:00"], ["2024-01-02T23:00:00", "2024-01-01T11:00:00"], ["2024-01-20T00:00:00"]]
    query = windowed_edges(stream, "ts", "a", "b", "1 day", "1 day").writeStream.outputMode("append").format("memory").queryName("late_edges").start()
    try:
        for i, times in enumerate(arrivals):
            (folder / f"{i}.json").write_text("".join(f'{{"ts": "{t}Z", "a": 1, "b": "x"}}\n' for t in times))
            query.processAllAvailable()
        got = {str(r["begin"])[:10]: r["weight"] for r in spark.table("late_edges").collect()}
    finally:
        query.stop()
    assert got == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 1}
