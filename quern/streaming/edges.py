"""Edge counts over event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(events: DataFrame, ts: str, src: str, dst: str, width: str, late: str) -> DataFrame:
    """(begin, src, dst, weight): how often src met dst in each window of event time.

    On a stream, rows up to `late` behind are counted and older windows are closed, so
    the state is bounded by that; on a table all rows are counted. `ts` has to be a
    timestamp with a time zone. Rows with a null end or time are left out.
    """
    rows = events.select(F.col(ts).alias("at"), F.col(src).alias("src"), F.col(dst).alias("dst")).where("at is not null and src is not null and dst is not null")
    counted = rows.withWatermark("at", late).groupBy(F.window("at", width), "src", "dst").agg(F.count("*").alias("weight"))
    return counted.select(F.col("window.start").alias("begin"), "src", "dst", "weight")
