"""Merging and overlapping windows of event time, for streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, ts: str, who: str, state: str, gap: str, late: str) -> DataFrame:
    """(who, begin, end, n, edges): runs of an actor's rows with `gap` or less between them; end is that of the last row plus `gap`.

    edges counts which state was followed by which, as a map "a>b" to count: the graph
    that the actor went through in the session. On a stream in append mode a session
    comes out once, when the watermark, `late` behind, has passed its end; until then a
    late row may lengthen it, or join two into one. Rows with a null are left out.
    """
    rows = events.select(F.col(ts).alias("at"), F.col(who).alias("who"), F.col(state).alias("state")).where("at is not null and who is not null and state is not null")
    merged = rows.withWatermark("at", late).groupBy("who", F.session_window("at", gap)).agg(F.count("*").alias("n"), F.collect_list(F.struct("at", "state")).alias("rows"))
    ordered = merged.select("who", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n", F.transform(F.array_sort("rows"), lambda r: r["state"]).alias("states"))
    steps = F.zip_with(F.slice("states", F.lit(1), F.size("states") - 1), F.slice("states", F.lit(2), F.size("states") - 1), lambda a, b: F.concat(a, F.lit(">"), b))
    counts = lambda e: F.map_from_arrays(F.array_distinct(e), F.transform(F.array_distinct(e), lambda x: F.size(F.filter(e, lambda y: y == x))))
    return ordered.select("who", "begin", "end", "n", counts(steps).alias("edges"))


def sliding_edges(events: DataFrame, ts: str, src: str, dst: str, width: str, slide: str, late: str) -> DataFrame:
    """(begin, src, dst, weight): how often src met dst in each of the overlapping windows of `width` that begin every `slide`.

    Rows are counted by panes of one `slide` first, and only a pane's counts are copied
    to the windows that it lies in, so a row isn't multiplied by width / slide. `width`
    has to be a multiple of `slide`. On a stream, in append mode, windows close when the
    watermark, `late` behind, has passed them. Rows with a null are left out.
    """
    rows = events.select(F.col(ts).alias("at"), F.col(src).alias("src"), F.col(dst).alias("dst")).where("at is not null and src is not null and dst is not null")
    panes = rows.withWatermark("at", late).groupBy(F.window("at", slide).alias("pane"), "src", "dst").agg(F.count("*").alias("n"))
    return panes.groupBy(F.window("pane", width, slide), "src", "dst").agg(F.sum("n").alias("weight")).select(F.col("window.start").alias("begin"), "src", "dst", "weight")
