"""Paths of states that an actor goes through, from a stream with state and timers, or from a table."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PATH = "who {who}, begin timestamp, end timestamp, steps array<string>, ended string"
_STEP = "at timestamp, id long, state string"
_EPOCH = datetime.datetime(1970, 1, 1)


def _millis(at: datetime.datetime) -> int:
    """The first whole millisecond of timers that is not before a time."""
    naive = at.astimezone(datetime.timezone.utc).replace(tzinfo=None) if at.tzinfo else datetime.datetime.fromtimestamp(at.timestamp(), datetime.timezone.utc).replace(tzinfo=None)
    return -(-((naive - _EPOCH) // datetime.timedelta(microseconds=1)) // 1000)


class _Paths(StatefulProcessor):
    """Of each actor: steps that may still be overtaken by earlier ones (waiting), and the path that is open.

    A step waits until the watermark has passed it; then steps are taken in order of
    time. One timer an actor says when the next thing is due: the first waiting step,
    or the end of the open path by its gap. An actor without steps holds no state.
    """

    def __init__(self, ends: frozenset[str], gap: datetime.timedelta):
        self.ends, self.gap = ends, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STEP)
        self.open = handle.getListState("open", _STEP)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.waiting.appendList([(r["at"], r["id"], r["state"]) for r in rows])
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, watermark: int) -> Iterator[Row]:
        waiting = sorted((tuple(s) for s in self.waiting.get()), key=lambda s: (s[0], s[1]))
        path = [tuple(s) for s in self.open.get()]
        done = []
        due = sum(_millis(s[0]) <= watermark for s in waiting)
        for step in waiting[:due]:
            if path and step[0] - path[-1][0] > self.gap:
                done.append(self._row(key, path, "gap"))
                path = []
            path.append(step)
            if step[2] in self.ends:
                done.append(self._row(key, path, "state"))
                path = []
        waiting = waiting[due:]
        if path and _millis(path[-1][0] + self.gap) < watermark and (not waiting or waiting[0][0] - path[-1][0] > self.gap):
            done.append(self._row(key, path, "gap"))
            path = []
        for state, steps in ((self.waiting, waiting), (self.open, path)):
            if steps:
                state.put(steps)
            else:
                state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [_millis(s[0]) for s in waiting[:1]] + [_millis(s[0] + self.gap) + 1 for s in path[-1:]]
        if due:
            self.handle.registerTimer(min(due))
        yield from done

    def _row(self, key, path: list[tuple], ended: str) -> Row:
        return Row(who=key[0], begin=path[0][0], end=path[-1][0], steps=[s[2] for s in path], ended=ended)


def _steps(events: DataFrame, who: str, at: str, number: str, state: str) -> DataFrame:
    columns = {"who": who, "at": at, "id": number, "state": state}
    rows = events.select(*(F.col(c).alias(k) for k, c in columns.items()))
    return rows.withColumn("id", F.col("id").cast("long")).where("who is not null and at is not null and id is not null and state is not null")


def streamed_paths(events: DataFrame, who: str, at: str, number: str, state: str, ends: list[str], gap: datetime.timedelta, late: str) -> DataFrame:
    """(who, begin, end, steps, ended) of each path in a stream, once it has ended, in append mode.

    A path is a run of an actor's rows in order of time, then `number`. It ends with a
    row whose state is in `ends` ("state"), or where more than `gap` passes without
    another row ("gap"), which a timer finds when the watermark, `late` behind, has
    passed that. Rows up to `late` behind are put in their place. Rows with a null are
    left out. State is kept in RocksDB, which spark.sql.streaming.stateStore.providerClass
    has to name, so actors' steps needn't fit in memory together; an actor's state is
    dropped when its path ends. After a restart from its checkpoint the stream goes on
    where it was.
    """
    rows = _steps(events, who, at, number, state).withWatermark("at", late)
    kind = rows.schema["who"].dataType.simpleString()
    return rows.groupBy("who").transformWithState(_Paths(frozenset(ends), gap), _PATH.format(who=kind), "Append", "EventTime")


def paths(events: DataFrame, who: str, at: str, number: str, state: str, ends: list[str], gap: datetime.timedelta) -> DataFrame:
    """The same rows from a table, in one shuffle by actor; an actor's last path ends by its gap if by nothing else. `at` may be of either timestamp type."""
    by_actor = Window.partitionBy("who").orderBy("at", "id")
    rows = _steps(events, who, at, number, state)
    ended = F.lag(F.col("state").isin(ends)).over(by_actor)
    apart = F.col("at") - F.lag("at").over(by_actor) > F.lit(gap)
    numbered = rows.withColumn("new", F.coalesce(ended | apart, F.lit(True)).cast("int")).withColumn("path", F.sum("new").over(by_actor.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = numbered.groupBy("who", "path").agg(F.min("at").alias("begin"), F.max("at").alias("end"), F.array_sort(F.collect_list(F.struct("at", "id", "state"))).alias("all"))
    last = F.element_at("all", -1)["state"]
    return whole.select("who", "begin", "end", F.transform("all", lambda s: s["state"]).alias("steps"), F.when(last.isin(ends), F.lit("state")).otherwise(F.lit("gap")).alias("ended"))
