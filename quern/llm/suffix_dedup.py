"""Repeated passages by sparse suffix arrays.

A suffix is retained where the hash of its first HEAD words is the (leftmost) least of
the HEADs in some stretch of `least` words. Equal stretches choose the same place in
them, so every repeat of `least` words or more holds a retained suffix whose head
repeats; about one suffix in sixteen is retained. Suffixes whose heads stand in two
documents are sorted by the words that follow. Neighbours are compared, and their
matches are extended to the left: of suffixes that agree in r words to the right,
those that agree in least - r words to the left repeat a whole stretch. What the
extensions cover is joined to maximal passages.

Suffixes that are equal in all that can matter are one row for each slice of a task
before anything is shuffled. Heads that stand in very many places are not sorted in
one task: their stretches are counted by hash instead, which gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bloom, _text
from ._spark import slices, stored

_U = np.uint64
#: Words of a head.
HEAD = 20
#: Bits of each filter, of heads that repeat and of those with more than HOT places.
FILTER_BITS = 1 << 26
#: Heads with more places are counted by stretches: that many suffixes take less than 300 MB in the one process that compares them.
HOT = 40_000
#: Suffixes that are compared at once.
ROWS = 16_384
_FACTOR = _U(0x9E3779B97F4A7C15 | 1)


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that start at each word; those that the end cuts off are of no use."""
    out = np.zeros(len(h), _U)
    for j in range(k):
        out *= _FACTOR
        out[: len(h) - j] += h[j:]
    return _text.mix(out)


def _leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` numbers, the place of its leftmost minimum."""
    n = len(g)
    # order by value, then place, in one number
    order = np.lexsort((np.arange(n), g))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    padded = np.full(-(-n // width) * width, n, np.int64)
    padded[:n] = rank
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return order[np.minimum(after[: n - width + 1], before[width - 1 : n])]


def _retained(h: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(row, head, place, first, last) of the retained suffixes of many texts: its place, and the starts of the stretches that chose it, as word numbers."""
    row, head, place, first, last = ([np.zeros(0, np.int64)] for _ in range(5))
    width = least - HEAD + 1
    if len(h):
        heads = _runs(h, HEAD)
        for i in np.flatnonzero(np.diff(at) >= least).tolist():
            a, b = int(at[i]), int(at[i + 1])
            p = _leftmost_least(heads[a : b - HEAD + 1], width) + a
            new = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            row.append(np.full(len(new), i))
            place.append(p[new])
            first.append(new + a)
            last.append(np.append(new[1:], len(p)) - 1 + a)
            head.append(heads[p[new]].view(np.int64))
    return tuple(np.concatenate(x) for x in (row, head, place, first, last))


def _texts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple]:
    for batch in slices(batches, "text"):
        h, at = _text.words(*_text.utf8(batch.column(1)), _text.ALNUM)
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, head, place, first, last = _retained(h, at, least)
        yield h, at, ids[row], row, head, place, first, last


def _census(least: int):
    def f(batches):
        for _, _, doc, _, head, _, _, _ in _texts(batches, least):
            if not len(head):
                continue
            order = np.lexsort((doc, head))
            head, doc = head[order], doc[order]
            new = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
            end = np.append(new[1:], len(head))
            yield pa.RecordBatch.from_arrays([pa.array(head[new]), pa.array(doc[new]), pa.array(doc[end - 1]), pa.array(end - new)], names=["head", "low", "high", "n"])

    return f


#: done: a passage that one of a smaller id, `other`, in its slice has, with all that can matter (`key`); the other columns are of suffixes that have to be compared.
_SUFFIX = "done boolean, key long, head long, doc long, start long, end long, other long, near long, far long, place long, right binary, left binary, marks binary"


def _hot(head: np.ndarray, hot) -> np.ndarray:
    """Which heads have too many places to be sorted in one task, by a filter: it may name others, whose stretches then are counted too, to the same result."""
    return np.zeros(len(head), bool) if hot is None else _bloom.has(hot.value, head)


def _suffixes(least: int, wanted, hot):
    """Suffixes with a repeated head: their words to the right, and to the left from the nearest on, as 32-bit codes, and 64-bit hashes of the stretches that chose them, by which matches are verified."""
    reach = least - HEAD

    def f(batches):
        for h, at, doc, row, head, place, first, last in _texts(batches, least):
            use = np.flatnonzero(_bloom.has(wanted.value, head) & ~_hot(head, hot))
            if not len(use):
                continue
            doc, row, head, place, first, last = (x[use] for x in (doc, row, head, place, first, last))
            # what lies outside the text, or outside all stretches that chose the suffix, is 0
            codes = np.maximum(h >> _U(32), _U(1)).astype(">u4")
            step = place[:, None] + np.arange(least)
            right = np.where(step < (last + least)[:, None], codes[np.minimum(step, len(h) - 1)], 0).astype(">u4")
            step = place[:, None] - 1 - np.arange(reach)
            left = np.where(step >= first[:, None], codes[np.maximum(step, 0)], 0).astype(">u4")
            whole = _runs(h, least)
            sums = np.concatenate((np.zeros(1, _U), np.cumsum(_text.mix(whole + _U(1)))))
            key = _text.mix((_runs_of(right) * _FACTOR + _runs_of(left)) ^ _text.mix(sums[last + 1] - sums[first]))
            order = np.lexsort((place, doc, key))
            key, d = key[order], doc[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            key = key.view(np.int64)
            group = np.cumsum(new) - 1
            start = np.flatnonzero(new)
            low, high = d[start][group], d[np.append(start[1:], len(d)) - 1][group]
            again = d != low
            # a document that repeats what one of a smaller id in the slice has is done
            i = order[again]
            n = len(i)
            none = pa.nulls(n, pa.int64())
            if n:
                b = at[row[i]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.array(key[again]), none, pa.array(doc[i]), pa.array(first[i] - b), pa.array(last[i] - b + least), pa.array(low[again]), none, none, none, *[pa.nulls(n, pa.binary())] * 3], names=[x.split()[0] for x in _SUFFIX.split(", ")])
            i, twin, alone = order[~again], np.where(high != low, high, -1)[~again], (high == low)[~again]
            n = len(i)
            b = at[row[i]]
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, bool)), pa.array(key[~again], mask=alone), pa.array(head[i]), pa.array(doc[i]), none, none, pa.array(twin, mask=alone), pa.array(place[i] - last[i]), pa.array(place[i] - first[i]), pa.array(place[i] - b), pa.array([x.tobytes() for x in right[i]], pa.binary()), pa.array([x.tobytes() for x in left[i]], pa.binary()), pa.array([whole[a : b + 1].tobytes() for a, b in zip(first[i].tolist(), last[i].tolist(), strict=True)], pa.binary())],
                names=[x.split()[0] for x in _SUFFIX.split(", ")],
            )

    return f


def _runs_of(codes: np.ndarray) -> np.ndarray:
    """A hash of each row of codes."""
    out = np.zeros(len(codes), _U)
    for j in range(codes.shape[1]):
        out = out * _FACTOR + codes[:, j].astype(_U)
    return _text.mix(out)


#: key: of suffixes that stand for others of their slice.
_SPAN = "key long, doc long, start long, end long, other long, first boolean"


def _compared(least: int):
    """From suffixes in the order of head and right words: the passages that each shares with another document's."""
    reach = least - HEAD

    def compare(key, head, doc, twin, near, far, place, right, left, marks):
        n = len(head)
        same = np.concatenate(([0], (right[1:] == right[:-1]).cumprod(axis=1).sum(axis=1) * (head[1:] == head[:-1])))
        to_left = np.zeros((n, reach + 1), _U)
        for j in range(reach):
            to_left[:, j + 1] = to_left[:, j] * _FACTOR + left[:, j].astype(_U)
        # the stretch that begins l words before the suffix, by l; marks begin with the farthest
        whole = np.zeros((n, reach + 1), _U)
        count = far - near + 1
        of = np.repeat(np.arange(n), count)
        whole[of, far[of] - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))] = marks
        matched = np.zeros((n, reach + 1), bool)
        low, high = np.zeros((n, reach + 1), np.int64), np.zeros((n, reach + 1), np.int64)
        for l in range(reach + 1):
            rows = np.flatnonzero((near <= l) & (far >= l))
            if not len(rows):
                continue
            # suffixes that agree in least - l words to the right are a block of neighbours
            block = np.cumsum(same < least - l)[rows]
            order = np.lexsort((whole[rows, l], to_left[rows, l], block))
            r = rows[order]
            b, t, w = block[order], to_left[r, l], whole[r, l]
            new = np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (t[1:] != t[:-1]) | (w[1:] != w[:-1]))))
            size = np.diff(np.append(new, len(r)))
            least_doc, most_doc = np.minimum.reduceat(doc[r], new), np.maximum.reduceat(np.maximum(doc[r], twin[r]), new)
            low[r, l], high[r, l] = np.repeat(least_doc, size), np.repeat(most_doc, size)
            matched[r, l] = np.repeat(least_doc != most_doc, size)
        # runs of stretches that no smaller document has, and of those that one has: what holds for one need not hold for its neighbour
        state = np.where(matched, np.where(low == doc[:, None], 2, 1), 0)
        change = np.diff(state, axis=1, prepend=0, append=0) != 0
        row, a = np.nonzero(change[:, :-1] & (state > 0))
        _, b = np.nonzero(change[:, 1:] & (state > 0))
        b += 1
        first = state[row, a] == 2
        other = np.where(state == 2, high, low).ravel()
        # of the stretches of a run, the smallest document that each names
        smallest = np.minimum.reduceat(np.append(other, 0), np.stack([row * (reach + 1) + a, row * (reach + 1) + b], axis=1).ravel())[::2] if len(row) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([key.take(pa.array(row)), pa.array(doc[row]), pa.array(place[row] - (b - 1)), pa.array(place[row] - a + least), pa.array(smallest), pa.array(first)], names=["key", "doc", "start", "end", "other", "first"])

    def f(batches):
        held: list[pa.RecordBatch] = []

        def ready(table: pa.Table) -> pa.RecordBatch:
            col = lambda x: table.column(x).to_numpy().astype(np.int64)
            codes = lambda x, k: np.frombuffer(b"".join(table.column(x).to_pylist()), ">u4").astype(np.uint32).reshape(-1, k)
            return compare(table.column("key").combine_chunks(), col("head"), col("doc"), table.column("other").fill_null(-(1 << 62)).to_numpy().astype(np.int64), col("near"), col("far"), col("place"), codes("right", least), codes("left", reach), np.frombuffer(b"".join(table.column("marks").to_pylist()), _U))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                table = pa.Table.from_batches(held)
                head = table.column("head").to_numpy()
                # the last head may go on in the next batch
                cut = int(np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))[-1])
                if cut:
                    yield ready(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield ready(pa.Table.from_batches(held))

    return f


def _hot_stretches(least: int, hot):
    def f(batches):
        for h, at, doc, row, head, _, first, last in _texts(batches, least):
            use = np.flatnonzero(_hot(head, hot))
            if len(use):
                n = (last - first + 1)[use]
                start = np.repeat(first[use] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(_runs(h, least)[start].view(np.int64)), pa.array(np.repeat(doc[use], n)), pa.array(start - np.repeat(at[row[use]], n))], names=["stretch", "doc", "start"])

    return f


def shared_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc, start, end, other, first): stretches of words that another document has too, not yet joined; see repeated_passages.

    A stretch may come several times. Null, empty and short texts, rows without doc_id
    and an empty table give none; rows of one doc_id don't repeat each other.
    """
    spark = docs.sparkSession
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heads = stored(read.mapInArrow(_census(least), "head long, low long, high long, n long").groupBy("head").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("low <> high").select("head", "n"))
    many = heads.where(F.col("n") > HOT)
    # of fixed size, however many such heads there are
    hot = None if many.isEmpty() else spark.sparkContext.broadcast(_bloom.build(many, "head", FILTER_BITS))
    wanted = spark.sparkContext.broadcast(_bloom.build(heads, "head", FILTER_BITS))
    # bytes of both sides are stored once, as two steps read them
    rows = stored(read.mapInArrow(_suffixes(least, wanted, hot), _SUFFIX))
    compared = rows.where("not done").select("key", "head", "doc", "other", "near", "far", "place", "right", "left", "marks").repartition("head").sortWithinPartitions("head", "right").mapInArrow(_compared(least), _SPAN)
    # read twice
    compared = stored(compared)
    # the smallest document of a slice is not that of all: what it was found to share, its copies in the slice share as well
    least_of = compared.where("key is not null").groupBy(F.col("key"), F.col("doc").alias("other")).agg(F.min(F.when(F.col("first"), F.col("doc")).otherwise(F.col("other"))).alias("low"))
    done = rows.where("done").select("key", "doc", "start", "end", "other").join(least_of.hint("merge"), ["key", "other"], "left").select("doc", "start", "end", F.coalesce("low", "other").alias("other"), F.lit(False).alias("first"))
    spans = done.unionByName(compared.drop("key"))
    if hot is not None:
        stretches = read.mapInArrow(_hot_stretches(least, hot), "stretch long, doc long, start long")
        ends = stretches.groupBy("stretch").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high")
        own = F.col("doc") == F.col("low")
        spans = spans.unionByName(stretches.join(ends, "stretch").select("doc", "start", (F.col("start") + least).alias("end"), F.when(own, F.col("high")).otherwise(F.col("low")).alias("other"), own.alias("first")))
    return spans


def _joined(spans: DataFrame) -> DataFrame:
    """(doc, start, end, other, first) with overlapping and touching stretches joined."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
    return new.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"), F.min("first").alias("first")).drop("span")


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, start, n_words, other_id, first): the maximal passages of each document all of whose stretches of `least` words stand in another document too.

    Only documents with such passages have rows. Words are those of the contracts:
    ASCII letters in lower case, digits and characters beyond ASCII; start counts them
    from 0. other_id is a document that shares a stretch of the passage; first tells
    that no document of a smaller id has any of it. Reads doc_id and text, leaves
    other columns alone. Rows without doc_id are left out; rows of one doc_id are one
    document, whose repeats among themselves do not count. Null, empty and shorter
    texts, and an empty table, give no rows.
    """
    return _joined(shared_passages(docs, least).distinct()).select(F.col("doc").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("n_words"), F.col("other").alias("other_id"), "first")


def deduplicated(docs: DataFrame, least: int = 50) -> DataFrame:
    """`docs`, all columns, whose text has lost the passages that a document of a smaller id has; see repeated_passages.

    Null and empty texts and rows without doc_id stay as they are, and so do repeated
    rows, which lose the same words each. Columns of any name are passed on. An empty
    table gives none.
    """
    gone = _joined(shared_passages(docs, least).where("not first").distinct()).groupBy(F.col("doc").alias("__quern_doc")).agg(F.collect_list(F.struct("start", "end")).alias("__quern_gone"))
    marked = docs.join(gone, F.col("doc_id") == F.col("__quern_doc"), "left").drop("__quern_doc")

    def cut(batches):
        for batch in slices(batches, "text"):
            k, g = batch.schema.get_field_index("text"), batch.schema.get_field_index("__quern_gone")
            data, offsets = _text.utf8(batch.column(k))
            keep = np.ones(len(data), bool)
            for i, spans in enumerate(batch.column(g).to_pylist()):
                if spans:
                    a, b = offsets[i], offsets[i + 1]
                    starts, ends = _text.spans(data[a:b], np.zeros(0, np.int64), _text.ALNUM)
                    for s in spans:
                        keep[a + starts[s["start"]] : a + ends[s["end"] - 1]] = False
            size = np.concatenate(([0], np.cumsum(keep)))[offsets]
            text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(size), pa.py_buffer(data[keep])])
            text = pa.array([None if not v else t for v, t in zip(batch.column(k).is_valid().to_pylist(), text.to_pylist(), strict=True)], pa.string())
            columns = [text if j == k else batch.column(j) for j in range(batch.num_columns) if j != g]
            yield pa.RecordBatch.from_arrays(columns, names=[x for x in batch.schema.names if x != "__quern_gone"])

    return marked.mapInArrow(cut, docs.schema)
