"""Quality scores by histogram gradient-boosted trees over document statistics.

One pass takes the statistics of every whole text; they are stored, and all else
works on them. Trees are grown on the driver from a bounded sample of labelled rows,
level by level, from histograms of binned statistics. They are complete trees in flat
arrays, so all rows walk down a tree together, one level for each step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import slices, stored
from .language import held_out

#: Labelled rows that the trees are grown from, at most: those with the smallest hashes of doc_id.
FIT_ROWS = 30_000
BINS, DEPTH, TREES, RATE = 64, 5, 80, 0.15

_KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "bracket", "sign", "bar", "control", "high")
_KIND = np.zeros(256, np.int64)
_KIND[:] = _KINDS.index("control")
for _k, _chars in (("space", b" \t"), ("newline", b"\n\r"), ("stop", b".,;:?"), ("quote", b"'\"`-"), ("bracket", b"()[]{}<>"), ("sign", b"!#$%&*+/=@\\^_~"), ("bar", b"|")):
    _KIND[list(_chars)] = _KINDS.index(_k)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = (_KINDS.index(k) for k in ("lower", "upper", "digit", "high"))
_LINE = np.ones(256, bool)
_LINE[[0x0A, 0x0D]] = False

STATISTICS = ("log_bytes", *(f"share_{k}" for k in _KINDS), "log_words", "word_length", "distinct_words", "most_common_word", "repeated_word", "distinct_pairs", "log_lines", "line_length", "distinct_lines", "words_per_stop", "upper_per_word", "log_distinct_words")


def _repeats(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct, most) of each row: how many of its hashes are distinct, and how often the commonest stands."""
    rows = len(at) - 1
    distinct, most = np.zeros(rows), np.zeros(rows)
    if not len(h):
        return distinct, most
    # rows of a slice are far fewer than 2 ** 20; 44 bits of a hash tell its words apart
    row = np.repeat(np.arange(rows), np.diff(at))
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    run = np.diff(np.append(first, len(key)))
    where = (key[first] >> np.uint64(44)).astype(np.int64)
    distinct += np.bincount(where, minlength=rows)
    np.maximum.at(most, where, run)
    return distinct, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each text, as float32 rows."""
    rows, size = len(offsets) - 1, np.diff(offsets).astype(float)
    kinds = np.zeros((rows, len(_KINDS)))
    for a in range(0, len(data), _text.BLOCK):
        b = min(len(data), a + _text.BLOCK)
        row = np.searchsorted(offsets, a, "right") - 1
        cuts = np.clip(offsets[row : np.searchsorted(offsets, b, "left") + 1] - a, 0, b - a)
        code = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) * len(_KINDS) + _KIND[data[a:b]]
        kinds[row : row + len(cuts) - 1] += np.bincount(code, minlength=(len(cuts) - 1) * len(_KINDS)).reshape(-1, len(_KINDS))
    h, at = _text.words(data, offsets, _text.SOLID)
    n = np.diff(at).astype(float)
    distinct, most = _repeats(h, at)
    same = np.zeros(len(h), bool)
    pair = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        same[1:] = h[1:] == h[:-1]
        same[at[:-1][at[:-1] < len(h)]] = False
        pair[1:] = _text.mix(h[1:] * np.uint64(3) + h[:-1])
        pair[0] = h[0]
    repeated = np.concatenate(([0], np.cumsum(same)))
    pairs, _ = _repeats(pair, at)
    lines, line_at = _text.words(data, offsets, _LINE)
    n_lines = np.diff(line_at).astype(float)
    distinct_lines, _ = _repeats(lines, line_at)
    one = lambda x: np.maximum(x, 1)
    stops, upper = kinds[:, _KINDS.index("stop")], kinds[:, _KINDS.index("upper")]
    out = [np.log1p(size), *(kinds / one(size)[:, None]).T, np.log1p(n), (size - kinds[:, _KINDS.index("space")]) / one(n), distinct / one(n), most / one(n), (repeated[at[1:]] - repeated[at[:-1]]) / one(n), pairs / one(n), np.log1p(n_lines), n / one(n_lines), distinct_lines / one(n_lines), n / one(stops), upper / one(n), np.log1p(distinct)]
    return np.stack(out, axis=1).astype(np.float32)


class Trees:
    """Complete trees of DEPTH levels: feature and threshold of each inner node, value of each leaf."""

    def __init__(self):
        self.base, self.feature, self.threshold, self.value = 0.0, np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1), np.float32), np.zeros((0, 2**DEPTH))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[every, feature[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, least: int = 8) -> None:
        """Newton boosting of the log loss."""
        if not len(y):
            return
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if y.min() == y.max():
            return
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])).astype(np.float32) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        total = np.full(len(y), self.base)
        features, thresholds, values = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf, np.float32)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                split = np.full(width, -1)
                for j, e in enumerate(edges):
                    code = (node - first) * BINS + binned[:, j]
                    sums = [np.bincount(code, w, minlength=width * BINS).reshape(width, BINS) for w in (g, h, None)]
                    left = [np.cumsum(s, axis=1) for s in sums]
                    (gl, hl, nl), (ga, ha, na) = left, [s[:, -1:] for s in left]
                    gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                    gain[(nl < least) | (na - nl < least)] = 0
                    gain = gain[:, : len(e)]
                    if not gain.shape[1]:
                        continue
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best[better] = gain[np.arange(width), k][better]
                    feature[first : first + width][better] = j
                    threshold[first : first + width][better] = e[k[better]]
                    split[better] = k[better]
                f = feature[node]
                cut = np.where(split >= 0, split, BINS)[node - first]
                node = 2 * node + 1 + (binned[np.arange(len(y)), f] > cut)
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, minlength=2**DEPTH) / (np.bincount(leaf, h, minlength=2**DEPTH) + ridge)
            total += value[leaf]
            features.append(feature)
            thresholds.append(threshold)
            values.append(value)
        self.feature, self.threshold, self.value = np.stack(features), np.stack(thresholds), np.stack(values)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each whole text; a null text has those of an empty one. Null doc_ids and repeated rows are each measured, an empty table gives none."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            x = statistics(*_text.utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(f, "doc_id long, x array<float>")


def quality_scores(docs: DataFrame, labels: DataFrame, fold: int = 1, parts: int = 3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id and text are read; other columns are left alone).

    Grown from at most `fit_rows` labelled rows that are not held out. Null and empty
    texts are scored by the statistics of no text. Null labels are left out; of several
    labels of a document the mean counts, above a half as 1. A null doc_id is held out.
    Repeated rows are each scored; no documents give no rows; without labels every
    score is 0.5.
    """
    stats = stored(measured(docs))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y")).where(~held_out(fold, parts))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # documents of one id in several rows count once
    sample = stats.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("y").alias("y")).orderBy("doc_id").toPandas()
    trees = Trees()
    if len(sample):
        trees.fit(np.stack(sample["x"].to_numpy()).astype(np.float32), (sample["y"].to_numpy() > 0.5).astype(float))
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                score = model.value.score(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", held_out(fold, parts).alias("held_out"), "x").mapInArrow(f, "doc_id long, held_out boolean, score double, predicted int")
