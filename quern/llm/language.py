"""Language identification by a byte convolutional network, trained here in numpy.

A text is cut into windows of WINDOW bytes. Filters of two, three and four bytes run
over each window; each filter's largest response feeds a softmax. A filter is a table
of weights for each byte at each of its places, so its response is a sum of table
rows. Scoring folds the tables to pairs of bytes and takes two rows for each byte.
A document's log probabilities are the means over all its windows, weighted by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Windows scored at once.
AT_ONCE = 512
#: The sample that the network is trained on: documents of each language, and windows of each.
FIT_PER_LANGUAGE, FIT_WINDOWS = 400, 4
#: Documents of all languages together in the sample, at most.
FIT_TOTAL = 20_000
#: Steps of a fit, at least.
LEAST_STEPS = 400
#: Parts that a language's documents are ranked in.
PARTS = 64


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[0x41:0x5B] = out[0x61:0x7B] = True
    return out


_ASCII_LETTER = _letters()


class Net:
    """Filters, biases and the softmax layer; `langs` in sorted order."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables by pair of bytes: what the bytes at p and p + 1 add to each filter at p, and what those at p + 2 and p + 3 add."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        zero = np.zeros((256, FILTERS), np.float32)
        two, three, four = self.tables
        head = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        tail = np.concatenate([pair(three[2], zero), pair(four[2], four[3])], axis=1)
        return np.ascontiguousarray(head), np.ascontiguousarray(tail)

    def fit(self, windows: np.ndarray, label: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.02) -> None:
        """Adam on the cross entropy, each language with the same weight; windows: bytes, zeros at the end of short ones."""
        rng = np.random.default_rng(11)
        n, k = len(windows), FILTERS
        weight = (len(label) / (len(self.langs) * np.maximum(1, np.bincount(label, minlength=len(self.langs)))))[label].astype(np.float32)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        # few windows are gone over more often
        epochs = max(epochs, -(-LEAST_STEPS // -(-n // batch)))
        for epoch in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                at = order[a : a + batch]
                x = windows[at]
                pooled, where = [], []
                for w, t in zip(WIDTHS, self.tables, strict=True):
                    r = sum(t[j][x[:, j : x.shape[1] - 3 + j]] for j in range(w))
                    best = r.argmax(axis=1)
                    where.append(best)
                    pooled.append(np.take_along_axis(r, best[:, None, :], axis=1)[:, 0, :])
                h = np.concatenate(pooled, axis=1) + self.bias
                act = np.maximum(h, 0)
                z = act @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(at)), label[at]] -= 1
                dz = p * (weight[at] / len(at))[:, None]
                dh = (dz @ self.out.T) * (h > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                for g, (w, best) in enumerate(zip(WIDTHS, where, strict=True)):
                    d = dh[:, g * k : (g + 1) * k]
                    for j in range(w):
                        byte = np.take_along_axis(x, best + j, axis=1)
                        np.add.at(grads[g][j], (byte, np.arange(k)[None, :]), d)
                grads += [dh.sum(axis=0), act.T @ dz, dz.sum(axis=0)]
                step += 1
                now = rate * (1 - epoch / epochs)
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


class Scorer:
    def __init__(self, net: Net):
        self.net = net
        self.head, self.tail = net.folded()

    def _windows(self, padded: np.ndarray) -> np.ndarray:
        """Log probabilities of windows; padded: (n, WINDOW + 3) bytes."""
        n = len(padded)
        wide = padded.astype(np.int64)
        pair = wide[:, :-1] * 256 + wide[:, 1:]
        r = np.take(self.head, pair[:, :WINDOW].ravel(), axis=0)
        r[:, FILTERS:] += np.take(self.tail, pair[:, 2 : WINDOW + 2].ravel(), axis=0)
        h = np.maximum(r.reshape(n, WINDOW, -1).max(axis=1) + self.net.bias, 0)
        z = h.astype(np.float64) @ self.net.out + self.net.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    @staticmethod
    def lettered(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text has a letter."""
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        lettered = np.zeros(len(size), bool)
        if len(full):
            lettered[full] = np.logical_or.reduceat(_ASCII_LETTER[data], offsets[full])
        for i in np.flatnonzero(~lettered & (size > 0)):
            lettered[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
        return lettered

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, probability) of each text; `und` and 0 for one without letters."""
        rows, size, lettered, langs = len(offsets) - 1, np.diff(offsets), self.lettered(data, offsets), self.net.langs
        if not langs:
            return ["und"] * rows, np.zeros(rows)
        total = np.zeros((rows, len(langs)))
        count = np.where(lettered, -(-size // WINDOW), 0)
        row = np.repeat(np.arange(rows), count)
        start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        length = np.minimum(offsets[row + 1] - start, WINDOW)
        body = np.concatenate([data, np.zeros(WINDOW + 3, np.uint8)])
        step = np.arange(WINDOW + 3)
        for a in range(0, len(row), AT_ONCE):
            s, n = start[a : a + AT_ONCE], length[a : a + AT_ONCE]
            padded = body[s[:, None] + step]
            padded[step[None, :] >= n[:, None]] = 0
            np.add.at(total, row[a : a + AT_ONCE], self._windows(padded) * n[:, None])
        mean = total / np.maximum(size, 1)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], np.where(lettered, p[np.arange(rows), best], 0.0)


def held_out(fold: int, parts: int) -> Column:
    """Whether crc32 of doc_id as text leaves `fold` modulo `parts`; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == fold, F.lit(True))


def trained(docs: DataFrame, fold: int = 2, parts: int = 4, per_language: int = FIT_PER_LANGUAGE) -> Net:
    """A network fitted to at most `per_language` documents of each language, FIT_WINDOWS windows of each, and to FIT_TOTAL documents in all: those of the smallest hashes of doc_id, without the held-out fold."""
    # empty texts teach nothing, so they take no place in the sample
    known = docs.where("octet_length(text) > 0").select("doc_id", "lang").where("lang is not null and doc_id is not null").where(~held_out(fold, parts))
    # a language may have most of the rows: ranked in parts first, then among what is left
    ranked = known.distinct().withColumn("hash", F.xxhash64("doc_id"))
    for keys in (["lang", F.pmod("hash", F.lit(PARTS))], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))).where(F.col("rank") <= per_language)
    # each language's first, then each one's second, and so on: few of each where there are very many languages
    chosen = ranked.orderBy("rank", "hash", "doc_id").limit(FIT_TOTAL).select("doc_id", "lang")
    span = F.greatest(F.octet_length("text") - WINDOW, F.lit(0))
    places = F.transform(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1)), lambda k: F.floor(k * span / max(1, FIT_WINDOWS - 1)).cast("int"))
    raw = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("text")).where("octet_length(text) > 0").join(F.broadcast(chosen), ["doc_id", "lang"])
    # a doc_id may be repeated without bound: of its rows in one language, the text of the least hash is taken
    cut = raw.select("doc_id", "lang", F.struct(F.xxhash64("text").alias("hash"), F.array_distinct(F.transform(places, lambda a: F.substring("text", a + 1, F.lit(WINDOW)))).alias("windows")).alias("cut"))
    got = cut.groupBy("doc_id", "lang").agg(F.min("cut").alias("cut")).select("doc_id", "lang", F.explode("cut.windows").alias("window")).orderBy("lang", "doc_id", "window").toPandas()
    langs = sorted(got["lang"].unique())
    net = Net(langs)
    if langs:
        rng = np.random.default_rng(5)
        windows = np.zeros((2 * len(got), WINDOW + 3), np.uint8)
        for i, w in enumerate(got["window"]):
            b = np.frombuffer(w, np.uint8)
            windows[2 * i, : len(b)] = b
            # and a short stretch of it, as short documents are
            n = int(rng.integers(12, 128))
            a = int(rng.integers(0, max(1, len(b) - n)))
            windows[2 * i + 1, : len(b[a : a + n])] = b[a : a + n]
        net.fit(windows, np.repeat([langs.index(x) for x in got["lang"]], 2))
    return net


def _scored(net) -> object:
    def f(batches: Iterator[pa.RecordBatch]):
        scorer = None
        for batch in slices(batches, "text", 1 << 20):
            scorer = scorer or Scorer(net.value)
            yield batch, *scorer.texts(*_text.utf8(batch.column(batch.schema.get_field_index("text"))))

    return f


def languages(docs: DataFrame, fold: int = 2, parts: int = 4) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text and lang are read; other columns are left alone).

    Trained on a bounded sample of the rows with a lang that are not held out, scored
    over whole texts. `und` with score 0: null text, text without a letter, or no
    language to learn. A null doc_id is held out. Repeated rows are each scored; an
    empty table gives no rows. Ties go to the language that sorts first.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scored = _scored(docs.sparkSession.sparkContext.broadcast(trained(read, fold, parts)))

    def f(batches):
        for batch, langs, score in scored(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return read.select("doc_id", held_out(fold, parts).alias("held_out"), "text").mapInArrow(f, "doc_id long, held_out boolean, lang_pred string, score double")


def in_language(docs: DataFrame, accepted: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language: not `und`, one of `accepted` (all, if None), with `min_score` or more.

    Null and empty texts and those without a letter are `und` and go. Repeated rows are
    each judged; columns of any name are passed on; an empty table gives no rows. Where
    no row has both a lang and a text, no language can be learned: then all texts with
    a letter stay, and to ask for some languages or for a score raises ValueError.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = trained(read)
    if not net.langs:
        if (accepted is not None or min_score > 0) and not docs.isEmpty():
            raise ValueError("no row has a lang to learn from")

        def with_letters(batches):
            for batch in slices(batches, "text", 1 << 20):
                yield batch.filter(pa.array(Scorer.lettered(*_text.utf8(batch.column(batch.schema.get_field_index("text"))))))

        return docs.mapInArrow(with_letters, docs.schema)
    scored = _scored(docs.sparkSession.sparkContext.broadcast(net))

    def f(batches):
        for batch, langs, score in scored(batches):
            yield batch.filter(pa.array([x != "und" and s >= min_score and (accepted is None or x in accepted) for x, s in zip(langs, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(f, docs.schema)
