"""Phrase collocations by contiguous pattern growth over projected occurrence pointers.

Words are counted by language first; a word below the least support is in no phrase.
Each occurrence of a frequent word that a frequent word follows is a pointer: the
prefix and the words to its right, as symbols. Equal pointers of a slice of text are
one with a count. A prefix's pointers go to one task, those of a very frequent one to
several, dealt by the words to the right. Sorted there, they come in the order of a
depth-first growth: all that begin with a prefix, then all that begin with the prefix
and one more word, and so on. So each depth holds one open phrase at a time, a phrase
is closed when its next word changes, and no group of pointers is ever in memory.

Words are named by 63-bit hashes of language and word while they are counted. Two
words of one hash would be seen then, and other hashes taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import slices, stored

#: Words that a worker knows by small numbers at most; rarer ones go by their hash.
CODED = 1 << 21
#: Occurrences of a prefix that one task takes, about.
PART = 1 << 16
#: Bytes of text in a slice, and words of it that are combined at once.
TEXT, COMBINED = 4 << 20, 1 << 20
#: Parts that a language's phrases are ranked in first.
RANKED = 64

_U = np.uint64
#: Pieces end at these bytes, words at them and at spaces and tabs.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


class Words:
    """The words of a slice: bounds in its bytes, number of their row, hash, and whether the next word stands in the same piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int):
        self.data, offsets = _text.utf8(batch.column(1))
        found: list[tuple[np.ndarray, ...]] = []
        for a, b in _text.blocks(self.data, offsets, _WORD):
            part = self.data[a:b]
            lo, hi = np.searchsorted(offsets, a, "right"), np.searchsorted(offsets, b, "left")
            starts, ends = _text.spans(part, offsets[lo:hi] - a, _WORD)
            p, q = _text.powers(len(part))
            sums = np.concatenate((np.zeros(1, _U), np.cumsum(_text._LOWER_VALUES[part] * p[: len(part)])))
            h = (sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(_U)
            breaks = np.concatenate(([0], np.cumsum(_BREAK[part])))
            found.append((starts + a, ends + a, h, breaks[starts], breaks[-1:]))
        none = np.zeros(0, np.int64)
        self.starts, self.ends = (np.concatenate([none, *(f[i] for f in found)]) for i in (0, 1))
        h = np.concatenate([none.astype(_U), *(f[2] for f in found)])
        before = np.cumsum([0, *(int(f[4][0]) for f in found)])
        piece = np.concatenate([none, *(f[3] + n for f, n in zip(found, before, strict=False))])
        self.row = np.searchsorted(offsets, self.starts, "right") - 1
        self.joined = np.append((piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1]), False)[: len(h)]
        names = batch.column(0).dictionary_encode()
        self.langs, self.lang = names.dictionary.to_pylist(), names.indices.to_numpy()
        salts = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8, salt=seed.to_bytes(8, "big")).digest(), "big") for x in self.langs], _U)
        self.hash = (_text.mix(h ^ salts[self.lang[self.row]]) >> _U(1)).astype(np.int64) if len(h) else none

    def text(self, i: int) -> bytes:
        return _text._LOWER[self.data[self.starts[i] : self.ends[i]]].astype(np.uint8).tobytes()


def _counted(seed: int):
    """Of each slice: its distinct words by language, and how often each stands there."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT):
            words = Words(batch, seed)
            h, first, n = np.unique(words.hash, return_index=True, return_counts=True)
            names = pa.array([words.text(i) for i in first.tolist()], pa.binary()).view(pa.string())
            langs = pa.array([words.langs[k] for k in words.lang[words.row[first]]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(h), langs, names, pa.array(n)], names=["h", "lang", "word", "n"])

    return f


def counted_words(docs: DataFrame) -> tuple[int, DataFrame]:
    """(seed, table of h, lang, word, f): all words of lang and text, stored, by a hash that tells them apart."""
    for seed in count():
        found = docs.mapInArrow(_counted(seed), "h long, lang string, word string, n long").groupBy("h")
        ends = found.agg(F.min("lang").alias("lang"), F.max("lang").alias("lang2"), F.min("word").alias("word"), F.max("word").alias("word2"), F.sum("n").alias("f"))
        words = stored(ends)
        if words.where("lang <> lang2 or word <> word2").isEmpty():
            return seed, words.select("h", "lang", "word", "f")


class Codes:
    """Small numbers of the most frequent words, 1 for the most frequent; whole: no other word has the least support."""

    def __init__(self, h: np.ndarray, f: np.ndarray, whole: bool):
        by_count = np.lexsort((h, -f))
        self.hashes = np.concatenate(([0], h[by_count]))
        self.parts = np.concatenate(([1], np.ceil(f[by_count] / PART).astype(np.int64)))
        self.order = np.argsort(h[by_count])
        self.sorted, self.whole = h[by_count][self.order], whole

    def of(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes. 0: too rare for a phrase; below 0: maybe so, named by the hash."""
        at = np.searchsorted(self.sorted, h).clip(max=max(0, len(self.sorted) - 1))
        known = self.sorted[at] == h if len(self.sorted) else np.zeros(len(h), bool)
        out = np.zeros(len(h), np.int64) if self.whole else -1 - h
        out[known] = self.order[at[known]] + 1
        return out

    def parts_of(self, symbols: np.ndarray) -> np.ndarray:
        """How many tasks the pointers of each prefix are dealt to."""
        return self.parts[symbols.clip(min=0)]

    def back(self, symbols: np.ndarray) -> np.ndarray:
        """The hashes of symbols."""
        return np.where(symbols < 0, -1 - symbols, self.hashes[symbols.clip(min=0)])


def codes(words: DataFrame, least: int) -> Codes:
    """Of at most CODED words: whole classes of counts between two powers of two, the most frequent first; only these come to the driver."""
    enough = words.where(F.col("f") >= least).select("h", "f", F.floor(F.log2("f")).cast("int").alias("class"))
    classes = sorted(((r["class"], r["n"]) for r in enough.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)
    total, lowest = 0, 64
    for c, n in classes:
        total += n
        if total > CODED:
            break
        lowest = c
    got = enough.where(F.col("class") >= lowest).select("h", "f").toArrow()
    return Codes(got["h"].to_numpy(), got["f"].to_numpy(), total <= CODED)


def _pointers(seed: int, shared):
    """(a, part, b, c, n): a word, the two words to its right (0 for none), and how often they stand so in a slice.

    part tells the tasks of a very frequent prefix apart. It is below 0 where all places of a and b are in one; 0 or more where b, too, is so frequent that they are dealt by c.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Codes = shared.value
        for batch in slices(batches, "text", TEXT):
            words = Words(batch, seed)
            # two words more than are combined, for what stands to the right of the last ones
            for at in range(0, len(words.hash), COMBINED):
                h, joined = words.hash[at : at + COMBINED + 2], words.joined[at : at + COMBINED + 2]
                distinct, local = np.unique(h, return_inverse=True)
                symbol = known.of(distinct)
                # the first local number stands for no word
                symbol, local = np.append(0, symbol), local + 1
                local[symbol[local] == 0] = 0
                follows = np.zeros((2, len(local)), np.int64)
                follows[0, :-1] = np.where(joined[:-1], local[1:], 0)
                follows[1, :-1] = np.where(follows[0, :-1] > 0, follows[0, 1:], 0)
                keep = np.flatnonzero((local > 0) & (follows[0] > 0))
                keep = keep[keep < COMBINED]
                # at most 2 ** 20 + 3 local numbers
                packed, n = np.unique((local[keep] << 42) | (follows[0, keep] << 21) | follows[1, keep], return_counts=True)
                a, b, c = (symbol[(packed >> k) & ((1 << 21) - 1)] for k in (42, 21, 0))
                # a pair of words is no more frequent than either
                parts, apart = known.parts_of(a), (known.parts_of(a) > 1) & (known.parts_of(b) > 1)
                deal = (_text.mix(_text.mix(b.view(_U)) + np.where(apart, c, 0).view(_U)) % parts.astype(_U)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.where(apart, deal, -1 - deal).astype(np.int32)), pa.array(b), pa.array(c), pa.array(n)], names=["a", "part", "b", "c", "n"])

    return f


def _runs(keys: tuple[np.ndarray, ...], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, sums of n) of the runs of equal keys."""
    change = np.zeros(len(n), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    begins = np.flatnonzero(change)
    return begins, np.add.reduceat(n, begins) if len(begins) else n[:0]


def _grown(shared, least: int):
    """(a, b, c, n), words by their hashes: phrases of three words with the least support, and of two (c null): with it, or where they are dealt to several parts, with their count in this one."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Codes = shared.value

        def closed(triples: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
            triples = triples[:, (triples[4] >= least) & (triples[3] != 0)]
            pairs = pairs[:, (pairs[4] >= least) | (pairs[1] >= 0)]
            both = np.concatenate((triples, pairs), axis=1)
            third = pa.array(known.back(both[3]), mask=np.arange(both.shape[1]) >= triples.shape[1])
            return pa.RecordBatch.from_arrays([pa.array(known.back(both[0])), pa.array(known.back(both[2])), third, pa.array(both[4])], names=["a", "b", "c", "n"])

        # the phrase that is open at each depth, as rows a, part, b, c, n
        triple, pair = np.zeros((5, 0), np.int64), np.zeros((5, 0), np.int64)
        for batch in batches:
            rows = np.concatenate((triple, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])), axis=1)
            at, n = _runs(tuple(rows[:4]), rows[4])
            runs = np.concatenate((rows[:4, at], n[None, :]))
            triples, triple = runs[:, :-1], runs[:, -1:]
            begun = np.concatenate((pair, triples), axis=1)
            at, n = _runs(tuple(begun[:3]), begun[4])
            runs = np.concatenate((begun[:4, at], n[None, :]))
            pairs, pair = runs[:, :-1], runs[:, -1:]
            yield closed(triples, pairs)
        last = np.concatenate((pair, triple), axis=1)
        at, n = _runs(tuple(last[:3]), last[4])
        yield closed(triple, np.concatenate((last[:4, at], n[None, :])))

    return f


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) of whole numbers below 10 ** 16, exactly."""
    wide = lambda x: F.col(x).cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def phrases(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, pairs, triples) of the table lang, text: h, lang, word, f; then a, b, n and a, b, c, n of all phrases of two and three words with n >= least, words by their h."""
    seed, words = counted_words(docs)
    shared = docs.sparkSession.sparkContext.broadcast(codes(words, least))
    pointers = docs.mapInArrow(_pointers(seed, shared), "a long, part int, b long, c long, n long")
    sorted_ = pointers.repartition("a", "part").sortWithinPartitions("a", "part", "b", "c")
    grown = stored(sorted_.mapInArrow(_grown(shared, least), "a long, b long, c long, n long"))
    pairs = grown.where("c is null").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, stored(pairs), grown.where("c is not null")


def collocations(docs: DataFrame, least: int = 10, inside: int = 50, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language of `docs` (lang and text are read; other columns are left alone) the `first` phrases of two or three words that stick together most.

    a counts a phrase's places, overlaps included, l and r those of the two parts at its
    weakest cut (the shortest first part, if tied), n all words of the language; score is
    floor(1000000 a a / (l r)). Phrases with a < least don't count, nor do those of which
    a longer phrase that holds them has `inside` percent of the places or more. Ties go
    to the larger a, then to the phrase's bytes. A null language is `und`, a null or
    empty text has no words. Repeated rows count each time. A language without a
    frequent phrase has no row, and an empty table none.
    """
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words, pairs, triples = phrases(read, least)
    frequent = words.where(F.col("f") >= least)
    left = frequent.select(F.col("h").alias("a"), "lang", F.col("word").alias("word_a"), F.col("f").alias("f_a"))
    right = frequent.select(F.col("h").alias("b"), F.col("word").alias("word_b"), F.col("f").alias("f_b"))
    named = stored(pairs.join(left, "a").join(right, "b"))
    held = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longer"))
    alone = named.join(held, ["a", "b"], "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("n"), F.lit(True)))
    two = alone.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("n").alias("a"), F.col("f_a").alias("l"), F.col("f_b").alias("r")).withColumn("score", _score("a", "l", "r"))
    begin = named.select("a", "b", "lang", "word_a", "word_b", "f_a", F.col("n").alias("n_ab"))
    end = named.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("word_b").alias("word_c"), F.col("f_b").alias("f_c"), F.col("n").alias("n_bc"))
    cut = triples.join(begin, ["a", "b"]).join(end, ["b", "c"]).withColumn("one", _score("n", "f_a", "n_bc")).withColumn("two", _score("n", "n_ab", "f_c"))
    early = F.col("one") <= F.col("two")
    three = cut.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), F.when(early, F.col("f_a")).otherwise(F.col("n_ab")).alias("l"), F.when(early, F.col("n_bc")).otherwise(F.col("f_c")).alias("r"), F.least("one", "two").alias("score"))
    # a language may hold nearly all phrases: its best are found in parts first
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).orderBy(*order)
    best = two.unionByName(three).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= first).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: All phrases of one to three words, counted and put beside their parts and the phrases around them.
SQL = """
WITH pieces AS (SELECT row_number() OVER () AS piece, * FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS w FROM pieces),
f AS MATERIALIZED (SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k)) GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 10),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
around AS (SELECT lang, p, max(f) AS longer FROM (SELECT lang, list_slice(p, 1, 2) AS p, f FROM c WHERE k = 3 UNION ALL SELECT lang, list_slice(p, 2, 3), f FROM c WHERE k = 3) GROUP BY ALL),
cuts AS (SELECT c.lang, c.p, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c) AS c JOIN f AS x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, j) JOIN f AS y ON y.lang = c.lang AND y.p = list_slice(c.p, j + 1, c.k)),
weak AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (SELECT weak.lang, array_to_string(weak.p, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY weak.lang ORDER BY score DESC, a DESC, array_to_string(weak.p, ' ')) AS rank
           FROM weak LEFT JOIN around ON around.lang = weak.lang AND around.p = weak.p WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
