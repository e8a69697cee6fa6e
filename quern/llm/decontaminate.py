"""Benchmark decontamination with suffix arrays of the training text.

Each task sorts the suffixes of its documents' words, a shard at a time, and
searches every suffix of the test items in that array by bisection, all at once.
The neighbours of the place found give the longest verbatim match and where it is;
the range of suffixes that begin with an item's window gives all its occurrences.
Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import slices, stored

_U = np.uint64
#: Words of a shard.
SHARD = 1 << 20
#: Test items are searched in blocks of this many bytes of text; each block is one pass.
ITEM_BYTES = 16 << 20
#: Keep the first v of four 16-bit codes.
_KEEP = np.array([0, 0xFFFF << 48, 0xFFFFFFFF << 32, 0xFFFFFFFFFFFF << 16, (1 << 64) - 1], _U)


def _codes(hashes: np.ndarray) -> np.ndarray:
    """16 bits of a word's hash, never 0: 0 stands between texts. Matches by code are verified by hash."""
    return np.maximum(hashes >> _U(48), _U(1))


def _laid_out(hashes: np.ndarray, cuts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word, codes packed by four from each place, hashes by place), with a gap at each of `cuts` (word numbers) and `pad` empty places at the end."""
    place = np.arange(len(hashes)) + np.searchsorted(cuts, np.arange(len(hashes)), "right")
    total = len(hashes) + len(cuts) + pad + 4
    code, at = np.zeros(total + 4, _U), np.zeros(total, _U)
    code[place] = _codes(hashes)
    at[place] = hashes
    packed = (code[:total] << _U(48)) | (code[1 : total + 1] << _U(32)) | (code[2 : total + 2] << _U(16)) | code[3 : total + 3]
    return place, packed, at


class SuffixArray:
    """The suffixes of `hashes` (texts end at `cuts`), in order as far as their first `depth` words."""

    def __init__(self, hashes: np.ndarray, cuts: np.ndarray, depth: int):
        self.place, self.packed, self.at = _laid_out(hashes, cuts, depth + 8)
        total = len(hashes) + len(cuts)
        sa = np.argsort(self.packed[:total])
        key = self.packed[sa]
        new = np.concatenate(([True], key[1:] != key[:-1]))[:total]
        first = np.maximum.accumulate(np.where(new, np.arange(total), 0))
        rank = np.zeros(total + depth + 8, np.int64)
        rank[sa] = first + 1
        last = np.append(new[1:], True)[:total]
        tied = np.flatnonzero(~(new & last))
        h = 4
        while h < depth and len(tied):
            # suffixes equal in their first h words are ordered by the rank of what follows
            t = sa[tied]
            key = (rank[t] << 32) | rank[t + h]
            order = np.argsort(key)
            t, key = t[order], key[order]
            sa[tied] = t
            new = np.concatenate(([True], key[1:] != key[:-1]))
            rank[t] = np.maximum.accumulate(np.where(new, tied, 0)) + 1
            tied = tied[~(new & np.append(new[1:], True))]
            h *= 2
        self.sa, self.total = sa, total


class Items:
    """The words of test items, with each of their suffixes as a query."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        raw, offsets = _text.utf8(pa.array(texts, pa.string()))
        hashes, at = _text.words(raw, offsets, _text.ALNUM)
        counts = np.diff(at)
        self.ids = sorted({str(i) for i in ids if i is not None})
        number = {x: k for k, x in enumerate(self.ids)}
        self.place, self.packed, self.at = _laid_out(hashes, at[1:], 8 + int(counts.max(initial=0)))
        item = np.repeat(np.arange(len(counts)), counts)
        self.start = np.arange(len(hashes)) - at[item]
        self.length = counts[item] - self.start
        self.window = np.minimum(window, counts[item])
        self.item = np.array([-1 if ids[k] is None else number[str(ids[k])] for k in range(len(ids))], np.int64)[item]
        self.depth = int(counts.max(initial=1))

    def _compare(self, s: SuffixArray, p: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the first `length` words from p in the shard stand to those from q in the items."""
        out, act, t = np.zeros(len(p), np.int8), np.flatnonzero(length > 0), 0
        while len(act):
            keep = _KEEP[np.minimum(length[act] - t, 4)]
            a, b = s.packed[p[act] + t] & keep, self.packed[q[act] + t] & keep
            out[act] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            t += 4
            act = act[(a == b) & (length[act] > t)]
        return out

    def bound(self, s: SuffixArray, q: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """By bisection, the first suffix that is not below (upper: that is above) each query's first `length` words."""
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), s.total, np.int64)
        act = np.flatnonzero(lo < hi)
        while len(act):
            mid = (lo[act] + hi[act]) >> 1
            c = self._compare(s, s.sa[mid], q[act], length[act])
            below = (c <= 0) if upper else (c < 0)
            lo[act[below]] = mid[below] + 1
            hi[act[~below]] = mid[~below]
            act = act[lo[act] < hi[act]]
        return lo

    def common(self, s: SuffixArray, p: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many words from p and q are equal, up to `length`; by their full hashes."""
        out, act = np.zeros(len(p), np.int64), np.flatnonzero(length > 0)
        while len(act):
            same = s.at[p[act] + out[act]] == self.at[q[act] + out[act]]
            act = act[same]
            out[act] += 1
            act = act[out[act] < length[act]]
        return out

    def agree(self, s: SuffixArray, p: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many codes from p and q are equal, up to `length`: never fewer than words."""
        out, act = np.zeros(len(p), np.int64), np.flatnonzero(length > 0)
        while len(act):
            same = (s.packed[p[act] + out[act]] ^ self.packed[q[act] + out[act]]) & _KEEP[1] == 0
            act = act[same]
            out[act] += 1
            act = act[out[act] < length[act]]
        return out

    def longest(self, s: SuffixArray, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of the longest match that each test suffix, or each of those in `which`, has in the shard."""
        place, length = (self.place, self.length) if which is None else (self.place[which], self.length[which])
        at = self.bound(s, place, length, False)
        best, where, coded = (np.zeros(len(at), np.int64) for _ in range(3))
        for side in (at - 1, at):
            ok = np.flatnonzero((side >= 0) & (side < s.total))
            p = s.sa[side[ok]]
            n = self.common(s, p, place[ok], length[ok])
            coded[ok] = np.maximum(coded[ok], self.agree(s, p, place[ok], length[ok]))
            better = n > best[ok]
            best[ok[better]], where[ok[better]] = n[better], p[better]
        # another word of the same code stands beside these: look through all suffixes of the codes in question
        for i in np.flatnonzero(coded > best).tolist():
            one = place[i : i + 1]
            for n in range(int(coded[i]), int(best[i]), -1):
                some = np.array([n])
                p = s.sa[int(self.bound(s, one, some, False)[0]) : int(self.bound(s, one, some, True)[0])]
                whole = np.flatnonzero(self.common(s, p, np.full(len(p), one[0]), np.full(len(p), n)) >= n)
                if len(whole):
                    best[i], where[i] = n, p[whole[0]]
                    break
        return best, where

    def occurrences(self, s: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """(place, query) of every occurrence of every test window."""
        whole = np.flatnonzero(self.length >= self.window)
        lo = self.bound(s, self.place[whole], self.window[whole], False)
        at = s.sa[np.minimum(lo, s.total - 1)]
        there = (lo < s.total) & (self._compare(s, at, self.place[whole], self.window[whole]) == 0)
        hit, lo = whole[there], lo[there]
        n = self.bound(s, self.place[hit], self.window[hit], True) - lo
        query = np.repeat(hit, n)
        place = s.sa[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(n) else np.zeros(0, np.int64)
        # suffixes equal by code are compared by hash
        same = self.common(s, place, self.place[query], self.window[query]) >= self.window[query]
        return place[same], query[same]


def _shards(hashes: np.ndarray, at: np.ndarray, depth: int, overlap: int) -> Iterator[tuple[int, SuffixArray, np.ndarray]]:
    """(first word, suffix array, word number by place) of each shard; shards overlap so that no window is cut."""
    for a in range(0, len(hashes), SHARD):
        b = min(len(hashes), a + SHARD + overlap)
        ends = at[(at > a) & (at <= b)] - a
        s = SuffixArray(hashes[a:b], ends, depth)
        back = np.full(s.total + depth + 16, -1, np.int64)
        back[s.place] = np.arange(a, b)
        yield a, s, back


def _marks(items: Items, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(hit, numbers): whether each word is inside an occurrence, and the items found in each row."""
    edge = np.zeros(len(hashes) + 1, np.int64)
    found = [np.zeros(0, np.int64)]
    rows, n_items = len(at) - 1, max(1, len(items.ids))
    if len(items.place):
        longest = int(items.window.max())
        for _, s, back in _shards(hashes, at, longest, longest - 1):
            place, query = items.occurrences(s)
            word = back[place]
            edge += np.bincount(word, minlength=len(edge)) - np.bincount(word + items.window[query], minlength=len(edge))
            named = items.item[query] >= 0
            found.append(np.unique((np.searchsorted(at, word[named], "right") - 1) * n_items + items.item[query[named]]))
    found = np.unique(np.concatenate(found))
    cut = np.searchsorted(found // n_items, np.arange(1, rows))
    return np.cumsum(edge[:-1]) > 0, np.split(found % n_items, cut)


def _per_row(hit: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(hit)))
    return sums[at[1:]] - sums[at[:-1]]


def _contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _scan(items):
    """For each batch, it and (n_words, hit, at, numbers of the items found, row by row)."""

    def f(batches):
        for batch in slices(batches, "text"):
            data, offsets = _text.utf8(batch.column(batch.schema.get_field_index("text")))
            hashes, at = _text.words(data, offsets, _text.ALNUM)
            hit, found = _marks(items.value, hashes, at)
            yield batch, np.diff(at), hit, at, found

    return f


def _stretches(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the `n` words from each place on, that many places fewer at the end; the ends of texts are not heeded."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    p, q = _text.powers(len(hashes))
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * p[: len(hashes)], out=sums[1:])
    return _text.mix((sums[n:] - sums[:-n]) * q[: len(hashes) - n + 1])


class Heads:
    """The first `n` words of the test suffixes that have so many, as hashes with a table of bits before them. What is not among them has no match of `n` words; what is may be something else of the same hash."""

    BITS = 22

    def __init__(self, items: Items, n: int):
        self.n, self.number = n, np.flatnonzero(items.length >= n)
        heads = _stretches(items.at, n)[items.place[self.number]]
        order = np.argsort(heads)
        self.heads, self.number = heads[order], self.number[order]
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[self.heads >> _U(64 - self.BITS)] = True

    def met(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, suffixes): which words stand in a stretch that begins a test suffix, in order, and the numbers of these suffixes."""
        stretch = _stretches(hashes, self.n)
        start = np.flatnonzero(self.bits[stretch >> _U(64 - self.BITS)])
        # within one text
        start = start[at[np.searchsorted(at, start, "right")] >= start + self.n] if len(start) else start
        lo = np.searchsorted(self.heads, stretch[start])
        found = lo < len(self.heads)
        found[found] = self.heads[lo[found]] == stretch[start[found]]
        start = start[found]
        inside = np.zeros(len(hashes) + 1, np.int64)
        inside[start] += 1
        inside[start + self.n] -= 1
        return np.flatnonzero(np.cumsum(inside[:-1])), np.sort(self.number[np.isin(self.heads, stretch[start])])


def _blocks(benchmark: DataFrame, window: int) -> tuple[int, Iterator]:
    """(number of blocks, broadcasts of the test items): ITEM_BYTES of texts and ids at a time, each made when it is asked for; equal items are one, and those without a word, which hit nothing, stay where they are."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).distinct()
    # and what an object takes besides
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)) + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // ITEM_BYTES))
    rows = stored(rows) if n > 1 else rows

    def each():
        for k in range(n):
            part = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)).collect()
            block = spark.sparkContext.broadcast(Items([r["id"] for r in part], [r["text"] for r in part], window))
            yield block
            if n > 1:
                block.unpersist()

    return n, each()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """One row of REPORT for each row of `docs` (doc_id and text are read; other columns are left alone).

    Words: ASCII letters in lower case, digits and all characters beyond ASCII. A test
    item's windows are its runs of `window` words; an item of fewer words, but not none,
    is one window. n_hit: the document's words inside occurrences of windows; n_items:
    distinct items with such windows, items_sha256 their ids sorted as strings and
    comma-joined. Contaminated: n_hit > 0 and 5 % of the words or more. Null or empty
    texts have no words and are not contaminated; null doc_ids keep their rows, repeated
    rows are each reported; an item without id marks words, but is not counted. No items
    or no documents: nothing is hit, or no rows. Items beyond ITEM_BYTES of text take
    one pass for each block of that size.
    """
    n_blocks, blocks = _blocks(benchmark, window)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n_blocks == 1:
        items = next(blocks)
        scan = _scan(items)

        def report(batches):
            for batch, n, hit, at, found in scan(batches):
                hits = _per_row(hit, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(hits), pa.array([len(x) for x in found], pa.int64()), pa.array([_digest([items.value.ids[k] for k in x]) for x in found], pa.string()), pa.array(_contaminated(hits, n))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

        return read.mapInArrow(report, REPORT)
    # rows are numbered once, in a stored table: each block's pass has to find the same numbers
    return _merged(stored(read.withColumn("row", F.monotonically_increasing_id())), blocks).drop("row")


def _merged(read: DataFrame, blocks: Iterator) -> DataFrame:
    """REPORT for items in several blocks, one pass for each: the ranges of hit words and the items found, joined by row."""

    def one(items, first):
        def f(batches):
            for batch, n, hit, at, found in _scan(items)(batches):
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                # a run of hit words may cover the end of one text and the start of the next
                starts = np.union1d(edges[::2], at[:-1][(at[:-1] < len(hit)) & np.append(hit, False)[at[:-1]]])
                ends = np.union1d(edges[1::2], at[1:][(at[1:] > 0) & np.append(hit, False)[at[1:] - 1]])
                row = np.searchsorted(at, starts, "right") - 1
                cut = np.searchsorted(row, np.arange(1, len(n)))
                ranges = [[{"start": a, "end": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)] for x, y in zip(np.split(starts - at[row], cut), np.split(ends - at[row], cut), strict=True)]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(n), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([[items.value.ids[k] for k in x] for x in found], pa.list_(pa.string()))],
                    names=["doc_id", "row", "n_words", "ranges", "items"],
                )
                # the first pass reports every row, the others those with hits
                yield out if first else out.filter(pa.array([bool(x) for x in ranges]))

        return f

    parts = [stored(read.mapInArrow(one(items, not k), "doc_id long, row long, n_words long, ranges array<struct<start: long, end: long>>, items array<string>")) for k, items in enumerate(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    # ranges of several blocks overlap: each adds what lies beyond those before it
    before = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = found.select("row", F.explode("ranges").alias("r")).select("row", "r.start", "r.end").withColumn("new", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0)))
    hits = ranges.groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = found.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("names"))
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("names", F.array().cast("array<string>"))
    return (
        parts[0].select("row", "doc_id", "n_words").join(hits, "row", "left").join(named, "row", "left")
        .select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), _contaminated(n_hit, F.col("n_words")).alias("contaminated"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of `docs`, all columns, that `contamination` does not mark. Nulls, repeats and empty inputs as there."""
    n_blocks, blocks = _blocks(benchmark, window)
    if n_blocks == 1:
        scan = _scan(next(blocks))

        def keep(batches):
            for batch, n, hit, at, _ in scan(batches):
                yield batch.filter(pa.array(~_contaminated(_per_row(hit, at), n)))

        return docs.mapInArrow(keep, docs.schema)
    row = "__quern_row"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    marked = _merged(numbered.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(row).alias("row")), blocks)
    return numbered.join(marked.where("contaminated").select(F.col("row").alias(row)), row, "left_anti").drop(row)


def longest_matches(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, window: int = 13) -> DataFrame:
    """(item_id, item_start, length, doc_id, doc_start): for each suffix of a test item and each shard, the longest verbatim match of `min_words` words or more, and where it stands.

    Starts count words from 0. Shards are cut by size, so a suffix may be listed once for
    each. Null or empty texts match nothing; a null doc_id or item_id is passed on as it
    is; repeated rows are each listed; of several places in a shard that match as long,
    one is listed. No items or no documents: no rows.

    A match lies whole in stretches of `min_words` words that begin some test suffix.
    Stretches are hashed and looked up first, and suffix arrays made of the words inside
    those that are found alone, and searched for the suffixes that they begin alone: the
    rest of the text, most of it, is neither sorted nor searched.
    """
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    found = None
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in _blocks(benchmark, window)[1]:

        def f(batches, items=items):
            it = items.value
            heads = Heads(it, min_words)
            for batch in slices(batches, "text"):
                data, offsets = _text.utf8(batch.column(1))
                hashes, at = _text.words(data, offsets, _text.ALNUM)
                inside, which = heads.met(hashes, at)
                if not len(inside):
                    continue
                # texts end where a word is left out, too
                ends = np.union1d(np.searchsorted(inside, at), np.flatnonzero(np.diff(inside) > 1) + 1)
                for _, s, back in _shards(hashes[inside], ends, it.depth, it.depth - 1):
                    best, where = it.longest(s, which)
                    q = np.flatnonzero(best >= min_words)
                    word = inside[back[where[q]]]
                    q = which[q]
                    row = np.searchsorted(at, word, "right") - 1
                    names = [it.ids[k] if k >= 0 else None for k in it.item[q]]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(it.start[q]), pa.array(best[best >= min_words]), batch.column(0).take(pa.array(row)), pa.array(word - at[row])], names=["item_id", "item_start", "length", "doc_id", "doc_start"])

        part = stored(read.mapInArrow(f, "item_id string, item_start long, length long, doc_id long, doc_start long"))
        found = part if found is None else found.union(part)
    return found


def longest_by_suffix(docs: DataFrame, benchmark: DataFrame, min_words: int = 13) -> DataFrame:
    """(item_id, item_start, length): for each suffix of a test item that some document has `min_words` words or more of, how many words the longest such match has; see longest_matches.

    One row for each item_id and start, whatever the number of shards and documents. An
    item without id has no rows; items of one id are one here, and the longer match counts.
    """
    found = longest_matches(docs, benchmark, min_words).where("item_id is not null")
    return found.groupBy("item_id", "item_start").agg(F.max("length").alias("length"))
