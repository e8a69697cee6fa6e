"""Token counts by rank-synchronous merging of ragged arrays.

For the piece vocabulary of a .model file. A batch's texts are cut into pre-tokens
(a run of spaces and what follows up to the next space; no piece of the vocabulary
has a space after another character, so no merge crosses such a cut), and these where
two characters meet that stand side by side in no piece. What is left of each
distinct pre-token is held as rows of a ragged array of symbols. In each round every
row finds its lowest-rank adjacent pair, and all rows apply theirs at once; rows
without a pair leave. What survives is counted, a character that the vocabulary lacks
as its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._bpe import Pairs, merge_rounds
from ._spark import slices

#: Bytes of distinct pre-tokens merged at once, or one pre-token.
BYTES = 1 << 20
#: Distinct pre-tokens whose counts a worker keeps between batches, and the longest kept.
KEPT, KEPT_BYTES = 1 << 17, 64
_SPACE = "▁"


class Merges:
    """The pairs of symbols that merge, and their ranks, read from a vocabulary through its library."""

    def __init__(self, pieces: list[tuple[str, float]]):
        ranked = sorted({-s for _, s in pieces})
        place = {s: r for r, s in enumerate(ranked)}
        # a rank is a class of equal scores: the leftmost goes first among equals
        self.rank_of = {p: place[-s] for p, s in pieces}
        self.names = [p for p, _ in pieces]
        self.number = {p: i for i, p in enumerate(self.names)}
        self.known = len(self.names)
        for p, _ in pieces:
            for c in p:
                if c not in self.number:
                    self.number[c] = len(self.number)
        left, right, merged, rank = [], [], [], []
        for p, _ in pieces:
            for k in range(1, len(p)):
                a, b = self.number.get(p[:k]), self.number.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(self.number[p])
                    rank.append(self.rank_of[p])
        self.width = len(self.number) + 1
        self.pairs = Pairs(left, right, rank, merged, self.width)
        codes = {ord(c): i for c, i in self.number.items() if len(c) == 1}
        self.code = np.full(0x110000, self.width - 1, np.int32)
        self.code[list(codes)] = list(codes.values())
        self.code[0x20] = self.code[ord(_SPACE)]
        #: Pairs of characters that stand side by side in a piece.
        self.beside = np.unique(np.array([0, *(self.number[a] * self.width + self.number[b] for p, _ in pieces for a, b in zip(p, p[1:], strict=False))], np.int64))


def merges_of(path: str) -> Merges:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Merges([(sp.id_to_piece(i), sp.get_score(i)) for i in ids])


def _weights(m: Merges, symbols: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """1 for a symbol of the vocabulary; the bytes of the character for any other."""
    return np.where(symbols < m.known, 1, n_bytes)


def merge_rows(m: Merges, symbols: np.ndarray, n_bytes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens of each row of a ragged array of symbols."""
    out = np.zeros(len(lengths), np.int64)
    for row, sym, size in merge_rounds(m.pairs, symbols, n_bytes, lengths):
        out += np.bincount(row, _weights(m, sym, size), minlength=len(out)).astype(np.int64)
    return out


def _count_distinct(m: Merges, tokens: pa.Array) -> np.ndarray:
    """Tokens of each distinct pre-token (LargeBinary)."""
    out = np.zeros(len(tokens), np.int64)
    size = np.diff(np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset : tokens.offset + len(tokens) + 1])
    for a, b in _text.row_groups(size, BYTES):
        texts = tokens.slice(a, b - a).cast(pa.large_string())
        n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        symbols = m.code[points.astype(np.int64)]
        cut = np.zeros(len(points) + 1, bool)
        pair = symbols[:-1].astype(np.int64) * m.width + symbols[1:]
        cut[1:-1] = m.beside[np.minimum(np.searchsorted(m.beside, pair), len(m.beside) - 1)] != pair
        ends = np.cumsum(n)
        cut[0] = cut[-1] = cut[ends] = True
        rows = np.flatnonzero(cut)
        counts = np.concatenate(([0], np.cumsum(merge_rows(m, symbols, sizes, np.diff(rows)))))
        at = counts[np.searchsorted(rows, np.concatenate(([0], ends)))]
        out[a:b] = np.diff(at)
    return out


class Counter:
    """Counts texts; remembers the counts of distinct short pre-tokens, up to KEPT of them."""

    def __init__(self, m: Merges):
        self.m, self.known, self.counts = m, pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def of_tokens(self, tokens: pa.Array) -> np.ndarray:
        coded = tokens.dictionary_encode()
        distinct = coded.dictionary
        found = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        counts = np.zeros(len(distinct), np.int64)
        counts[found >= 0] = self.counts[found[found >= 0]]
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = distinct.take(pa.array(new))
            counts[new] = _count_distinct(self.m, fresh)
            small = pc.less_equal(pc.binary_length(fresh), KEPT_BYTES)
            keep = np.flatnonzero(small.to_numpy(zero_copy_only=False))[: max(0, KEPT - len(self.known))]
            if len(keep):
                self.known = pa.concat_arrays([self.known, fresh.take(pa.array(keep))])
                self.counts = np.concatenate([self.counts, counts[new[keep]]])
        return counts[coded.indices.to_numpy()]

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        # a space stands before each text; it and U+2581 are the same sign
        rows = np.flatnonzero(np.diff(offsets))
        at = offsets[:-1][rows]
        data = np.insert(data, at, 0x20)
        offsets = offsets + np.concatenate(([0], np.cumsum(np.diff(offsets) > 0)))
        space = data == 0x20
        sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, np.int64)
        if len(sign):
            keep = np.ones(len(data), bool)
            keep[sign + 1] = keep[sign + 2] = False
            data = data.copy()
            data[sign] = 0x20
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            data = data[keep]
            space = data == 0x20
        out = np.zeros(len(offsets) - 1, np.int64)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return out
        ends = np.append(starts, len(data))
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        counts = self.of_tokens(tokens)
        sums = np.concatenate(([0], np.cumsum(counts)))
        place = np.searchsorted(starts, offsets)
        return sums[place[1:]] - sums[place[:-1]]


#: A worker's counters by model: what it has counted helps its later tasks.
_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs` (doc_id and text are read; other columns are left alone).

    Tokens are those of the model's library for the whole text, without begin, end or
    added tokens. Null and empty texts have no bytes and no tokens. Null doc_ids and
    repeated rows are each counted; an empty table gives no rows. model_path is read
    once, on the driver; its merge table, of fixed size, is broadcast.
    """
    spark = docs.sparkSession
    merges = spark.sparkContext.broadcast(merges_of(model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.setdefault(model_path, Counter(merges.value))
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = _text.utf8(batch.column(1))
            n = counter.of_texts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
