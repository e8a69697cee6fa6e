"""Packing of tokenized documents into sequences, by the sum-of-squares rule.

Documents are tokenized on the executors and cut into pieces; only a few numbers a
piece go on. Pieces that fill a sequence are one. The others are dealt into groups
of about GROUP pieces, so that no task holds more whatever the corpus, and each
group is packed by itself, large pieces first: a piece goes to the open sequence, of
those that have room, for which the sum over all gaps of the squared number of open
sequences with that gap becomes smallest; a new one is opened only when none has room.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._bpe import Pairs, merge_rounds
from ._spark import slices, stored

#: Pieces that are packed together.
GROUP = 50_000
#: Distinct words that a worker keeps the ids of, and the longest kept.
KEPT, KEPT_BYTES = 1 << 17, 64
#: Words of these letters and a run of these signs are cut and lower-cased here; the library does all others.
_SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]{1,64})(?P<signs>[!-&(-/:;=?@\[-`{-~]{0,16})$"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class Words:
    """Token ids of white-space separated words, as the tokenizer gives them."""

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(config)
        model = json.loads(config)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.pairs = Pairs([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], list(range(len(merges))), [vocab[a + b] for a, b in merges], max(vocab.values()) + 1)
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        self.known, self.ids, self.at = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _merged(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of pre-tokens in lower case."""
        data, offsets = _text.utf8(parts)
        lengths = np.diff(offsets)
        sym = self.inner[data]
        ends = offsets[1:][lengths > 0] - 1
        sym[ends] = self.last[data[ends]]
        done = list(merge_rounds(self.pairs, sym, np.zeros(len(sym), np.int8), lengths))
        row = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int32)
        return ids[np.argsort(row, kind="stable")].astype(np.uint32), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lengths)))))

    def _fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct words."""
        texts = words.cast(pa.large_string())
        cut = pc.extract_regex(texts, _SIMPLE)
        simple = cut.is_valid().to_numpy(zero_copy_only=False)
        s, o = np.flatnonzero(simple), np.flatnonzero(~simple)
        word = pc.utf8_lower(pc.struct_field(cut, "word").take(pa.array(s)))
        signs = pc.struct_field(cut, "signs").take(pa.array(s))
        coded = pa.chunked_array([word.cast(pa.large_string()), signs.cast(pa.large_string())]).combine_chunks().dictionary_encode()
        part_ids, part_at = self._merged(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        other = [x.ids for x in self.library.encode_batch_fast(texts.take(pa.array(o)).to_pylist(), add_special_tokens=False)] if len(o) else []
        flat = np.concatenate([part_ids, *[np.array(x, np.uint32) for x in other]]) if other else part_ids
        n_other = np.array([len(x) for x in other], np.int64)
        base = len(part_ids) + np.concatenate(([0], np.cumsum(n_other)))[:-1]
        # each word is two stretches of `flat`: its letters and its signs, or what the library gave and nothing
        begin, size = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        for k, c in enumerate((code[: len(s)], code[len(s) :])):
            begin[s, k], size[s, k] = part_at[c], part_at[c + 1] - part_at[c]
        begin[o, 0], size[o, 0] = base, n_other
        return _stretches(flat, begin.ravel(), size.ravel()), np.concatenate(([0], np.cumsum(size.sum(axis=1))))

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words (LargeBinary)."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        found = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new, old = np.flatnonzero(found < 0), np.flatnonzero(found >= 0)
        fresh = distinct.take(pa.array(new))
        ids, at = self._fresh(fresh) if len(new) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[new], size[new] = at[:-1] + len(self.ids), np.diff(at)
        begin[old], size[old] = self.at[found[old]], np.diff(self.at)[found[old]]
        flat = np.concatenate([self.ids, ids])
        c = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = _stretches(flat, begin[c], size[c]), np.concatenate(([0], np.cumsum(size[c])))
        small = pc.less_equal(pc.binary_length(fresh), KEPT_BYTES).to_numpy(zero_copy_only=False) if len(new) else np.zeros(0, bool)
        keep = np.flatnonzero(small)[: max(0, KEPT - len(self.known))]
        if len(keep):
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(keep))])
            self.ids = np.concatenate([self.ids, _stretches(ids, at[keep], np.diff(at)[keep])])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.diff(at)[keep])])
        return out

    def of_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts, without a final 0."""
        starts, ends = _text.spans(data, offsets, _text.SOLID)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        packed = np.ascontiguousarray(data[_text.SOLID[data]])
        bounds = np.concatenate(([0], np.cumsum(ends - starts)))
        ids, at = self.of_words(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(packed)]))
        return ids, at[np.searchsorted(starts, offsets)]


def _stretches(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of flat[begin : begin + size] of all stretches."""
    if not size.sum():
        return flat[:0]
    return flat[np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]


#: A worker's words by tokenizer: what it has seen helps its later tasks.
_words: dict[int, Words] = {}


def pieces(docs: DataFrame, config: str, length: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and a final 0, cut at `length`. A null or empty text is a 0 alone; null doc_ids and repeated rows have pieces of their own; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(config)
    name = zlib.crc32(config.encode())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words.get(name) or _words.setdefault(name, Words(shared.value))
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = _text.utf8(batch.column(1))
            ids, at = words.of_texts(data, offsets)
            n = np.diff(at) + 1
            k = -(-n // length)
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            start = piece * length
            size = np.minimum(n[row] - start, length)
            zero = b"\0\0\0\0"
            crc = []
            for r, a, m in zip(row.tolist(), start.tolist(), size.tolist(), strict=True):
                b = at[r] + a
                whole = b + m > at[r + 1]
                c = zlib.crc32(memoryview(ids[b : b + m - whole]).cast("B") if m - whole else b"")
                crc.append(zlib.crc32(zero, c) if whole else c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, all shorter than `room`; sequences are numbered from 0."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(room + 1, np.int64)
    with_gap: list[list[int]] = [[] for _ in range(room + 1)]
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        # change of the sum of squares, for each gap that has room
        change = 2 * (count[: room - s] - count[s:room]) + 2
        change[:1] -= 2 * count[:1] + 1
        change[count[s:room] == 0] = np.iinfo(np.int64).max
        k = int(np.argmin(change)) if len(change) else 0
        if len(change) and count[s + k]:
            where, gap = with_gap[s + k].pop(), s + k
            count[gap] -= 1
        else:
            where, gap = opened, room
            opened += 1
        sequence[i], offset[i] = where, room - gap
        if gap > s:
            count[gap - s] += 1
            with_gap[gap - s].append(where)
    return sequence, offset


def packed(docs: DataFrame, tokenizer_path: str, length: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of `docs` (doc_id and text are read; other columns are left alone).

    A document's ids are the tokenizer's for its text, then 0; only documents of more
    than `length` ids are cut. Null, empty and blank texts are the 0 alone. Null doc_ids
    and repeated rows are packed as any others; an empty table gives no rows.
    Sequences hold `length` ids at most and have no gaps before their end.
    """
    import pandas as pd

    with open(tokenizer_path, encoding="utf-8") as f:
        config = f.read()
    cut = stored(pieces(docs, config, length)).withColumn("n", F.monotonically_increasing_id())
    full = cut.where(F.col("length") == length).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.where(F.col("length") < length)
    groups = max(1, -(-short.count() // GROUP))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        sequence, offset = sum_of_squares(pdf["length"].to_numpy(), length)
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset).astype({"doc_id": "Int64"})

    rest = short.withColumn("group", F.pmod(F.xxhash64("n"), F.lit(groups))).groupBy("group").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return full.unionByName(rest)
