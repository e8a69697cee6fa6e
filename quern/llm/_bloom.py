"""A Bloom filter of fixed size over a column of 64-bit hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64


def build(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter as 32-bit words, put together on the executors word by word: bits / 32 numbers come to the driver at most, however many rows there are."""
    c = F.col(column)
    place = F.explode(F.array(c.bitwiseAND(bits - 1), F.shiftrightunsigned(c, 32).bitwiseAND(bits - 1)))
    got = df.select(place.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")).toArrow()
    words = np.zeros(bits // 32, np.uint32)
    words[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return words


def has(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the filter; never false for one that is."""
    mask, out = _U(len(words) * 32 - 1), np.ones(len(hashes), bool)
    u = hashes.view(_U)
    for at in (u & mask, (u >> _U(32)) & mask):
        out &= (words[(at >> _U(5)).astype(np.int64)] >> (at & _U(31)).astype(np.uint32)) & np.uint32(1) > 0
    return out
