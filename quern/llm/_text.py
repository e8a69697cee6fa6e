"""Arrow string columns as flat byte arrays, and words as 64-bit hashes.

Everything here works on one Arrow batch at a time and cuts it into blocks of a
few MB, so the memory that a task needs does not follow the size of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as numpy arrays at once.
BLOCK = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Word characters of the contracts: all but the ASCII signs, spaces and controls.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: Words between white space.
SOLID = np.ones(256, dtype=bool)
SOLID[0x20] = False
SOLID[0x09:0x0E] = False

_byte_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
#: A random odd number for each byte; upper case ASCII letters have those of lower case.
_LOWER_VALUES = _byte_values[_LOWER]

_powers = {"n": 0, "p": np.ones(1, _U), "q": np.ones(1, _U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and _BASE ** -i modulo 2 ** 64, for i up to n."""
    if n >= _powers["n"]:
        size = max(n + 1, BLOCK + 1)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, _U)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
        _powers["n"] = size - 1
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of each 64-bit number over all its bits."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(start, end) of byte ranges of about `size` that never cut a run of bytes for which `inside` holds."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        step = 1 << 12
        while end < n:
            # rows end where `offsets` says so; else go on to the next byte that is outside
            part = inside[data[end - 1 : end + step]]
            gap = np.flatnonzero(~part)
            row = np.searchsorted(offsets, end)
            reach = end + step if not len(gap) else end + max(0, int(gap[0]))
            if row < len(offsets) and offsets[row] <= reach:
                end = int(offsets[row])
                break
            if len(gap):
                end = min(n, reach)
                break
            end = min(n, end + step)
            step *= 2
        yield at, end
        at = end


def spans(data: np.ndarray, cuts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` bytes; no run crosses a position in `cuts`."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = inside[data]
    edge = np.empty(len(here), bool)
    edge[0] = True
    np.not_equal(here[1:], here[:-1], out=edge[1:])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    edge[cuts] = True
    edges = np.flatnonzero(edge)
    ends = np.append(edges[1:], len(data))
    keep = here[edges]
    return edges[keep], ends[keep]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, word_offsets): a 64-bit hash of each word, ASCII letters in lower case, and where each row's words begin."""
    found, counts = [], np.zeros(len(offsets), np.int64)
    for a, b in blocks(data, offsets, inside):
        part = data[a:b]
        lo, hi = np.searchsorted(offsets, a, "right"), np.searchsorted(offsets, b, "left")
        starts, ends = spans(part, offsets[lo:hi] - a, inside)
        if not len(starts):
            continue
        p, q = powers(len(part))
        sums = np.empty(len(part) + 1, _U)
        sums[0] = 0
        np.cumsum(_LOWER_VALUES[part] * p[: len(part)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * q[starts]
        h += (ends - starts).astype(_U)
        found.append(mix(h))
        # how many words start in each row that the block touches
        at = np.searchsorted(starts, np.concatenate(([0], offsets[lo:hi] - a, [b - a])))
        counts[lo : hi + 1] += np.diff(at)
    return (np.concatenate(found) if found else np.zeros(0, _U)), np.cumsum(counts)


def word_hash(text: str, inside: np.ndarray) -> np.ndarray:
    """The words of one text, as `words` hashes them."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return words(raw, np.array([0, len(raw)]), inside)[0]


def row_groups(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to `limit` at most, or one row."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    at, n = 0, len(sizes)
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)
