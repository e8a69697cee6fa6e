"""Byte-pair merging over ragged arrays: all sequences of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
NONE = np.int32(1 << 30)


class Pairs:
    """A hash table in arrays: the rank of each pair of symbols that merges, and the symbol it makes."""

    def __init__(self, left: list[int], right: list[int], rank: list[int], merged: list[int], width: int):
        self.width = width
        keys = np.array(left, np.int64) * width + np.array(right, np.int64)
        self.mask = (1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))) - 1
        slots = np.full(self.mask + 1, -1, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = slots[at[todo]] < 0
            slots[at[todo[free]]] = todo[free]
            todo = todo[slots[at[todo]] != todo]
            at[todo] = (at[todo] + 1) & self.mask
        full = slots >= 0
        self.key_at = np.full(self.mask + 1, -1, np.int64)
        self.key_at[full] = keys[slots[full]]
        self.rank_at = np.full(self.mask + 1, NONE, np.int32)
        self.rank_at[full] = np.array(rank, np.int32)[slots[full]]
        self.merged_at = np.zeros(self.mask + 1, np.int32)
        self.merged_at[full] = np.array(merged, np.int32)[slots[full]]
        # by rank: whether no symbol that it makes is in a pair of the same or a lower rank, so that all its places can merge in one round
        lowest = np.full(width, NONE, np.int64)
        for side in (left, right):
            np.minimum.at(lowest, np.array(side, np.int64), np.array(rank, np.int64))
        made = np.full(max(rank, default=0) + 1, NONE, np.int64)
        np.minimum.at(made, np.array(rank, np.int64), lowest[np.array(merged, np.int64)])
        self.alone = made > np.arange(len(made))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(40)).astype(np.int64) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; rank NONE where they don't merge."""
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        todo = np.flatnonzero((self.key_at[at] != keys) & (self.key_at[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            todo = todo[(self.key_at[at[todo]] != keys[todo]) & (self.key_at[at[todo]] >= 0)]
        hit = self.key_at[at] == keys
        return np.where(hit, self.rank_at[at], NONE), self.merged_at[at]


def merge_rounds(pairs: Pairs, sym: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, symbol, size) of what survives in rows whose merging is over, as they get there.

    Each round, every row applies its lowest-rank adjacent pair: the leftmost of
    equals, and with it those to its right that would follow one by one, as what they
    make is in pairs of higher rank only. `size` is summed over what merges.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    live = np.flatnonzero(lengths)
    if not len(live):
        return
    # rank[i]: of the pair i, i + 1; the last of each row has none
    rank, merged = pairs.find(sym[:-1], sym[1:])
    rank, merged = np.append(rank, NONE).astype(np.int32), np.append(merged, 0)
    rank[np.cumsum(lengths[live]) - 1] = NONE
    while len(live):
        first = np.searchsorted(row, live)
        best = np.minimum.reduceat(rank, first)
        done = best == NONE
        if done.any():
            over = np.repeat(done, np.diff(np.append(first, len(row))))
            yield row[over], sym[over], size[over]
            row, sym, size, rank, merged = row[~over], sym[~over], size[~over], rank[~over], merged[~over]
            live, best = live[~done], best[~done]
            if not len(live):
                return
            first = np.searchsorted(row, live)
        lowest = np.flatnonzero(rank == np.repeat(best, np.diff(np.append(first, len(row)))))
        leftmost = np.concatenate(([True], row[lowest[1:]] != row[lowest[:-1]]))
        # of pairs that overlap, every second one goes
        run = np.concatenate(([True], lowest[1:] != lowest[:-1] + 1))
        second = (np.arange(len(lowest)) - np.maximum.accumulate(np.where(run, np.arange(len(lowest)), 0))) & 1
        at = lowest[leftmost | ((second == 0) & pairs.alone[rank[lowest]])]
        sym[at] = merged[at]
        size[at] += size[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        row, sym, size, rank, merged = row[keep], sym[keep], size[keep], rank[keep], merged[keep]
        at = at - np.arange(len(at))
        last = np.append(row[1:] != row[:-1], True)
        rank[last] = NONE
        redo = np.concatenate([at[~last[at]], (at - 1)[(at > 0) & ~last[at - 1]]])
        rank[redo], merged[redo] = pairs.find(sym[redo], sym[redo + 1])
