"""Lookups of many number pairs at once."""

from __future__ import annotations

import numpy as np

ABSENT = 1 << 30
_ODD = 0x9E3779B97F4A7C15


class PairTable:
    """The value of each pair of numbers (the second one below symbols), ABSENT for a pair that has none."""

    def __init__(self, pairs: dict[tuple[int, int], int], symbols: int):
        self.symbols = symbols
        self.bits = max(4, (3 * len(pairs)).bit_length())
        self.code = np.full(1 << self.bits, -1, np.int64)
        self.value = np.full(1 << self.bits, ABSENT, np.int32)
        left = np.array([a * symbols + b for a, b in pairs], np.int64)
        values, slot = np.array(list(pairs.values()), np.int32), self._slot(left)
        while len(left):
            free = np.flatnonzero(self.code[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.code[slot[first]], self.value[slot[first]] = left[first], values[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, values, slot = left[rest], values[rest], (slot[rest] + 1) & (len(self.code) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * np.uint64(_ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * np.int64(self.symbols) + b
        slot = self._slot(code)
        found = self.code[slot]
        out = np.where(found == code, self.value[slot], np.int32(ABSENT))
        open_ = np.flatnonzero((found != code) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.code) - 1)
            found = self.code[slot[open_]]
            hit = found == code[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out
