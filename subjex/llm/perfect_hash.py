"""Minimal perfect hash over 64-bit keys, as plain numpy arrays.

Construction by levels: each remaining key takes a place in a bit array of
``GAMMA`` places per key; places taken by exactly one key are set, the other
keys go on to the next level. A key's index is the number of set bits before
its place. Space is a few bits per key, a probe touches one place per level.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
LEVELS = 40


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct keys to its own index below n; any other key to -1 or to some index.

    ``rest`` holds the keys that never were alone, which get no index: equal keys, in practice none.
    """

    def __init__(self, sizes: list[int], bits: bytes, rest: np.ndarray | None = None):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        raw, at, before = np.frombuffer(bits, np.uint8), 0, 0
        self._levels = []
        for size in sizes:
            flags = np.unpackbits(raw[at:at + (size + 7) // 8], count=size).astype(bool)
            rank = np.cumsum(flags, dtype=np.int32) + np.int32(before - 1)
            self._levels.append((size, flags, rank))
            at += (size + 7) // 8
            before = int(rank[-1]) + 1 if size else before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits = np.asarray(keys, np.uint64), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            place = _place(left, level, size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone).tobytes())
            left = left[~alone[place]]
        return cls(sizes, b"".join(bits), left)

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, flags, rank) in enumerate(self._levels):
            if not len(todo):
                break
            place = _place(keys[todo], level, size)
            hit = flags[place]
            out[todo[hit]] = rank[place[hit]]
            todo = todo[~hit]
        return out
