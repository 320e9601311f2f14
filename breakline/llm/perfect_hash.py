"""A minimal perfect hash in numpy.

Keys are pairs of 64-bit numbers. Level after level, each remaining key takes a bit of a bit array; keys that are alone on
their bit are placed there, the others go on to the next level. A key's index is the number of placed keys before its bit,
so that n keys get the numbers 0 to n-1 and about 3.7 bits a key are held.
"""

from __future__ import annotations

import numpy as np

_GAMMA = 1.5


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    return (mix64(hi ^ mix64(lo + salt)) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    """Built from distinct (hi, lo) pairs."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.n = len(hi)
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        placed = 0
        while len(hi):
            size = max(8, int(_GAMMA * len(hi)))
            bit = _bit(hi, lo, len(self.levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + placed
            self.levels.append(np.packbits(alone))
            self.before.append(rank[7::8].astype(np.int64) if size >= 8 else rank[:0])
            placed += int(alone.sum())
            self._sizes = [*getattr(self, "_sizes", []), size]
            left = ~alone[bit]
            hi, lo = hi[left], lo[left]
            if len(self.levels) > 200:
                raise ValueError("the keys aren't distinct")
        self._starts = [0, *np.cumsum([int(np.bitwise_count(x).sum()) for x in self.levels]).tolist()]

    def to_bytes(self) -> bytes:
        """Number of keys and levels, sizes of the levels in bits, then their bits."""
        head = np.array([self.n, len(self.levels), *(self._sizes if self.levels else [])], "<i8")
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, held: bytes) -> MinimalPerfectHash:
        out = cls.__new__(cls)
        out.n, k = np.frombuffer(held, "<i8", 2).tolist()
        out._sizes = np.frombuffer(held, "<i8", k, 16).tolist()
        out.levels, out.before, out._starts, at = [], [], [0], 16 + 8 * k
        for size in out._sizes:
            packed = np.frombuffer(held, np.uint8, -(-size // 8), at)
            rank = np.cumsum(np.unpackbits(packed)[:size], dtype=np.int64) - 1 + out._starts[-1]
            out.levels.append(packed)
            out.before.append(rank[7::8])
            out._starts.append(int(rank[-1]) + 1)
            at += len(packed)
        return out

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Index of each pair; of one that isn't a key any index, or -1."""
        out = np.full(len(hi), -1, np.int64)
        todo = np.arange(len(hi))
        for k, packed in enumerate(self.levels):
            if not len(todo):
                break
            bit = _bit(hi[todo], lo[todo], k, self._sizes[k])
            byte, at = bit >> 3, bit & 7
            hit = (packed[byte] >> (7 - at).astype(np.uint8)) & 1 == 1
            b, a = byte[hit], at[hit]
            # placed keys in the bytes before, then in this byte before the bit
            earlier = np.where(b > 0, self.before[k][np.maximum(b - 1, 0)] + 1, self._starts[k]) if len(self.before[k]) else np.full(len(b), self._starts[k])
            inside = np.bitwise_count(packed[b] >> (8 - a).astype(np.uint16)).astype(np.int64)
            out[todo[hit]] = earlier + inside
            todo = todo[~hit]
        return out
