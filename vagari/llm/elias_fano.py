"""Elias-Fano code of a rising sequence with select: about 2 + log2(u / n) bits an entry."""

from __future__ import annotations

import numpy as np

PACK = 8192  # values whose low bits are packed at a time; a multiple of 8
BLOCK = 512  # bits of the upper part between two counts of the select directory


class EliasFano:
    """n values, none below the one before. Low bits are packed; the rest of value i is a one at bit (value >> low) + i."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low, self.lows, self.highs = n, low, lows, highs
        counts = np.unpackbits(highs).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64) if len(highs) else np.zeros(0, np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        lows = [np.packbits(((values[i : i + PACK, None] >> np.arange(low)[::-1]) & 1).astype(np.uint8).ravel()) for i in range(0, n, PACK)] if low else []
        place = (values >> low) + np.arange(n)
        highs = np.zeros(-(-(int(place[-1]) + 1) // BLOCK) * BLOCK if n else 0, np.uint8)
        highs[place] = 1
        return cls(n, low, np.concatenate(lows) if lows else np.zeros(0, np.uint8), np.packbits(highs))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low, len(self.lows), len(self.highs)], "<i8").tobytes()
        return head + self.lows.tobytes() + self.highs.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "EliasFano":
        n, low, a, b = np.frombuffer(data, "<i8", 4).tolist()
        lows = np.frombuffer(data, np.uint8, a, 32)
        return cls(n, low, lows, np.frombuffer(data, np.uint8, b, 32 + a))

    def __len__(self) -> int:
        """Bytes of to_bytes()."""
        return 32 + len(self.lows) + len(self.highs)

    def select(self, lo: int, hi: int) -> np.ndarray:
        """Values lo..hi-1. Reads only the blocks that hold their ones."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.before, lo, "right")) - 1
        last = int(np.searchsorted(self.before, hi - 1, "right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.highs[first * BLOCK // 8 : (last + 1) * BLOCK // 8])) + first * BLOCK
        at = lo - int(self.before[first])
        high = ones[at : at + hi - lo] - np.arange(lo, hi)
        if not self.low:
            return high
        a, b = lo * self.low, hi * self.low
        bits = np.unpackbits(self.lows[a // 8 : -(-b // 8)])[a % 8 : a % 8 + b - a].reshape(-1, self.low)
        return (high << self.low) + bits.astype(np.int64) @ (1 << np.arange(self.low)[::-1])
