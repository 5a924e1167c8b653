"""A wavelet matrix over small classes: how often a class occurs before any place, for many places at once."""

from __future__ import annotations

import numpy as np

# Counts are kept for every block of this many bits; the rest of a block is counted on request.
_BLOCK = 512
_WORDS = _BLOCK // 64


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        blocks = len(bits) // _BLOCK + 1
        padded = np.zeros(blocks * _BLOCK // 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        ones = np.bitwise_count(self.words).reshape(blocks, _WORDS).sum(axis=1, dtype=np.int64)
        self.before = np.zeros(blocks + 1, np.int64)
        np.cumsum(ones, out=self.before[1:])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        block = places // _BLOCK
        out = self.before[block]
        inside = places % _BLOCK
        for i in range(_WORDS):
            kept = np.clip(inside - 64 * i, 0, 64).astype(np.uint64)
            # A shift by 64 is not defined, so all 64 bits are taken as a case of its own.
            mask = np.where(kept == 64, ~np.uint64(0), (np.uint64(1) << (kept & np.uint64(63))) - np.uint64(1))
            out = out + np.bitwise_count(self.words[block * _WORDS + i] & mask)
        return out


class WaveletMatrix:
    """Ranks of classes 0 to 2**levels - 1 over a sequence of them."""

    def __init__(self, classes: np.ndarray, levels: int) -> None:
        self.length, self.levels = len(classes), []
        for level in range(levels - 1, -1, -1):
            ones = (classes >> level & 1).astype(bool)
            self.levels.append((Bits(ones), int(len(ones) - ones.sum())))
            # All zeros of a level come before its ones, each in the order they had.
            classes = np.concatenate([classes[~ones], classes[ones]])

    def rank(self, symbol: int, places: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before each place."""
        first, last = np.zeros_like(places), places
        for i, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(first), bits.rank(last)
            if symbol >> (len(self.levels) - 1 - i) & 1:
                first, last = zeros + ones[0], zeros + ones[1]
            else:
                first, last = first - ones[0], last - ones[1]
        return last - first

    def count(self, symbols: tuple[int, ...], places: np.ndarray) -> np.ndarray:
        """How often any of `symbols` occurs before each place."""
        return sum((self.rank(s, places) for s in symbols), start=np.zeros(len(places), np.int64))

    def locate(self, symbols: tuple[int, ...], wanted: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least place up to `last` with at least `wanted` of `symbols` before it, by bisection from `first`."""
        low, high = first.copy(), last.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            enough = self.count(symbols, middle) >= wanted[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
            open_ = open_[low[open_] < high[open_]]
        return low
