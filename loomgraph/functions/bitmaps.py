"""Compressed bitmaps over int ordinals: chunks of 2**16, each a sorted array or packed bits."""

from __future__ import annotations

import numpy as np

CHUNK_BITS = 16
#: A chunk with more members is kept as packed bits (8 KB), one with fewer as uint16.
ARRAY_MAX = 4096
_SIZE = 1 << CHUNK_BITS


class Bitmap:
    __slots__ = ("chunks",)

    def __init__(self, chunks: dict[int, np.ndarray]):
        self.chunks = chunks

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        """Of sorted distinct ordinals."""
        high = ordinals >> CHUNK_BITS
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(ordinals, cuts) if len(ordinals) else []
        return cls({int(p[0] >> CHUNK_BITS): cls._pack((p & (_SIZE - 1)).astype(np.uint16)) for p in parts})

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= ARRAY_MAX:
            return low
        bits = np.zeros(_SIZE, np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _bits(chunk: np.ndarray) -> np.ndarray:
        if chunk.dtype == np.uint8:
            return chunk
        bits = np.zeros(_SIZE, np.uint8)
        bits[chunk] = 1
        return np.packbits(bits)

    @staticmethod
    def _low(chunk: np.ndarray) -> np.ndarray:
        return chunk if chunk.dtype == np.uint16 else np.flatnonzero(np.unpackbits(chunk)).astype(np.uint16)

    def _combined(self, other: Bitmap, keep: bool) -> Bitmap:
        out = {}
        for key, mine in self.chunks.items():
            theirs = other.chunks.get(key)
            if theirs is None:
                low = np.empty(0, np.uint16) if keep else self._low(mine)
            elif mine.dtype == np.uint16 and theirs.dtype == np.uint16:
                low = mine[np.isin(mine, theirs, assume_unique=True, invert=not keep)]
            else:
                other_bits = self._bits(theirs)
                low = self._low(self._bits(mine) & (other_bits if keep else ~other_bits))
            if len(low):
                out[key] = self._pack(low)
        return Bitmap(out)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._combined(other, True)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._combined(other, False)

    def ordinals(self) -> np.ndarray:
        parts = [(np.int64(k) << CHUNK_BITS) + self._low(c).astype(np.int64) for k, c in sorted(self.chunks.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)
