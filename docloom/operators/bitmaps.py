"""Compressed sets of non-negative integers with fast AND-NOT and AND.

A set is split by the high 16 bits. Each part keeps its low 16 bits either as a
sorted ``uint16`` array (sparse) or as a 65,536-bit map (dense), whichever is
smaller, so memory follows the number of members and never the key range.
"""

from __future__ import annotations

import numpy as np

_DENSE_FROM = 4096
_WORDS = 65536 // 8


class OrdinalBitmap:
    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray] | None = None):
        self.parts = parts or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> "OrdinalBitmap":
        """Build from any integer array; repeats and order do not matter."""
        values = np.unique(np.asarray(ordinals, dtype=np.int64))
        parts = {}
        if len(values):
            high = values >> 16
            edges = np.flatnonzero(np.diff(high)) + 1
            for piece in np.split(values, edges):
                parts[int(piece[0] >> 16)] = _pack((piece & 0xFFFF).astype(np.uint16))
        return cls(parts)

    def minus(self, other: "OrdinalBitmap") -> "OrdinalBitmap":
        return self._merge(other, keep_missing=True)

    def intersect(self, other: "OrdinalBitmap") -> "OrdinalBitmap":
        return self._merge(other, keep_missing=False)

    def _merge(self, other: "OrdinalBitmap", keep_missing: bool) -> "OrdinalBitmap":
        out = {}
        for high, mine in self.parts.items():
            theirs = other.parts.get(high)
            if theirs is None:
                if keep_missing:
                    out[high] = mine
                continue
            if mine.dtype == np.uint8 and theirs.dtype == np.uint8:
                low = _low(mine & ~theirs if keep_missing else mine & theirs)
            elif mine.dtype == np.uint16:
                inside = _contains(theirs, mine)
                low = mine[~inside] if keep_missing else mine[inside]
            elif keep_missing:
                low = np.setdiff1d(_low(mine), theirs, assume_unique=True)
            else:
                low = theirs[_contains(mine, theirs)]
            if len(low):
                out[high] = _pack(low)
        return OrdinalBitmap(out)

    def to_array(self) -> np.ndarray:
        pieces = [(high << 16) + _low(part).astype(np.int64) for high, part in sorted(self.parts.items())]
        return np.concatenate(pieces) if pieces else np.empty(0, np.int64)

    def __len__(self) -> int:
        return sum(len(p) if p.dtype == np.uint16 else int(np.unpackbits(p).sum()) for p in self.parts.values())


def _pack(low: np.ndarray) -> np.ndarray:
    if len(low) <= _DENSE_FROM:
        return low
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return np.packbits(bits)


def _low(part: np.ndarray) -> np.ndarray:
    if part.dtype == np.uint16:
        return part
    return np.flatnonzero(np.unpackbits(part)).astype(np.uint16)


def _contains(part: np.ndarray, low: np.ndarray) -> np.ndarray:
    if part.dtype == np.uint8:
        return (part[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1 == 1
    at = np.minimum(np.searchsorted(part, low), max(len(part) - 1, 0))
    return part[at] == low if len(part) else np.zeros(len(low), bool)
