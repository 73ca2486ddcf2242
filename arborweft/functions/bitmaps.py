"""Compressed bitmaps over 32-bit codes: per 2^16 codes either a sorted array or a bit field, whichever is smaller."""

from __future__ import annotations

import numpy as np

_DENSE_FROM = 4096


class Bitmap:
    """Immutable set of non-negative integers below 2^32."""

    __slots__ = ("chunks",)

    def __init__(self, chunks: dict[int, np.ndarray]):
        self.chunks = chunks

    @classmethod
    def of(cls, codes: np.ndarray) -> "Bitmap":
        codes = np.unique(np.asarray(codes, dtype=np.uint32))
        high = (codes >> 16).astype(np.int64)
        cuts = np.flatnonzero(np.diff(high)) + 1
        chunks = {}
        for part in np.split(codes, cuts):
            if len(part):
                chunks[int(part[0] >> 16)] = _pack((part & 0xFFFF).astype(np.uint16))
        return cls(chunks)

    def andnot(self, other: "Bitmap") -> "Bitmap":
        out = {}
        for k, mine in self.chunks.items():
            theirs = other.chunks.get(k)
            left = mine if theirs is None else _minus(mine, theirs)
            if len(left):
                out[k] = left
        return Bitmap(out)

    def codes(self) -> np.ndarray:
        parts = [(np.uint32(k) << np.uint32(16)) | _low(v).astype(np.uint32) for k, v in sorted(self.chunks.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def __len__(self) -> int:
        return sum(len(v) if v.dtype == np.uint16 else int(np.bitwise_count(v).sum()) for v in self.chunks.values())

    def nbytes(self) -> int:
        return sum(v.nbytes for v in self.chunks.values())


def _pack(low: np.ndarray) -> np.ndarray:
    if len(low) <= _DENSE_FROM:
        return low
    bits = np.zeros(1 << 16, np.bool_)
    bits[low] = True
    return np.packbits(bits, bitorder="little")


def _low(v: np.ndarray) -> np.ndarray:
    return v if v.dtype == np.uint16 else np.flatnonzero(np.unpackbits(v, bitorder="little"))


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == np.uint16 and b.dtype == np.uint16:
        return np.setdiff1d(a, b, assume_unique=True)
    if a.dtype == np.uint16:
        return a[(b[a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 0]
    if b.dtype == np.uint16:
        a = a.copy()
        np.bitwise_and.at(a, b >> 3, ~(np.uint8(1) << (b & 7).astype(np.uint8)))
    else:
        a = a & ~b
    low = np.flatnonzero(np.unpackbits(a, bitorder="little")).astype(np.uint16)
    return _pack(low)
