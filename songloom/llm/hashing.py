"""64-bit hashes of many stretches of a byte buffer at once, in numpy.

A stretch's hash is a polynomial in one odd base over a random number per byte value,
modulo 2^64. Running sums of it give the hash of any stretch by one subtraction, so equal
stretches have equal hashes wherever they lie. ``mix`` then spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C17  # odd; base - 1 has a single factor of two
_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ U(seed)) * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


class Stretches:
    """Hashes of stretches of buffers of up to ``longest`` bytes."""

    def __init__(self, longest: int, seed: int = 1) -> None:
        self.table = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
        self._grow(longest)

    def _grow(self, longest: int) -> None:
        self.powers = np.full(longest + 1, _BASE, np.uint64)
        self.powers[0] = 1
        np.cumprod(self.powers, out=self.powers)
        self.inverse = np.full(longest + 1, _INVERSE, np.uint64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums; ``data`` is a buffer of bytes."""
        if len(data) >= len(self.powers):
            self._grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverse[starts], seed)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings; nulls are empty."""
    array = texts.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], "int64")[array.offset : array.offset + len(array) + 1]
    held = array.buffers()[2]
    data = np.frombuffer(held, "uint8") if held is not None and held.size else np.zeros(0, "uint8")
    return data, offsets


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of up to ``most`` bytes together; a longer row is alone."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last
