"""Vectorised word hashes of Arrow text columns (helpers that run inside tasks).

Words are runs of bytes other than ASCII white space.  A word's 64-bit hash is a
polynomial in its bytes, taken from prefix sums modulo 2**64 and then mixed, so
that hashing costs a few array operations per byte and no Python per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # any odd number works
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def trimmed(result=None):
    """The result, after what this worker has freed went back to the system: glibc and Arrow would keep it for the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return result


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 1 << 16), base, _U)
            steps[0] = 1
            _powers[base] = have = np.cumprod(steps, dtype=_U)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class RangeHash:
    """Hashes of any ranges of a sequence of numbers, from prefix sums."""

    def __init__(self, values: np.ndarray):
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(values) + 1, _U)
            np.cumsum(values.astype(_U) * _power(_BASE, len(values)), out=self.sums[1:])
        self.down = _power(_INVERSE, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(_U))


@dataclass
class Words:
    """Words of consecutive texts: byte places in ``data``, hash, and text number."""

    data: np.ndarray
    first_text: int
    text_start: np.ndarray  # byte offsets of the texts, one more than texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text_of: np.ndarray
    first_word: np.ndarray  # word offsets of the texts, one more than texts


def words_of(texts: pa.Array | pa.ChunkedArray, *, lower: bool = False, slice_bytes: int = 500_000) -> Iterator[Words]:
    """Words of the texts (null: empty), some texts at a time to bound memory."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1)
        bounds = offsets[at : to + 1] - offsets[at]
        yield _words(data[offsets[at] : offsets[to]], at, bounds, lower)
        at = to


def _words(data: np.ndarray, first_text: int, bounds: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = bounds[:-1][bounds[1:] > bounds[:-1]]
    before[filled] = False
    after[filled[1:] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    first_word = np.searchsorted(start, bounds)
    hashes = RangeHash(data.astype(_U) + _U(1)).of(start, end)
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(first_word))
    return Words(data, first_text, bounds, start, end, hashes, text_of, first_word)
