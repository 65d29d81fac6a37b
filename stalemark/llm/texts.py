"""Whole texts of an Arrow batch as arrays: bytes, words, hashes of words and of runs of words.

A word is a run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``. Everything works on a slice of documents at once, so
that a document costs no Python loop of its own. A slice holds about ``SLICE_BYTES``, or one document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of the splitmix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Slice:
    """Some documents of a batch: rows ``first`` to ``last`` of it, their bytes, and where each document starts."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.n = len(bounds) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where words start and end in ``data``, and where each document's words start in that list."""
        size = len(self.data)
        inside = ~SPACE[self.data]
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts_of, ends_of = self.bounds[:-1], self.bounds[1:]
        before[starts_of[starts_of < size]] = False
        after[ends_of[ends_of > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The documents of a column of texts, in order; a null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield Slice(first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in a random odd base over random values of its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at - starts, lengths)
    value = constants(seed, 256)[data[place]]
    powers = np.multiply.accumulate(np.full(int(lengths.max()), constants(seed + 77, 1)[0]))
    value *= powers[place - np.repeat(starts, lengths)]
    return mix(np.add.reduceat(value, at) ^ (lengths.astype(np.uint64) << np.uint64(48)))


def run_hashes(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words; the last ``length - 1`` places have none."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(constants(seed + 1000, length)):
        out += words[j : j + n] * c
    return mix(out)


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers ``first[i] .. first[i] + count[i] - 1``, one range after another."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count - first, count)
