"""Spans of bytes in numpy: hashes and exact comparison, eight bytes at a time.

A span of over ``LONG`` bytes is hashed and compared as Python bytes, so that one long word does not cost a round of
numpy calls for every eight of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

from stalemark.llm.texts import mix

LONG = 64
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


class Spans:
    """Spans ``starts[i]`` to ``ends[i]`` of ``data``, which must not change."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.lengths = data, starts, ends - starts
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self._eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def __len__(self) -> int:
        return len(self.starts)

    def _load(self, which: np.ndarray, skip: int) -> np.ndarray:
        """The eight bytes after the first ``skip`` of each span, as a number; bytes past its end are 0."""
        left = np.minimum(self.lengths[which] - skip, 8)
        return self._eight[self.starts[which] + skip] & _KEEP[left]

    def _bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each span; different seeds give independent ones."""
        out = mix(self.lengths.astype(np.uint64) + np.uint64(mix(np.uint64([seed]))[0]))
        which, skip = np.flatnonzero(self.lengths <= LONG), 0
        while len(which):
            out[which] = mix((out[which] ^ self._load(which, skip)) * np.uint64(0x9E3779B97F4A7C15))
            skip += 8
            which = which[self.lengths[which] > skip]
        for i in np.flatnonzero(self.lengths > LONG):
            digest = hashlib.blake2b(self._bytes(i), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            out[i] = np.frombuffer(digest, "<u8")[0]
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans numbered ``a[i]`` and ``b[i]`` hold the same bytes."""
        same = self.lengths[a] == self.lengths[b]
        which, skip = np.flatnonzero(same & (self.lengths[a] <= LONG)), 0
        while len(which):
            same[which] = self._load(a[which], skip) == self._load(b[which], skip)
            skip += 8
            which = which[same[which] & (self.lengths[a[which]] > skip)]
        for i in np.flatnonzero(same & (self.lengths[a] > LONG)):
            same[i] = self._bytes(a[i]) == self._bytes(b[i])
        return same


def first_equal(spans: Spans, owners: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each span the number of one span of the same owner with the same bytes, the same one for all that are equal.

    An open-addressing table of span numbers, filled by all spans at once: a span takes a free place, or shares the place
    of a span that its bytes prove equal, or goes on to the next place. Equal hashes alone never count as equal.
    """
    mixed = mix(hashes ^ mix(owners.astype(np.uint64)))
    last = (1 << max(4, (2 * len(spans)).bit_length())) - 1
    table = np.full(last + 1, -1, np.int64)
    slot = (mixed & np.uint64(last)).astype(np.int64)
    first, rest = np.empty(len(spans), np.int64), np.arange(len(spans))
    while len(rest):
        free = rest[table[slot[rest]] < 0]
        table[slot[free]] = free
        holder = table[slot[rest]]
        same = holder == rest
        alike = np.flatnonzero(~same & (owners[holder] == owners[rest]) & (mixed[holder] == mixed[rest]))
        same[alike] = spans.equal(holder[alike], rest[alike])
        first[rest[same]] = holder[same]
        rest = rest[~same]
        slot[rest] = (slot[rest] + 1) & last
    return first
