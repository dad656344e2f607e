"""Words and their hashes over whole Arrow batches, in numpy.

A word is a longest run of ``[^\\x20\\x09-\\x0D]``. All functions work on the UTF-8 bytes of a batch of texts at once; nulls count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of each text in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return body, offsets - first


def powers(n: int) -> np.ndarray:
    p = np.full(max(n, 1), _BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Words:
    """The words of a batch: ``start`` and ``end`` byte offsets, ``first[i]:first[i + 1]`` the words of text i, ``doc`` the text of each word."""

    def __init__(self, texts, lower: bool = False):
        self.body, self.offsets = utf8(texts)
        if lower:
            self.body = _LOWER[self.body]
        inside = ~_SPACE[self.body]
        begins, ends = inside.copy(), inside.copy()
        if len(inside):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cuts = self.offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(inside))]
            begins[cuts] = inside[cuts]
            ends[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))
        self.left = self.first[1:][self.doc] - np.arange(len(self.doc))  # words from each on to the end of its text

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        where = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        chars = self.body[~_SPACE[self.body]]
        product = _RANDOM[chars] * powers(int(size.max()))[where]
        return mix(np.add.reduceat(product, np.cumsum(size) - size) + size.astype(np.uint64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of n elements from each on; the last n - 1 are padded with zeros and mean nothing."""
    padded = np.concatenate([h, np.zeros(n - 1, np.uint64)])
    out, factor = np.zeros(len(h), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(n):
            out += padded[i : i + len(h)] * factor
            factor = factor * _STEP
    return mix(out)


def extended(h: np.ndarray, step: int) -> np.ndarray:
    """From hashes of windows, those of windows longer by ``step``: the window here and the one ``step`` further on."""
    further = np.concatenate([h[step:], np.zeros(min(step, len(h)), np.uint64)])
    return mix(h * _STEP + (further ^ _BASE))
