"""Runs of bytes (terms, words) in batches of texts, a bounded piece at a time.

A text longer than a piece is cut behind a byte that no run holds, so that memory follows the piece and not the text; only a single run longer
than a piece makes the piece longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from netloom.llm.words import _BASE, _LOWER, _RANDOM, mix, utf8

#: Texts of a batch whose bytes are copied together.
SLICE = 256
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes lie in one of the inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n of each at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


@dataclass
class Piece:
    """Bytes of some whole texts in a row (``offsets`` as many as these and one), or a part of one text. ``first``: the place of the first text in
    the batch. ``begun``: the text began in an earlier piece; ``ended``: it doesn't go on in the next."""

    first: int
    body: np.ndarray
    offsets: np.ndarray
    begun: bool = False
    ended: bool = True

    def __len__(self) -> int:
        return len(self.offsets) - 1


def pieces(texts, most: int, inside: np.ndarray, rows: int = 1 << 20, lower: bool = False) -> Iterator[Piece]:
    """The texts of a batch in order (null: empty), about ``most`` bytes and at most ``rows`` texts in each piece; ``inside``: the bytes of runs."""
    for at in range(0, len(texts), SLICE):
        yield from _pieces(texts.slice(at, SLICE), at, most, inside, rows, lower)


def _pieces(texts, at: int, most: int, inside: np.ndarray, rows: int, lower: bool) -> Iterator[Piece]:
    body, offsets = utf8(texts)
    case = (lambda b: _LOWER[b]) if lower else (lambda b: b)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1, i + rows)
        if j > i:
            yield Piece(at + i, case(body[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
            i = j
            continue
        a, end = int(offsets[i]), int(offsets[i + 1])
        begin = a
        while a < end:
            z = min(a + most, end)
            if z < end:
                cuts = np.flatnonzero(~inside[body[a:z]])
                while not len(cuts) and z < end:  # one run fills the piece: on to its end
                    far = min(z + most, end)
                    cuts, z = np.flatnonzero(~inside[body[z:far]])[:1] + (z - a), far
                z = a + int(cuts[-1]) + 1 if len(cuts) else end
            yield Piece(at + i, case(body[a:z]), np.array([0, z - a]), a > begin, z == end)
            a = z
        i += 1


class Runs:
    """The runs of a piece: ``start``, ``end`` in its bytes, ``doc`` the text in the piece."""

    def __init__(self, piece: Piece, inside: np.ndarray):
        self.body = piece.body
        within = inside[self.body]
        begins, ends = within.copy(), within.copy()
        if len(within):
            begins[1:] &= ~within[:-1]
            ends[:-1] &= ~within[1:]
            cuts = piece.offsets[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(within))]
            begins[cuts] = within[cuts]
            ends[cuts - 1] = within[cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, piece.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(piece)), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64 bits of each run's bytes, from running sums: no run's bytes are gathered."""
        power, inverse = _power(len(self.body) + 1)
        sums = np.zeros(len(self.body) + 1, np.uint64)
        np.cumsum(_RANDOM[self.body] * power[: len(self.body)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.body[self.start[i] : self.end[i]].tobytes().decode()
