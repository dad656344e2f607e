"""A keyed random order of the numbers 0 .. size - 1 as columns: where a number stands, and which number stands where, each from itself alone.

A number is split into a pair of remainders of ``a`` and ``b``, a * b as little above ``size`` as can be; ``ROUNDS`` rounds add to either a draw of the
other. What falls on one of the few pairs beyond ``size`` walks on by the same rounds, at most once over each of them, so the order is a
bijection. It needs no sort: any beginning of it is computed from its places.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.draws import U32, bits_at

ROUNDS, GOLDEN, MOST_TRIED = 6, 0x9E3779B9, 1 << 20


def sides(size: int) -> tuple[int, int]:
    """The sides of the pairs: of all a from the root of ``size`` to its double (the first ``MOST_TRIED``) that with the least beyond ``size``, of
    several the smallest."""
    root = max(1, math.isqrt(size))
    a = np.arange(root, min(2 * root, root + MOST_TRIED) + 1, dtype=np.int64)
    beyond = -(-size // a) * a - size
    best = int(a[int(np.argmin(beyond))])
    return best, -(-size // best)


@dataclass(frozen=True)
class Permutation:
    """Columns of Arrow batches through numpy: written as expressions, every filter on them would copy the rounds into itself."""

    size: int
    seed: int = 42

    def _rounds(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = sides(self.size)
        pair, size = list(np.divmod(x, b)), (a, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            own = i % 2
            step = np.floor(bits_at((self.seed + i * GOLDEN) % U32, pair[1 - own]) / U32 * size[own]).astype(np.int64)
            pair[own] = (pair[own] - step if back else pair[own] + step) % size[own]
        return pair[0] * b + pair[1]

    def walked(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._rounds(x, back)
        while (out := np.flatnonzero(x >= self.size)).size:
            x[out] = self._rounds(x[out], back)
        return x

    def _column(self, of: Column, back: bool) -> Column:
        @F.arrow_udf("long")
        def moved(numbers: pa.Array) -> pa.Array:
            return pa.array(self.walked(numbers.fill_null(0).to_numpy(zero_copy_only=False).copy(), back), mask=numbers.is_null().to_numpy(zero_copy_only=False))

        return moved(of.cast("long"))

    def place(self, number: Column) -> Column:
        """Where ``number`` stands in the order; null for null."""
        return self._column(number, False)

    def number(self, place: Column) -> Column:
        """The number that stands at ``place``; null for null."""
        return self._column(place, True)
