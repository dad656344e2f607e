"""Counter-based random draws as columns: draw k of a seed is a function of both, so rows need no order to get theirs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the generator: the step between draws, and the odd constants mixed in.
STEP, MIX = 0x6D2B79F5, (1, 61)
U32 = 1 << 32


def _low(x: Column, bits: int) -> Column:
    """The lowest bits: a mask, whose generated code is far shorter than that of a remainder."""
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _imul(x: Column, y: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, without leaving 64 bits."""
    return _low(F.shiftleft(_low(F.shiftright(x, 16) * y, 16), 16) + _low(x, 16) * y, 32)


def with_draw(df: DataFrame, seed: int | Column, counter: Column, name: str) -> DataFrame:
    """``df`` with ``name``: draw ``counter`` (from 0), uniform in [0, 1)."""
    a, t, s = f"_{name}_a", f"_{name}_t", f"_{name}_s"
    seed = F.lit(seed).cast("long") if isinstance(seed, int) else seed
    df = df.withColumn(a, _low(seed + (counter.cast("long") + 1) * STEP, 32))
    df = df.withColumn(t, _imul(F.col(a).bitwiseXOR(F.shiftright(a, 15)), F.col(a).bitwiseOR(F.lit(MIX[0]))))
    df = df.withColumn(s, _low(F.col(t) + _imul(F.col(t).bitwiseXOR(F.shiftright(t, 7)), F.col(t).bitwiseOR(F.lit(MIX[1]))), 32).bitwiseXOR(F.col(t)))
    return df.withColumn(name, F.col(s).bitwiseXOR(F.shiftright(s, 14)) / float(U32)).drop(a, t, s)


def bits_at(seed: int, counters: np.ndarray) -> np.ndarray:
    """The 32 bits of draws in numpy; ``with_draw`` gives them divided by 2 ** 32."""
    low = np.uint64(U32 - 1)
    a = ((counters.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP) + np.uint64(seed % U32)) & low
    t = (a ^ a >> np.uint64(15)) * (a | np.uint64(MIX[0])) & low
    t = (t + ((t ^ t >> np.uint64(7)) * (t | np.uint64(MIX[1])) & low) & low) ^ t
    return t ^ t >> np.uint64(14)
