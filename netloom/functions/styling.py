"""Values to colours and sizes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ramp, the category colours, the neutral colour and the sizes are what results are compared by.
SEQUENTIAL = ["#184f95", "#256abf", "#3987e5", "#6da7ec", "#9ec5f4", "#cde2fb"]
CATEGORICAL = ["#3987e5", "#d95926", "#199e70"]
NEUTRAL = "#6b6b78"
NEUTRAL_SIZE, HIDDEN_SIZE, SIZE_LOW, SIZE_HIGH = 52, 0, 0.5, 3.0


def rgb(hexadecimal: str) -> int:
    """Red in the lowest byte, then green, then blue."""
    r, g, b = (int(hexadecimal[i : i + 2], 16) for i in (1, 3, 5))
    return r | g << 8 | b << 16


def _finite(t: Column) -> Column:
    return t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf"))


def unit(value: Column, low: float | None, high: float | None) -> Column:
    """Where a value lies between low and high, 0 to 1; 0.5 if these are the same; -1 for null."""
    v = value.cast("double")
    if low is None or high is None or not high > low:
        return F.when(v.isNull(), -1.0).otherwise(0.5)
    return F.coalesce((v - low) / (high - low), F.lit(-1.0))


def sequential(t: Column) -> Column:
    """The colour of a position on the ramp, in steps of equal width."""
    step = F.least(F.lit(len(SEQUENTIAL) - 1), F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * len(SEQUENTIAL)))
    return F.when(_finite(t) & (t >= 0), F.element_at(F.array(*(F.lit(rgb(c)) for c in SEQUENTIAL)), (step + 1).cast("int"))).otherwise(rgb(NEUTRAL))


def slot(value: Column, top: list[str]) -> Column:
    """The place of a value among the top ones, from 1; 0 for others and null."""
    top = top[: len(CATEGORICAL)]
    return F.coalesce(F.array_position(F.array(*(F.lit(x) for x in top)), value.cast("string")), F.lit(0)) if top else F.lit(0)


def category(place: Column) -> Column:
    out = F.lit(rgb(NEUTRAL))
    for i, c in enumerate(CATEGORICAL, 1):
        out = F.when(place == i, rgb(c)).otherwise(out)
    return out


def size_code(t: Column) -> Column:
    """1 to 255 for 0 to 1, rounded half up; the neutral size for what has no value."""
    clamped = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.when(_finite(t) & (t >= 0), (F.floor(clamped * 254 + 0.5) + 1).cast("long")).otherwise(NEUTRAL_SIZE)


def size_factor(code: Column) -> Column:
    return SIZE_LOW + (code - 1) / 254.0 * (SIZE_HIGH - SIZE_LOW)


def packed(colour: Column, size: Column) -> Column:
    """One 32-bit number: the size in the highest byte; size 0 is hidden."""
    return colour.cast("long").bitwiseOR(size.cast("long") * (1 << 24))


def masked(style: Column, visible: Column) -> Column:
    """The style with its size taken away where it isn't visible; the colour stays."""
    return F.when(visible, style).otherwise(style.bitwiseAND(F.lit(0xFFFFFF)))
