"""Positions on disk along a Z-order curve: a query of a place reads the intervals of the curve that cover it, and what they hold is judged as ever.

Each axis has 2 ** ``BITS`` steps over the square that holds all positions; the bits of both steps alternate in the key. A rectangle is covered by
whole quadrants of the curve, the largest first, and where these would be too many by larger ones that stick out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators import spatial
from netloom.operators.spatial import MOST_REACH, Grid, build_grid
from netloom.plans.lineage import cut, folder
from netloom.sources.clustered import Clustered, write_clustered

BITS, MOST_PARTS = 16, 128
KEY = "_z"


def _spread(v: Column) -> Column:
    """A number's bits with a gap after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = F.shiftleft(v, shift).bitwiseOR(v).bitwiseAND(F.lit(mask))
    return v


def covering(x0: int, y0: int, x1: int, y1: int, bits: int = BITS, most: int = MOST_PARTS) -> list[tuple[int, int]]:
    """Intervals of the curve that hold all of the inclusive rectangle of steps: about ``most`` quadrants, those at its rim split the furthest."""
    done: list[tuple[int, int]] = []
    rim = [(0, 0, 0)]  # z of the quadrant's first step, its lowest x and y
    for level in range(bits, -1, -1):
        size, area, deeper = 1 << level, 1 << 2 * level, []
        for z, x, y in rim:
            if x > x1 or y > y1 or x + size <= x0 or y + size <= y0:
                continue
            if x >= x0 and y >= y0 and x + size <= x1 + 1 and y + size <= y1 + 1:
                done.append((z, z + area - 1))
            else:
                deeper.append((z, x, y))
        if not deeper:
            break
        if len(done) + 4 * len(deeper) > most or level == 0:
            done += [(z, z + area - 1) for z, _, _ in deeper]
            break
        half, quarter = size >> 1, area >> 2
        rim = [(z + (2 * j + i) * quarter, x + i * half, y + j * half) for z, x, y in deeper for j in (0, 1) for i in (0, 1)]
    return sorted(done)


@dataclass(frozen=True)
class SpatialIndex:
    grid: Grid
    table: Clustered

    def within(self, x0: float, y0: float, x1: float, y1: float, unknown: bool = False) -> DataFrame:
        """idx, x, y: all positions in the rectangle and some around it; with ``unknown`` those too that are not a number."""
        g, last = self.grid, (1 << BITS) - 1
        step = g.side * g.axis / (1 << BITS)
        a, b = (min(max(int((v - g.x) // step) + d, 0), last) for v, d in ((x0, -1), (x1, 1)))  # one step more: rounding differs
        c, d = (min(max(int((v - g.y) // step) + d, 0), last) for v, d in ((y0, -1), (y1, 1)))
        return self.table.between(covering(a, c, b, d) + [(0, 0)] * unknown).drop(KEY)

    def _cells(self, a: int, b: int, c: int, d: int) -> DataFrame:
        """All positions of the grid's cells in columns a to b and rows c to d, and some around them."""
        g = self.grid
        a, b, c, d = (min(max(v, 0), g.axis - 1) for v in (a, b, c, d))
        return self.within(g.x + a * g.side, g.y + c * g.side, g.x + (b + 1) * g.side, g.y + (d + 1) * g.side, a == 0 and c == 0)

    def visible_count(self, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
        g = self.grid
        near = self._cells(g.bounds(x0, g.x), g.bounds(x1, g.x), g.bounds(y0, g.y), g.bounds(y1, g.y))
        return spatial.visible_count(g, near, x0, y0, x1, y1)

    def nodes_in_rect(self, x0: float, y0: float, x1: float, y1: float, cap: int | None = None) -> DataFrame:
        g = self.grid
        return spatial.nodes_in_rect(g, self.within(x0, y0, x1, y1, g.bounds(x0, g.x) == 0 and g.bounds(y0, g.y) == 0), x0, y0, x1, y1, cap)

    def pick(self, x: float, y: float, radius: float) -> DataFrame:
        g = self.grid
        reach = min(MOST_REACH, int(-(-radius // g.side)))
        cx, cy = g.bounds(x, g.x), g.bounds(y, g.y)
        return spatial.pick(g, self._cells(cx - reach, cx + reach, cy - reach, cy + reach), x, y, radius)


def write_spatial(positions: DataFrame, path: str, **bands) -> SpatialIndex:
    """Writes ``positions`` (idx, x, y), which are written already, along the curve; positions that are not a number lie at its begin."""
    grid = build_grid(positions)
    step = grid.side * grid.axis / (1 << BITS)

    def at(c: str, low: float) -> Column:
        v = F.floor((F.col(c).cast("double") - low) / step)
        return F.least(F.greatest(F.when(F.isnan(c) | F.col(c).isNull(), 0).otherwise(v), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")

    placed = positions.withColumns({"_cx": at("x", grid.x), "_cy": at("y", grid.y)})
    placed = placed.withColumn(KEY, _spread(F.col("_cx")) + 2 * _spread(F.col("_cy"))).drop("_cx", "_cy")
    return SpatialIndex(grid, write_clustered(placed, path, KEY, (1 << 2 * BITS) - 1, positions.count(), ("idx",), **bands))


def indexed(positions: DataFrame, **bands) -> SpatialIndex:
    """The index of positions in a new folder of the shared one."""
    positions = cut(positions)
    return write_spatial(positions, folder(positions.sparkSession, "positions"), **bands)
