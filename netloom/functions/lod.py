"""How much of a graph to draw: limits from the coverage of the screen, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a screen draws at most, and at least.
NODE_BUDGET, EDGE_BUDGET, MOST_EDGES, LEAST_DRAWN = 1_000_000, 300_000, 300_000, 4096


def _usable(x: Column, otherwise: Column | float) -> Column:
    x = x.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (x != float("inf")) & (x != float("-inf"))
    return F.when(ok, x).otherwise(otherwise)


def limits(nodes: Column, edges: Column, fraction: Column, coverage: Column) -> Column:
    """A struct (nodes, edges) of how many to draw when ``fraction`` of the nodes is in view over ``coverage`` of the screen."""
    n, m = nodes.cast("double"), edges.cast("double")
    f = F.least(F.greatest(_usable(fraction, 1.0), 1.0 / F.greatest(n, F.lit(1.0))), F.lit(1.0))
    c = _usable(coverage, 1.0)
    scale = F.when(c > 0, c).otherwise(1.0) / f
    draw_n = F.least(F.greatest(F.ceil(NODE_BUDGET * scale).cast("double"), F.least(F.lit(float(LEAST_DRAWN)), n)), n)
    draw_m = F.greatest(F.least(F.lit(float(LEAST_DRAWN)), m), F.least(F.least(m, F.lit(float(MOST_EDGES))), F.ceil(EDGE_BUDGET * scale).cast("double")))
    none = n <= 0
    return F.struct(F.when(none, 0).otherwise(draw_n).cast("long").alias("nodes"), F.when(none, 0).otherwise(draw_m).cast("long").alias("edges"))


def coverage(zoom: Column, fit_zoom: Column, span_x: Column, span_y: Column, width: Column, height: Column) -> Column:
    """The area of the graph on the screen, cut at its edges, against that when it just fits; 1 where this can't be told."""
    area = lambda z: F.least(width.cast("double"), span_x * z) * F.least(height.cast("double"), span_y * z)
    fit = area(fit_zoom.cast("double"))
    return F.when(fit > 0, _usable(F.try_divide(area(zoom.cast("double")), fit), 1.0)).otherwise(1.0)
