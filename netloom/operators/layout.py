"""Force-directed layout as tables: seeded positions, placing a level near its parents, schedules, and one force step.

Repulsion is by cells: the sums of the nodes of each cell of a fine grid (128 * 128 rows at most, whatever the graph) and of a coarse one stand
for them and go to every task, so a step needs one small grouped table and one join of the arcs with the positions. Sums of positions are of
fixed-point integers, so the order of adding changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.draws import with_draw
from netloom.plans.joins import SMALL_ROWS
from netloom.plans.lineage import cut

# Fixed values of the layout.
WORLD, FINE, COARSE, SOFTEN, GOLDEN = 4096.0, 128, 16, 0.01, 0x9E3779B9
MOST_STEPS, LEAST_STEPS = 300, 40
#: Communities whose centroids are compared pair by pair; of more, distances are bounded.
MOST_GROUPS = 10_000
#: Positions are summed as integers of this unit; 2 ** 63 holds the sums of 10 ** 12 nodes.
UNIT = 1 << 11


@dataclass(frozen=True)
class Forces:
    attraction: float = 1.0
    repulsion: float = 1.0
    gravity: float = 0.03
    weight_cap: float = 8.0


def square_positions(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """idx, x, y spread over the world's square."""
    drawn = with_draw(with_draw(nodes.select("idx"), seed, F.col("idx") * 2, "u"), seed, F.col("idx") * 2 + 1, "v")
    return drawn.select("idx", (F.col("u") * WORLD).cast("float").alias("x"), (F.col("v") * WORLD).cast("float").alias("y"))


def disc_positions(nodes: DataFrame, seed: int = 42) -> DataFrame:
    """idx, x, y spread over a disc around the centre, evenly by area."""
    drawn = with_draw(with_draw(nodes.select("idx"), seed, F.col("idx") * 2, "u"), seed, F.col("idx") * 2 + 1, "v")
    angle, radius = F.col("u") * 2 * F.pi(), F.sqrt("v") * (WORLD / 4)
    return drawn.select("idx", (WORLD / 2 + F.cos(angle) * radius).cast("float").alias("x"), (WORLD / 2 + F.sin(angle) * radius).cast("float").alias("y"))


def prolongate(parent: DataFrame, positions: DataFrame, coarse_nodes: int, level: int, seed: int = 42) -> DataFrame:
    """idx, x, y of a finer level: each node near its parent (node, coarse). ``level`` is that of the coarse one."""
    key = seed ^ (level * GOLDEN % (1 << 32))
    jitter = WORLD / 2 / max(1, coarse_nodes) ** 0.5
    drawn = with_draw(with_draw(parent.select(F.col("node"), F.col("coarse")), key, F.col("node") * 2, "u"), key, F.col("node") * 2 + 1, "v")
    near = drawn.join(positions.withColumnRenamed("idx", "coarse"), "coarse")
    return near.select(F.col("node").alias("idx"), (F.col("x") + (F.col("u") - 0.5) * jitter).cast("float").alias("x"), (F.col("y") + (F.col("v") - 0.5) * jitter).cast("float").alias("y"))


def steps_of(level: int, levels: int, nodes: int, most_nodes: int | None = None) -> int:
    """Iterations at a level: the coarsest has the most, each finer one half of that."""
    if most_nodes is not None and nodes > most_nodes:
        return 0
    return max(LEAST_STEPS, MOST_STEPS >> (levels - 1 - level))


def step_size(i: int, steps: int, nodes: int, coarsest: bool) -> float:
    """How far a node may move in iteration i: from far to near, by equal factors."""
    k = WORLD / max(1, nodes) ** 0.5
    first, last = WORLD / 8 if coarsest else 4 * k, max(0.3, 0.3 * k)
    return last if steps <= 1 else first * (last / first) ** (i / (steps - 1))


def cells(positions: DataFrame, n: int) -> DataFrame:
    """cx, cy, k, sx, sy: the number of nodes and sums of their positions by cell of an n by n grid."""
    cell = lambda v: f"int(least(greatest(floor(double({v}) / {WORLD / n}D), 0), {n - 1})) AS c{v}"
    placed = positions.selectExpr(cell("x"), cell("y"), f"bigint(round(double(x) * {UNIT})) AS fx", f"bigint(round(double(y) * {UNIT})) AS fy")
    return placed.groupBy("cx", "cy").agg(F.expr("count(*) AS k"), F.expr(f"sum(fx) / double({UNIT}) AS sx"), F.expr(f"sum(fy) / double({UNIT}) AS sy"))


def links(sym: DataFrame, nodes: int, forces: Forces = Forces()) -> DataFrame:
    """src, dst, w: how strongly each arc pulls for a unit of distance, less where either end has many. It is the same for all steps of a level."""
    rows = sym.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    total = rows.agg(F.sum("d")).first()[0] or 0
    scale = forces.attraction * (total / max(1, nodes)) * (WORLD / max(1, nodes) ** 0.5)
    ends = sym.join(rows.withColumnRenamed("d", "d_src"), "src").join(rows.select(F.col("src").alias("dst"), F.col("d").alias("d_dst")), "dst")
    pull = F.lit(scale) * F.least("weight", F.lit(forces.weight_cap)) / F.sqrt((F.col("d_src") + 1) * (F.col("d_dst") + 1).cast("double"))
    return ends.select("src", "dst", pull.alias("w"))


def pulls(links: DataFrame, positions: DataFrame, near: bool) -> DataFrame:
    """idx, fx, fy: the pull of each node's neighbours. ``near``: the positions are few enough to be broadcast."""
    a, b = (positions.selectExpr(f"idx AS {i}", f"double(x) AS x_{i}", f"double(y) AS y_{i}") for i in ("src", "dst"))
    if near:
        a, b = F.broadcast(a), F.broadcast(b)
    each = links.join(a, "src").join(b, "dst").selectExpr("src AS idx", "(x_dst - x_src) * w AS fx", "(y_dst - y_src) * w AS fy")
    return each.groupBy("idx").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def springs(sym: DataFrame, positions: DataFrame, nodes: int, forces: Forces = Forces()) -> DataFrame:
    sym, positions = cut(sym), cut(positions)
    return pulls(links(sym, nodes, forces), positions, nodes <= SMALL_ROWS)


def _field(positions: DataFrame, strength: float):
    """A function of px, py: what all nodes do to one there, the near cells one by one, then the coarse cells around without those, then all the
    rest as one. It holds the sums of the fine grid's cells alone, which are as many for any number of nodes."""
    grid = np.zeros((3, FINE, FINE))
    for r in cells(positions, FINE).collect():
        grid[:, r["cy"], r["cx"]] = r["k"], r["sx"], r["sy"]
    part = FINE // COARSE
    coarse = grid.reshape(3, COARSE, part, COARSE, part).sum(axis=(2, 4))
    whole = coarse.sum(axis=(1, 2))
    # sums of all cells before a row and column, from which those of any rectangle follow
    before, blocks = (np.pad(g, ((0, 0), (1, 0), (1, 0))).cumsum(axis=1).cumsum(axis=2) for g in (grid, coarse))

    def inside(sums, x0, x1, y0, y1):
        n = sums.shape[1] - 1
        x0, x1, y0, y1 = (np.clip(v, 0, n) for v in (x0, x1, y0, y1))
        x1, y1 = np.maximum(x0, x1), np.maximum(y0, y1)
        return sums[:, y1, x1] - sums[:, y0, x1] - sums[:, y1, x0] + sums[:, y0, x0]

    def field(px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cx, cy = (np.clip(np.floor(v / (WORLD / FINE)), 0, FINE - 1).astype(int) for v in (px, py))
        hx, hy = cx // part, cy // part
        fx, fy = np.zeros(len(px)), np.zeros(len(px))

        def push(k, sx, sy):
            some = k > 0
            n = np.where(some, k, 1)
            dx, dy = px - sx / n, py - sy / n
            by = np.where(some, strength * k / (dx * dx + dy * dy + SOFTEN), 0.0)
            np.add(fx, dx * by, out=fx)
            np.add(fy, dy * by, out=fy)

        for oy in range(-2, 3):
            for ox in range(-2, 3):
                k, sx, sy = inside(before, cx + ox, cx + ox + 1, cy + oy, cy + oy + 1)
                push(*((k - 1, sx - px, sy - py) if ox == oy == 0 else (k, sx, sy)))
        for oy in range(-2, 3):
            for ox in range(-2, 3):
                gx, gy = hx + ox, hy + oy
                near = inside(before, np.maximum(gx * part, cx - 2), np.minimum((gx + 1) * part, cx + 3), np.maximum(gy * part, cy - 2), np.minimum((gy + 1) * part, cy + 3))
                push(*(inside(blocks, gx, gx + 1, gy, gy + 1) - near))
        push(*(whole[:, None] - inside(blocks, hx - 2, hx + 3, hy - 2, hy + 3)))
        return fx, fy

    return field


def repulsion(positions: DataFrame, nodes: int, forces: Forces = Forces()) -> DataFrame:
    """idx, fx, fy, x, y: the push of all others on each node, by ``_field``. Nothing is shuffled but the sums of cells."""
    field = _field(positions, forces.repulsion * (WORLD / max(1, nodes) ** 0.5) ** 2)

    @F.pandas_udf("fx double, fy double")
    def pushed(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        fx, fy = field(x.to_numpy(float), y.to_numpy(float))
        return pd.DataFrame({"fx": fx, "fy": fy})

    return positions.select("idx", "x", "y", pushed("x", "y").alias("p")).selectExpr("idx", "p.fx", "p.fy", "x", "y")


def force_step(sym: DataFrame, positions: DataFrame, nodes: int, step: float, forces: Forces = Forces()) -> DataFrame:
    """idx, x, y after one step of all nodes at once; none moves further than ``step`` or leaves the world. Both tables
    are written first, as each is read several times."""
    sym, positions = cut(sym), cut(positions)
    return moved(links(sym, nodes, forces), positions, nodes, step, forces)


def moved(links: DataFrame, positions: DataFrame, nodes: int, step: float, forces: Forces = Forces()) -> DataFrame:
    pull = pulls(links, positions, nodes <= SMALL_ROWS).select("idx", F.col("fx").alias("ax"), F.col("fy").alias("ay"))
    both = repulsion(positions, nodes, forces).join(pull, "idx", "left")
    total = lambda a, r, v: f"coalesce({a}, 0D) + coalesce({r}, 0D) + ({WORLD / 2}D - double({v})) * {forces.gravity}D"
    both = both.selectExpr("idx", "x", "y", f"{total('ax', 'fx', 'x')} AS tx", f"{total('ay', 'fy', 'y')} AS ty")
    both = both.selectExpr("idx", "x", "y", "tx", "ty", "sqrt(tx * tx + ty * ty) AS size")
    to = lambda v: f"float(least(greatest(double({v}) + t{v} * if(size > 1e-9D, least(size, {float(step)!r}D) / size, 0D), 0D), {WORLD}D)) AS {v}"
    return both.selectExpr("idx", to("x"), to("y"))


def health(positions: DataFrame) -> DataFrame:
    """n, bad (not finite), extents, centroid, collapsed."""
    bad = F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    ok = lambda c: F.when(~bad, F.col(c).cast("double"))
    out = positions.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), *(f(ok(c)).alias(f"{f.__name__}_{c}") for c in ("x", "y") for f in (F.min, F.max, F.avg)))
    return out.withColumn("collapsed", F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) < 1.0)


def separation(positions: DataFrame, groups: DataFrame, most_groups: int = MOST_GROUPS) -> DataFrame:
    """intra, inter, ratio, inter_low, inter_high: the mean distance to one's centroid and between centroids, of ``groups`` (idx, community). Up to
    ``most_groups`` centroids are compared pair by pair; of more, ``inter`` lies between the two bounds of ``mean_distance``, in their middle."""
    placed = cut(positions.join(groups, "idx").select("community", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    centres = cut(placed.groupBy("community").agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))
    intra = placed.join(centres, "community").agg(F.avg(F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)).alias("intra"))
    if centres.count() > most_groups:
        inter = mean_distance(centres.select(F.col("mx").alias("x"), F.col("my").alias("y"))).select(((F.col("low") + F.col("high")) / 2).alias("inter"), F.col("low").alias("inter_low"), F.col("high").alias("inter_high"))
    else:
        one, two = (centres.select(F.col("community").alias(f"c{i}"), F.col("mx").alias(f"x{i}"), F.col("my").alias(f"y{i}")) for i in (1, 2))
        pairs = one.join(two, F.col("c1") < F.col("c2"))  # of at most so many communities, not of nodes
        inter = pairs.agg(F.avg(F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)).alias("inter")).select("inter", F.col("inter").alias("inter_low"), F.col("inter").alias("inter_high"))
    return intra.join(inter, F.lit(True)).select("intra", "inter", (F.col("inter") / F.col("intra")).alias("ratio"), "inter_low", "inter_high")


def mean_distance(points: DataFrame, levels: int | None = None) -> DataFrame:
    """low, high: bounds of the mean distance of all pairs of ``points`` (x, y), without visiting the pairs: a decomposition into well-separated ones.

    The square around the points is halved level by level. At each level two cells count as a pair if they lie more than two cells apart and
    their parents don't; each cell has at most 75 partners, whatever the points. For cells with centroids d apart and variances v and w, the mean
    distance of their points is d at least and sqrt(d * d + v + w) at most (both by the convexity of distances and of squares), which is within 6 %
    as d is three sides or more and each variance half a side squared at most. Pairs that are near at the last level are taken with the same bounds,
    so the last level is chosen for about one point a cell. Crowded points make ``high`` wider and never wrong."""
    points = cut(points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    box = points.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side")).first()
    if box["n"] < 2:
        return points.sparkSession.createDataFrame([(None, None)], "low double, high double")
    side = max(box["side"], 1e-9)
    last = levels if levels is not None else max(2, min(24, (int(box["n"]).bit_length() + 1) // 2 + 2))
    cell = lambda c, low, level: F.least(F.floor((F.col(c) - low) / side * (1 << level)), F.lit((1 << level) - 1))
    near = [(dx, dy) for dx in range(-5, 6) for dy in range(-5, 6) if (dx, dy) > (0, 0)]  # children of cells two apart are five apart at most
    parts = []
    for level in range(2, last + 1):
        placed = points.select(cell("x", box["x"], level).alias("cx"), cell("y", box["y"], level).alias("cy"), "x", "y")
        cells = cut(placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("k"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") + F.var_pop("y")).alias("v")))
        to = F.explode(F.array(*(F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx, dy in near))).alias("to")
        one = cells.select(to, *(F.col(c).alias(f"{c}_1") for c in cells.columns)).select("to.*", *(f"{c}_1" for c in cells.columns))
        apart = lambda c: F.abs(F.col(c) - F.col(f"{c}_1"))
        above = lambda c: F.abs(F.shiftright(F.col(c), 1) - F.shiftright(F.col(f"{c}_1"), 1))
        met = one.join(cells, ["cx", "cy"]).where((above("cx") <= 2) & (above("cy") <= 2))
        if level < last:
            met = met.where((apart("cx") > 2) | (apart("cy") > 2))
        d2 = (F.col("mx") - F.col("mx_1")) ** 2 + (F.col("my") - F.col("my_1")) ** 2
        weight = (F.col("k") * F.col("k_1")).cast("double")
        parts.append(met.agg(F.sum(weight * F.sqrt(d2)).alias("low"), F.sum(weight * F.sqrt(d2 + F.col("v") + F.col("v_1"))).alias("high")))
        if level == last:  # pairs inside a cell: their squared distances sum to k * k * v
            pairs = F.col("k") * (F.col("k") - 1) / 2
            parts.append(cells.where("k > 1").agg(F.lit(0.0).alias("low"), F.sum(pairs * F.sqrt(F.col("k") * F.col("v") * 2 / (F.col("k") - 1))).alias("high")))
    total = box["n"] * (box["n"] - 1) / 2
    return reduce(DataFrame.union, parts).agg((F.sum("low") / total).alias("low"), (F.sum("high") / total).alias("high"))


def fingerprint(positions: DataFrame) -> DataFrame:
    """n, hash: equal for equal positions, whatever the order of rows: 60 bits of each row's digest, combined. Positions count in units of 2^-20."""
    unit = lambda c: F.floor(F.col(c).cast("double") * (1 << 20)).cast("string")
    row = F.conv(F.substring(F.md5(F.concat_ws(",", F.col("idx").cast("string"), unit("x"), unit("y"))), 1, 15), 16, 10).cast("long")
    return positions.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("hash"))
