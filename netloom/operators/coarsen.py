"""Coarsening: size-capped label propagation in synchronous rounds, contraction, and the hierarchy of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.graph import symmetrize
from netloom.operators.index import dense_index
from netloom.plans.lineage import written

TARGET_NODES, MAX_LEVELS, MAX_CLUSTER, SWEEPS = 10_000, 12, 32, 5
#: A level that keeps more than this share of the nodes is not worth having.
SHRINK = (20, 19)


def votes(sym: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label, weight: what each node's neighbours say, summed by label."""
    said = labels.select(F.col("node").alias("dst"), "label")
    return sym.join(said, "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("weight"))


def strongest(tally: DataFrame) -> DataFrame:
    """node, label, weight of the heaviest label, the smallest of those that tie."""
    return tally.groupBy("node").agg(F.max(F.struct("weight", (-F.col("label")).alias("low"))).alias("best")).select("node", (-F.col("best.low")).alias("label"), F.col("best.weight").alias("weight"))


def step(sym: DataFrame, labels: DataFrame, moving: DataFrame, cap: int = MAX_CLUSTER) -> DataFrame:
    """node, label, moved: the nodes of ``moving`` may move to the heaviest label with room; a label admits as many as there is room for, the heaviest
    votes first. A label never exceeds ``cap``, as places freed in a step are given in the next."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    cast = votes(sym.join(moving.select(F.col("node").alias("src")), "src", "left_semi"), labels)
    open_votes = cast.join(sizes.where(F.col("size") < cap).select("label", "size"), "label")
    current = labels.select("node", F.col("label").alias("current"))
    wish = strongest(open_votes.drop("size")).join(current, "node")
    own = cast.withColumnRenamed("label", "current").withColumnRenamed("weight", "own")
    wish = wish.where(F.col("label") != F.col("current")).join(own, ["node", "current"], "left")
    better = (F.col("weight") > F.coalesce("own", F.lit(0.0))) | ((F.col("weight") == F.col("own")) & (F.col("label") < F.col("current")))
    wish = wish.where(better).select("node", "label", "weight").join(sizes, "label")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("weight"), "node"))
    moved = wish.withColumn("rank", rank).where(F.col("rank") <= cap).where(F.col("rank") <= F.lit(cap) - F.col("size")).select("node", F.col("label").alias("to"))
    return labels.join(moved, "node", "left").select("node", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved"))


def sweep(sym: DataFrame, labels: DataFrame, turn: int, cap: int = MAX_CLUSTER, seed: int = 42) -> DataFrame:
    """One round: ``step`` of half of the nodes, by a hash of the round."""
    return step(sym, labels, labels.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "node"), F.lit(2)) == 0), cap)


def propagate(sym: DataFrame, nodes: DataFrame, cap: int = MAX_CLUSTER, sweeps: int = SWEEPS, seed: int = 42) -> DataFrame:
    """node, label after at most ``sweeps`` rounds of each half of the nodes; nodes without neighbours keep their own."""
    labels = nodes.select(F.col("idx").alias("node"), F.col("idx").alias("label"))
    quiet = 0
    for turn in range(2 * sweeps):
        stepped = written(sweep(sym, labels, turn, cap, seed), "labels")
        labels = stepped.select("node", "label")
        quiet = quiet + 1 if stepped.where("moved").isEmpty() else 0
        if quiet == 2:
            break
    return labels


def colours(sym: DataFrame, nodes: DataFrame, seed: int = 42) -> DataFrame:
    """node, colour: neighbours differ. Each round the nodes without a colour whose hash is above those of all such neighbours take the smallest
    number that none of their neighbours has (Jones and Plassmann); the result depends on the seed and the graph alone. Rounds follow the longest chain
    of falling hashes, about the logarithm of the number of nodes where degrees are bounded."""
    state = written(nodes.select(F.col("idx").alias("node"), F.lit(None).cast("int").alias("colour")), "colours")
    while True:
        rank = F.struct(F.xxhash64(F.lit(seed), F.col("node")), F.col("node"))
        ends = sym.where("src <> dst").select("src", "dst").join(state.where("colour is null").select(F.col("node").alias("src")), "src", "left_semi")
        told = ends.join(state.select(F.col("node").alias("dst"), "colour", rank.alias("rank")), "dst")
        heard = told.groupBy(F.col("src").alias("node")).agg(F.max(F.when(F.col("colour").isNull(), F.col("rank"))).alias("highest"), F.collect_set("colour").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
        first = F.when(F.col("used").isNull(), 0).when(F.col("highest").isNull() | (rank > F.col("highest")), free)
        state = written(state.join(heard, "node", "left").select("node", F.coalesce("colour", first).alias("colour")), "colours")
        if state.where("colour is null").isEmpty():
            return state


def propagate_in_order(sym: DataFrame, nodes: DataFrame, cap: int = MAX_CLUSTER, sweeps: int = SWEEPS, seed: int = 42) -> DataFrame:
    """As ``propagate``, one node after another: the nodes of a colour move together, and as no two of them are neighbours each sees what all before it
    did, as if the nodes moved one by one in the order of their colours. A sweep takes a step for each colour."""
    coloured = colours(sym, nodes, seed)
    most = coloured.agg(F.max("colour")).first()[0]
    labels = nodes.select(F.col("idx").alias("node"), F.col("idx").alias("label"))
    for _ in range(sweeps if most is not None else 0):
        still = True
        for c in range(most + 1):
            stepped = written(step(sym, labels, coloured.where(F.col("colour") == c), cap), "labels")
            labels, still = stepped.select("node", "label"), still and stepped.where("moved").isEmpty()
        if still:
            break
    return labels


def compact(labels: DataFrame) -> DataFrame:
    """node, coarse: labels numbered in the order of the first node that has them."""
    first = dense_index(labels.groupBy("label").agg(F.min("node").alias("first")), ["first"], "coarse").select("label", "coarse")
    return labels.join(first, "label").select("node", "coarse")


def contract(sym: DataFrame, parent: DataFrame) -> DataFrame:
    """src, dst, weight between clusters; edges inside one are dropped, the others summed."""
    a, b = (parent.select(F.col("node").alias(c), F.col("coarse").alias(f"c{c}")) for c in ("src", "dst"))
    return sym.join(a, "src").join(b, "dst").where("csrc <> cdst").groupBy(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).agg(F.sum("weight").alias("weight"))


def checksum(sym: DataFrame) -> DataFrame:
    """arcs, hash of a level: equal for equal arcs, whatever the order of rows: 60 bits of each arc's digest, combined. Weights count in units of
    2^-20."""
    row = F.md5(F.concat_ws(",", F.col("src").cast("string"), F.col("dst").cast("string"), F.floor(F.col("weight").cast("double") * (1 << 20)).cast("string")))
    return sym.agg(F.count(F.lit(1)).alias("arcs"), F.bit_xor(F.conv(F.substring(row, 1, 15), 16, 10).cast("long")).alias("hash"))


def build_hierarchy(edges: DataFrame, nodes: DataFrame, target: int = TARGET_NODES, max_levels: int = MAX_LEVELS, cap: int = MAX_CLUSTER, sweeps: int = SWEEPS, weighted: bool = False, in_order: bool = False) -> list[dict]:
    """Levels, the finest first: each a dict of ``nodes`` (idx), ``n``, ``sym`` and ``parent`` (node, coarse; None at the last). ``in_order``: labels
    spread by ``propagate_in_order``."""
    spread = propagate_in_order if in_order else propagate
    sym, nodes = written(symmetrize(edges, weighted), "arcs"), nodes.select("idx")
    levels = [{"nodes": nodes, "n": nodes.count(), "sym": sym, "parent": None}]
    while levels[-1]["n"] > target and len(levels) < max_levels:
        top = levels[-1]
        parent = written(compact(spread(top["sym"], top["nodes"], cap, sweeps)), "parents")
        coarse = parent.select(F.col("coarse").alias("idx")).distinct()
        n = coarse.count()
        if n * SHRINK[0] > top["n"] * SHRINK[1]:
            break
        top["parent"] = parent
        levels.append({"nodes": coarse, "n": n, "sym": written(contract(top["sym"], parent), "arcs"), "parent": None})
    return levels


def invariants(levels: list[dict], target: int = TARGET_NODES, max_levels: int = MAX_LEVELS, cap: int = MAX_CLUSTER) -> DataFrame:
    """check, ok: what holds of every hierarchy. A node has one parent; clusters hold ``cap`` nodes at most and are numbered without gaps; a level has at
    most 19 of 20 nodes of the one below; the weight between clusters is that between their nodes; the last level is small enough, or none below
    it could shrink, or there are ``max_levels``."""
    whole = lambda sym: sym.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    parents = capped = dense = shrunk = weights = True
    for fine, coarse in zip(levels, levels[1:], strict=False):
        parent = fine["parent"]
        covered = fine["nodes"].join(parent.groupBy(F.col("node").alias("idx")).count(), "idx", "left").where("count is null or count <> 1").isEmpty()
        parents &= covered and parent.count() == fine["n"]
        sizes = parent.groupBy("coarse").count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("n"), F.min("coarse").alias("low"), F.max("coarse").alias("high")).first()
        capped &= sizes["most"] <= cap
        dense &= sizes["n"] == coarse["n"] and (sizes["low"], sizes["high"]) == (0, coarse["n"] - 1)
        shrunk &= coarse["n"] * SHRINK[0] <= fine["n"] * SHRINK[1]
        inside = fine["sym"].join(parent.select(F.col("node").alias("src"), F.col("coarse").alias("a")), "src").join(parent.select(F.col("node").alias("dst"), F.col("coarse").alias("b")), "dst").where("a = b")
        weights &= abs(whole(fine["sym"]) - whole(inside) - whole(coarse["sym"])) <= 1e-6 * max(1.0, whole(fine["sym"]))
    ends = levels[-1]["n"] <= target or len(levels) == max_levels or levels[-1]["parent"] is None
    found = {"one parent": parents, "cap": capped, "dense": dense, "shrinks": shrunk, "weights": weights, "ends": ends, "several levels": len(levels) > 1}
    return levels[0]["nodes"].sparkSession.createDataFrame(list(found.items()), "check string, ok boolean")
