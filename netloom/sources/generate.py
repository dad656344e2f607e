"""Synthetic graphs of any size, every edge from its own number and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.draws import with_draw
from netloom.plans.lineage import cut

MOST_NODES, MOST_EDGES, SEED, ATTACHED = 5_000_000, 20_000_000, 0x5EED, 0.85


def check_spec(nodes: int, edges: int) -> None:
    if not (2 <= nodes <= MOST_NODES):
        raise ValueError(f"nodes must be from 2 to {MOST_NODES:,}")
    if not (1 <= edges <= MOST_EDGES):
        raise ValueError(f"edges must be from 1 to {MOST_EDGES:,}")
    if edges < nodes:
        raise ValueError("a graph needs as many edges as nodes at least")


def scale_free(spark: SparkSession, nodes: int, edges: int, seed: int = SEED) -> DataFrame:
    """src, dst, seq: each new node attaches to an end of an earlier edge (mostly; so nodes gain by their degree) or to any earlier node.

    An attachment that copies an end which is itself a copy is resolved by following both at once, so the rounds are as the logarithm of the
    longest chain of copies."""
    check_spec(nodes, edges)
    per = max(1, edges // nodes)
    # edge e belongs to node 1 + e // per, and the last ones to any node
    ids = with_draw(with_draw(with_draw(spark.range(edges).select(F.col("id").alias("seq")), seed, F.col("seq") * 3, "u"), seed, F.col("seq") * 3 + 1, "v"), seed, F.col("seq") * 3 + 2, "w")
    ids = ids.withColumn("src", F.when(F.col("seq") < per * (nodes - 1), 1 + F.floor(F.col("seq") / per)).otherwise(F.floor(F.col("w") * nodes)).cast("long"))
    copies = (F.col("u") < ATTACHED) & (F.col("seq") > 0)
    other = F.floor(F.col("v") * F.greatest(F.col("src"), F.lit(1))).cast("long")
    slot = F.floor(F.col("v") * F.col("seq")).cast("long")  # an earlier edge, whose source or end is copied
    ids = ids.select("seq", "src", F.when(copies & (F.col("w") < 0.5), slot).alias("link"), F.when(copies & (F.col("w") >= 0.5), F.least(1 + F.floor(slot / per), F.lit(nodes - 1))).when(~copies, other).alias("dst"))
    ids = cut(ids)
    while not ids.where("dst is null").limit(1).isEmpty():
        known = ids.select(F.col("seq").alias("link"), F.col("dst").alias("far"), F.col("link").alias("next"))
        ids = cut(ids.join(known, "link", "left").select("seq", "src", F.when(F.col("dst").isNull() & F.col("far").isNull(), F.col("next")).alias("link"), F.coalesce("dst", "far").alias("dst")))
    return ids.select("seq", "src", F.when(F.col("dst") == F.col("src"), F.pmod(F.col("src") + 1, F.lit(nodes))).otherwise(F.col("dst")).alias("dst"))


def planted(spark: SparkSession, nodes: int, edges: int, communities: int = 40, inside: float = 0.92, seed: int = SEED) -> DataFrame:
    """src, dst, seq: communities of equal size, most edges within one."""
    size = max(1, nodes // communities)
    rows = spark.range(edges).select(F.col("id").alias("seq"))
    for i, c in enumerate(("u", "v", "w")):
        rows = with_draw(rows, seed, F.col("seq") * 3 + i, c)
    src = F.floor(F.col("u") * nodes).cast("long")
    home = F.least(F.floor(src / size), F.lit(communities - 1))
    width = F.when(home == communities - 1, nodes - home * size).otherwise(size)
    dst = F.when(F.col("w") < inside, home * size + F.floor(F.col("v") * width)).otherwise(F.floor(F.col("v") * nodes)).cast("long")
    return rows.select("seq", src.alias("src"), dst.alias("dst")).withColumn("dst", F.when(F.col("dst") == F.col("src"), F.pmod(F.col("src") + 1, F.lit(nodes))).otherwise(F.col("dst")))


def node_attributes(spark: SparkSession, nodes: int, communities: int = 12, ghosts: int = 10, seed: int = 0xA771B) -> DataFrame:
    """id, community, score, kind of all nodes, and rows of no node."""
    size = max(1, nodes // communities)
    rows = with_draw(with_draw(spark.range(nodes + ghosts).select(F.col("id").alias("i")), seed, F.col("i") * 2, "u"), seed, F.col("i") * 2 + 1, "v")
    ghost = F.col("i") >= nodes
    kind = F.element_at(F.array(F.lit("hub"), F.lit("bridge"), F.lit("leaf")), (F.floor(F.col("v") * 3) + 1).cast("int"))
    return rows.select(
        F.when(ghost, F.concat(F.lit("ghost"), F.col("i") - nodes)).otherwise(F.concat(F.lit("n"), F.col("i"))).alias("id"),
        F.when(ghost, "c0").otherwise(F.concat(F.lit("c"), F.least(F.floor(F.col("i") / size), F.lit(communities - 1)))).alias("community"),
        F.round("u", 4).alias("score"),
        F.when(ghost, "hub").otherwise(kind).alias("kind"),
    )


def write_csv(edges: DataFrame, path: str) -> None:
    """The edges as delimited files without a header, ids as ``n0``, ``n1``, in the order of ``seq`` by the files' names: input for ``read_records``."""
    ids = edges.repartitionByRange("seq").sortWithinPartitions("seq").select(*(F.concat(F.lit("n"), c).alias(c) for c in ("src", "dst")))
    ids.write.mode("overwrite").csv(path, header=False)


def csv_bytes(edges: DataFrame) -> DataFrame:
    """bytes: the size of the edges as a CSV file with the header ``source,target`` and ids ``n0``, ``n1``..."""
    return edges.agg((F.lit(14) + F.coalesce(F.sum(F.length(F.col("src").cast("string")) + F.length(F.col("dst").cast("string")) + 4), F.lit(0))).cast("long").alias("bytes"))
