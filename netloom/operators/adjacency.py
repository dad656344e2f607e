"""Adjacency on disk: the arcs of each node in a few rows, clustered by node, from which rows, neighbours and searches in breadth read only what they reach.

A row has at most about ``CHUNK`` arcs of one node (to, seq and whether the edge is stored from this end), in the order of ``seq``; a node of more
arcs has several rows, among which its arcs are dealt by a hash of ``seq``, so that no row grows with a node's degree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.graph import LISTED, Graph
from netloom.plans.joins import small
from netloom.plans.lineage import cut, folder
from netloom.sources.clustered import Clustered, open_clustered, write_clustered

CHUNK = 4096
_SCHEMA = "node long, page int, n int, to array<long>, seq array<long>, own array<boolean>"
_HOP = "node long, parent long, hop int"


@dataclass(frozen=True)
class Adjacency:
    """``nodes``: how many the graph has, numbered from 0; ``table``: their arcs."""

    nodes: int
    table: Clustered

    def arcs(self, rows: DataFrame) -> DataFrame:
        """from, to and where the edge is stored (row, seq), of rows of the table; self-loops are left out."""
        each = rows.select(F.col("node").alias("from"), F.explode(F.arrays_zip("to", "seq", "own")).alias("a")).select("from", "a.to", "a.seq", "a.own")
        return each.where(F.col("from") != F.col("to")).select("from", "to", F.when(F.col("own"), F.col("from")).otherwise(F.col("to")).alias("row"), "seq")

    def row(self, node: int) -> DataFrame:
        """seq, dst of a node's own edges in the order of input."""
        each = self.table.between([(node, node)]).select(F.explode(F.arrays_zip("to", "seq", "own")).alias("a"))
        return each.where("a.own").select("a.seq", F.col("a.to").alias("dst")).orderBy("seq")

    def degree(self, node: int) -> DataFrame:
        """degree: ends of edges at a node."""
        return self.table.between([(node, node)]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("degree"))

    def neighbours(self, node: int) -> DataFrame:
        """Distinct nodes that share an edge with ``node``, in either direction, without itself."""
        return self.table.between([(node, node)]).select(F.explode("to").alias("idx")).where(F.col("idx") != node).distinct()

    def neighbour_list(self, node: int, cap: int = LISTED) -> DataFrame:
        return self.neighbours(node).orderBy("idx").limit(cap)

    def induced(self, mask: DataFrame) -> DataFrame:
        """seq, src, dst of the edges both of whose ends are in ``mask`` (idx)."""
        nodes = cut(mask.select(F.col("idx").cast("long").alias("node")).distinct())
        own = self.table.among(nodes).select(F.col("node").alias("src"), F.explode(F.arrays_zip("to", "seq", "own")).alias("a")).where("a.own")
        return own.select("a.seq", "src", F.col("a.to").alias("dst")).join(small(nodes.select(F.col("node").alias("dst"))), "dst", "left_semi").select("seq", "src", "dst")

    def khop(self, seed: int, hops: int | None = None) -> DataFrame:
        """node, parent, hop of all nodes within ``hops`` of the seed, or of all that can be reached; as ``graph.khop``, whose definition of a parent it
        shares. A frontier smaller than what is still unseen reads its own rows of the table and passes what was seen by (top-down). A larger
        one is asked instead: the rows of unseen nodes are read, and each takes its first edge that ends in the frontier (bottom-up), without
        moving the frontier's arcs. Each hop is written to the shared folder, where the next finds it, so the plan doesn't grow with the hops."""
        spark = self.table.table.sparkSession
        path = folder(spark, "khop")
        n = _hop(spark.createDataFrame([(seed, None)] if 0 <= seed < self.nodes else [], "node long, parent long"), path, 0)
        seen, hop = n, 0
        while n and (hops is None or hop < hops):
            every = spark.read.schema(_HOP).parquet(path)
            frontier = spark.read.schema("node long").parquet(f"{path}/hop={hop}").select("node")
            if n <= self.nodes - seen:
                reached = self.arcs(self.table.among(frontier)).join(small(every.select(F.col("node").alias("to"))), "to", "left_anti")
                fresh = reached.groupBy(F.col("to").alias("node")).agg(F.min_by("from", F.struct("row", "seq")).alias("parent"))
            else:
                unseen = self.table.rows.join(small(every.select("node")), "node", "left_anti")
                ends = self.arcs(unseen).join(small(frontier.select(F.col("node").alias("to"))), "to", "left_semi")
                fresh = ends.groupBy(F.col("from").alias("node")).agg(F.min_by("to", F.struct("row", "seq")).alias("parent"))
            hop += 1
            n = _hop(fresh, path, hop)
            seen += n
        return spark.read.schema(_HOP).parquet(path).select("node", "parent", "hop")


def _hop(found: DataFrame, path: str, hop: int) -> int:
    """Writes a hop and counts it."""
    found.select("node", "parent").write.parquet(f"{path}/hop={hop}")
    return found.sparkSession.read.schema("node long").parquet(f"{path}/hop={hop}").count()


def adjacency_rows(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, page, n, to, seq, own."""
    both = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(True).alias("own")), F.struct(F.col("dst").alias("node"), F.col("src").alias("to"), F.lit(False).alias("own")))
    ends = edges.select(F.explode(both).alias("a"), F.col("seq").cast("long").alias("seq")).select(F.col("a.node").cast("long").alias("node"), F.col("a.to").cast("long").alias("to"), "a.own", "seq")
    hubs = cut(ends.groupBy("node").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > chunk))
    paged = ends.join(small(hubs), "node", "left").withColumn("page", F.when(F.col("d").isNull(), 0).otherwise(F.pmod(F.xxhash64("seq"), F.ceil(F.col("d") / chunk))).cast("int"))
    rows = paged.groupBy("node", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "own", "to"))).alias("a"))
    return rows.select("node", "page", F.size("a").alias("n"), F.col("a.to").alias("to"), F.col("a.seq").alias("seq"), F.col("a.own").alias("own"))


def write_adjacency(graph: Graph, path: str, chunk: int = CHUNK, **bands) -> Adjacency:
    """The adjacency of a graph whose edges are written already; ``bands`` as for ``write_clustered``."""
    nodes, edges = graph.nodes.count(), graph.edges.count()
    table = write_clustered(adjacency_rows(graph.edges, chunk), path, "node", max(nodes - 1, 0), nodes + 2 * edges // chunk, ("page",), **bands)
    return Adjacency(nodes, table)


def open_adjacency(spark: SparkSession, path: str, nodes: int, shift: int) -> Adjacency:
    return Adjacency(nodes, open_clustered(spark, path, spark.createDataFrame([], _SCHEMA), "node", shift))


def stored(graph: Graph, **options) -> Adjacency:
    """The adjacency of a graph in a new folder of the shared one, its edges written first."""
    edges = cut(graph.edges.select("seq", "src", "dst"))
    return write_adjacency(Graph(graph.nodes, edges), folder(edges.sparkSession, "adjacency"), **options)
