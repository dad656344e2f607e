"""Graphs as two tables: ``nodes`` (idx, id) and ``edges`` (seq, src, dst, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.index import dense_index
from netloom.plans.joins import small
from netloom.plans.lineage import cut

#: Names listed of a neighbourhood.
LISTED = 20_000


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def intern(records: DataFrame) -> Graph:
    """``records`` (seq, source, target, weight): ids are numbered in the order in which they are first seen, a record's source before its
    target. Empty ids are ids; self-loops and repeated edges stay."""
    ends = records.select(F.col("source").alias("id"), (F.col("seq") * 2).alias("pos")).union(records.select("target", F.col("seq") * 2 + 1))
    nodes = dense_index(ends.groupBy("id").agg(F.min("pos").alias("pos")), ["pos"], "idx").select("idx", "id")
    nodes = nodes.cache()
    source, target = (nodes.select(F.col("idx").alias(i), F.col("id").alias(c)) for i, c in (("src", "source"), ("dst", "target")))
    return Graph(nodes, records.join(source, "source").join(target, "target").select("seq", "src", "dst", "weight"))


def first_seen(records: DataFrame, order: list[str]) -> DataFrame:
    """idx, id, degree of unnumbered ``records`` (source, target and the columns that order them): ids are numbered as ``intern`` numbers them, by one
    aggregation of both ends. The records themselves are neither sorted nor numbered."""
    end = lambda c, k: F.struct(F.col(c).alias("id"), F.struct(*order, F.lit(k).alias("_end")).alias("pos"))
    ends = records.select(F.explode(F.array(end("source", 0), end("target", 1))).alias("e")).select("e.id", "e.pos")
    return dense_index(ends.groupBy("id").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("degree")), ["pos"], "idx").select("idx", "id", "degree")


def intern_unnumbered(records: DataFrame, order: list[str]) -> Graph:
    """As ``intern``, for those who need no ``seq``: nodes (idx, id, degree) and edges (src, dst, weight)."""
    nodes = cut(first_seen(records, order))
    ids = small(nodes.select("idx", "id"))
    source, target = (ids.select(F.col("idx").alias(i), F.col("id").alias(c)) for i, c in (("src", "source"), ("dst", "target")))
    return Graph(nodes, records.join(source, "source").join(target, "target").select("src", "dst", "weight"))


def degrees_by_id(records: DataFrame) -> DataFrame:
    """id, degree of records (source, target): ends of edges at each id, without numbers for ids."""
    return records.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def lookup(graph: Graph, ids: DataFrame) -> DataFrame:
    """id, idx of given ids (a column id); idx is null where the graph has none."""
    return ids.join(graph.nodes, "id", "left").select("id", "idx")


def out_degree(graph: Graph) -> DataFrame:
    """id, degree of all nodes."""
    counts = graph.edges.groupBy(F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.join(counts, "idx", "left").select("idx", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def total_degree(graph: Graph) -> DataFrame:
    """Ends of edges at each node; a self-loop has two. The sum is twice the number of edges."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("idx"))
    counts = ends.groupBy("idx").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.join(counts, "idx", "left").select("idx", "id", F.coalesce("degree", F.lit(0)).alias("degree"))


def row(graph: Graph, node: Column | int) -> DataFrame:
    """seq, dst of a node's own edges in the order of input."""
    return graph.edges.where(F.col("src") == node).select("seq", "dst").orderBy("seq")


def adjacency(graph: Graph) -> DataFrame:
    """src, neighbours in the order of input, for nodes whose lists fit a row."""
    return graph.edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("seq", "dst"))).alias("r")).select("src", F.col("r.dst").alias("neighbours"))


def adjacency_pages(graph: Graph, size: int = 4096) -> DataFrame:
    """src, page, neighbours in the order of input: a page holds the edges of ``size`` places of the input, so a row has that many neighbours at
    most, whatever a node's degree."""
    page = F.floor(F.col("seq") / size).alias("page")
    return graph.edges.groupBy("src", page).agg(F.array_sort(F.collect_list(F.struct("seq", "dst"))).alias("r")).select("src", "page", F.col("r.dst").alias("neighbours"))


def arcs(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: from, to, and where it is stored (row, seq)."""
    both = F.array(F.struct(F.col("src").alias("from"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("from"), F.col("src").alias("to")))
    return edges.select(F.explode(both).alias("a"), F.col("src").alias("row"), "seq").select("a.from", "a.to", "row", "seq")


def neighbours(graph: Graph, node: int) -> DataFrame:
    """Distinct nodes that share an edge with ``node``, in either direction, without itself."""
    ends = graph.edges.where((F.col("src") == node) | (F.col("dst") == node))
    return ends.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("idx")).where(F.col("idx") != node).distinct()


def neighbour_list(graph: Graph, node: int, cap: int = LISTED) -> DataFrame:
    """The first ``cap`` of ``neighbours``, ascending; ``neighbours`` counts all."""
    return neighbours(graph, node).orderBy("idx").limit(cap)


def khop(graph: Graph, seed: int, hops: int) -> DataFrame:
    """node, parent, hop of all nodes within ``hops`` of the seed, level by level; the seed has hop 0 and no parent. A node's parent is the
    frontier's end of the first edge, by stored row and place, that reaches it. An unknown seed reaches nothing. While frontier and nodes seen
    are small they are broadcast, and no hop shuffles the edges; these are written once. For many hops, or many searches of a graph, write its
    adjacency (``adjacency.Adjacency.khop``)."""
    links = cut(arcs(graph.edges).where(F.col("from") != F.col("to")))
    seen = cut(graph.nodes.where(F.col("idx") == seed).select(F.col("idx").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("hop")))
    for hop in range(1, hops + 1):
        frontier = small(seen.where(F.col("hop") == hop - 1).select(F.col("node").alias("from")))
        reached = links.join(frontier, "from").join(small(seen.select(F.col("node").alias("to"))), "to", "left_anti")
        fresh = cut(reached.groupBy(F.col("to").alias("node")).agg(F.min_by("from", F.struct("row", "seq")).alias("parent")).withColumn("hop", F.lit(hop)))
        if fresh.isEmpty():
            break
        seen = seen.union(fresh)
    return seen


def listed(found: DataFrame, cap: int = LISTED) -> DataFrame:
    """total, listed of a neighbourhood: all of it, and how many a list of ``cap`` shows."""
    return found.where("hop > 0").agg(F.count(F.lit(1)).alias("total")).select("total", F.least("total", F.lit(cap)).alias("listed"))


def symmetrize(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """src, dst, weight: both directions of every edge but self-loops, repeated ones summed; an edge without weight weighs 1."""
    weight = F.coalesce(F.col("weight"), F.lit(1.0)) if weighted else F.lit(1.0)
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.where("src <> dst").select(both.alias("a"), weight.alias("weight")).groupBy("a.src", "a.dst").agg(F.sum("weight").alias("weight"))


def induced(graph: Graph, mask: DataFrame) -> DataFrame:
    """The edges both of whose ends are in ``mask`` (idx)."""
    return graph.edges.join(mask.select(F.col("idx").alias("src")), "src", "left_semi").join(mask.select(F.col("idx").alias("dst")), "dst", "left_semi")


def offsets(graph: Graph) -> DataFrame:
    """src, degree and where its row would begin if rows lay one after another."""
    counts = out_degree(graph).select("idx", "degree")
    width = 1 << 12  # sums of runs of nodes first, so that one window is over these alone
    runs = counts.groupBy(F.floor(F.col("idx") / width).alias("run")).agg(F.sum("degree").alias("n"))
    before = runs.select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("degree").over(Window.partitionBy("run").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("run", F.floor(F.col("idx") / width)).join(before, "run").select("idx", "degree", (F.col("before") + inner).alias("offset"))
