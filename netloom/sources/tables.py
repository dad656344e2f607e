"""Graphs of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.operators.graph import Graph, first_seen, intern, intern_unnumbered
from netloom.sources.edges import from_table, unnumbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> tuple:
    lines = table(spark, sf_dir, "lineitem")
    return lines, F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"), F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity"]


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers to parts, an edge per line item."""
    return intern(from_table(*lines_of(spark, sf_dir)))


def supply_links(spark: SparkSession, sf_dir: str) -> Graph:
    """The same without the numbers of edges, for what doesn't ask for the order of edges."""
    return intern_unnumbered(*unnumbered(*lines_of(spark, sf_dir)))


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its nodes alone: idx, id, degree."""
    return first_seen(*unnumbered(*lines_of(spark, sf_dir)))


def supply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its records (source, target, weight) alone."""
    return unnumbered(*lines_of(spark, sf_dir))[0].select("source", "target", "weight")


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations to regions, customers and suppliers to nations: a forest."""
    edge = lambda name, a, x, b, y: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(x)).alias("s"), F.concat(F.lit(b), F.col(y)).alias("d"))
    rows = edge("nation", "n", "n_nationkey", "r", "n_regionkey").union(edge("customer", "c", "c_custkey", "n", "c_nationkey")).union(edge("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    return intern(from_table(rows, F.col("s"), F.col("d"), None, ["s", "d"]))


def sequels(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers to nations, and each customer to the first of its orders of a priority, each of these to the next: a forest of long chains."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    orders = table(spark, sf_dir, "orders").select(F.coalesce(F.concat(F.lit("o"), before), F.concat(F.lit("c"), "o_custkey")).alias("s"), F.concat(F.lit("o"), "o_orderkey").alias("d"))
    homes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.concat(F.lit("n"), "c_nationkey").alias("d"))
    return intern(from_table(orders.union(homes), F.col("s"), F.col("d"), None, ["s", "d"]))


def visits(spark: SparkSession, sf_dir: str) -> Graph:
    """Users to the types of their events, weighted by value."""
    return intern(from_table(table(spark, sf_dir, "events"), F.concat(F.lit("u"), "user_id"), F.col("event_type"), F.col("value"), ["event_id"]))


def web(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages to the addresses they link to, in order."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n", "href"))
    return intern(from_table(links, F.col("url"), F.col("href"), None, ["page_id", "n"]))


def part_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the parts of ``supply``, a row per part."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_brand", "p_type", "p_size", "p_retailprice")
