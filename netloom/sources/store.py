"""Graphs on disk: Parquet tables, and a manifest written last, without which a graph isn't there.

Each write of a graph goes to a folder of its own, and the manifest names it; so one that is written anew is the old one until the manifest is moved
into place, whatever fails before, and readers of the old one keep their files until ``remove_old``. Nodes are clustered by idx, edges by seq, and their
adjacency by node.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netloom.operators.adjacency import Adjacency, open_adjacency, write_adjacency
from netloom.operators.graph import Graph
from netloom.plans.lineage import cut
from netloom.sources.clustered import Clustered, open_clustered, write_clustered


#: Of the tables' layout; a graph of another version is written anew.
VERSION = 2


def graph_id(name: str, size: int, changed: int) -> str:
    return re.sub(r"[^\w.-]+", "_", f"{name}-{size}-{changed}", flags=re.ASCII)


def sample_id(nodes: int, edges: int) -> str:
    return f"sample-{nodes}x{edges}"


def export_stem(name: str, seed: int) -> str:
    """A file's name without its last extension, and the seed."""
    return f"{re.sub(r'[.][^.]+$', '', name) or 'graph'}-seed{seed}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_graph(spark: SparkSession, graph: Graph, root: str, name: str, id: str, skipped: int = 0) -> dict:
    path, data = f"{root}/{id}", f"data-{uuid.uuid4().hex}"
    at = f"{path}/{data}"
    nodes, edges = cut(graph.nodes.select("idx", "id")), cut(graph.edges)
    n, m = nodes.count(), edges.count()
    shifts = {
        "nodes": write_clustered(nodes, f"{at}/nodes", "idx", max(n - 1, 0), n).shift,
        "edges": write_clustered(edges, f"{at}/edges", "seq", edges.agg(F.max("seq")).first()[0] or 0, m).shift,
        "adjacency": write_adjacency(Graph(nodes, edges), f"{at}/adjacency").table.shift,
    }
    weighted = not edges.where("weight is not null").isEmpty()
    manifest = {"version": VERSION, "id": id, "name": name, "nodes": n, "edges": m, "skipped": skipped, "weighted": weighted, "imported": datetime.now(UTC).isoformat(), "data": data, "shifts": shifts, "edge_schema": edges.schema.jsonValue()}
    write_manifest(spark, path, manifest)
    return manifest


def remove_old(spark: SparkSession, path: str) -> int:
    """Removes the tables of earlier or unfinished writes, which the manifest doesn't name; returns how many. Readers of these lose them."""
    named = _manifest(spark, path)["data"]
    fs, p = _fs(spark, path)
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("data-") and s.getPath().getName() != named]
    for q in old:
        fs.delete(q, True)
    return len(old)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Written beside and moved over the old one in a single step, so a reader sees the old or the new one, and a crash loses neither."""
    fs, temporary = _fs(spark, f"{path}/_manifest.tmp")
    _, final = _fs(spark, f"{path}/manifest.json")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(temporary, final, over)


def is_fresh(spark: SparkSession, path: str, source: str) -> bool:
    """Whether the graph at ``path`` is finished, of this version, and not older than the file or folder it was made of."""
    fs, p = _fs(spark, f"{path}/manifest.json")
    other, s = _fs(spark, source)
    if not fs.exists(p) or manifest_of(spark, path).get("version") != VERSION:
        return False
    status = other.getFileStatus(s)
    files = [status, *(other.listStatus(s) if status.isDirectory() else [])]
    return fs.getFileStatus(p).getModificationTime() >= max(f.getModificationTime() for f in files)


def read_nodes(spark: SparkSession, path: str) -> Clustered:
    """Nodes (idx, id) by idx, for reads of a few."""
    m = _manifest(spark, path)
    return open_clustered(spark, f"{path}/{m['data']}/nodes", spark.createDataFrame([], "idx long, id string"), "idx", m["shifts"]["nodes"])


def read_edges(spark: SparkSession, path: str) -> Clustered:
    """Edges by seq, for reads of a few (``sampling.sample_stored``, ``sampling.first_places``)."""
    m = _manifest(spark, path)
    return open_clustered(spark, f"{path}/{m['data']}/edges", spark.createDataFrame([], StructType.fromJson(m["edge_schema"])), "seq", m["shifts"]["edges"])


def read_adjacency(spark: SparkSession, path: str) -> Adjacency:
    m = _manifest(spark, path)
    return open_adjacency(spark, f"{path}/{m['data']}/adjacency", m["nodes"], m["shifts"]["adjacency"])


def read_tables(spark: SparkSession, path: str) -> Graph:
    return Graph(read_nodes(spark, path).rows, read_edges(spark, path).rows)


def _manifest(spark: SparkSession, path: str) -> dict:
    m = manifest_of(spark, path)
    if m is None:
        raise ValueError(f"no finished graph at {path}")
    return m


def manifest_of(spark: SparkSession, path: str) -> dict | None:
    fs, p = _fs(spark, f"{path}/manifest.json")
    return json.loads("\n".join(r["value"] for r in spark.read.text(p.toString()).collect())) if fs.exists(p) else None


def list_graphs(spark: SparkSession, root: str) -> list[dict]:
    """Manifests, the latest first; graphs without one are unfinished and left out."""
    fs, p = _fs(spark, root)
    found = [manifest_of(spark, f"{root}/{s.getPath().getName()}") for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
    return sorted((m for m in found if m), key=lambda m: m["imported"], reverse=True)


def verify_graph(spark: SparkSession, path: str) -> DataFrame:
    """check, expected, found, ok."""
    m, g = _manifest(spark, path), read_tables(spark, path)
    rows = [("nodes", m["nodes"], g.nodes.count()), ("edges", m["edges"], g.edges.count()), ("dangling", 0, g.edges.where((F.col("src") >= m["nodes"]) | (F.col("dst") >= m["nodes"]) | (F.col("src") < 0) | (F.col("dst") < 0)).count())]
    return spark.createDataFrame([(a, b, c, b == c) for a, b, c in rows], "check string, expected long, found long, ok boolean")


def save_attributes(spark: SparkSession, table: DataFrame, path: str, name: str, key: str) -> None:
    table.write.mode("overwrite").parquet(f"{path}/attributes")
    write_manifest(spark, path, manifest_of(spark, path) | {"attributes": {"name": name, "key": key}})


def save_positions(positions: DataFrame, path: str, seed: int) -> None:
    positions.write.mode("overwrite").parquet(f"{path}/positions/seed={seed}")


def load_positions(spark: SparkSession, path: str, seed: int) -> DataFrame | None:
    fs, p = _fs(spark, f"{path}/positions/seed={seed}")
    return spark.read.parquet(p.toString()) if fs.exists(p) else None


def export_positions(graph: Graph, positions: DataFrame, path: str) -> None:
    """id, x, y of every node in the order of idx, as CSV files in order; fields with quotes, delimiters or line breaks are quoted."""
    rows = graph.nodes.join(positions, "idx").orderBy("idx").select("id", "x", "y")
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
