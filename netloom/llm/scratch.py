"""Intermediate tables of one operator run.

Everything goes to the folder the cluster names in ``spark.checkpoint.dir`` (or to the warehouse, for bucketed tables), so a lost
executor costs the recomputation of its tasks and nothing else. A folder of our own is made only in a local session that names none.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
    return sc.getCheckpointDir()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A query that is written inside loses its shuffle files when it ends: what it gave is read from the table and never computed again.
    Else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """``keep`` cuts lineage by writing a table and reading it again; ``close`` removes what the run no longer needs."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.id = f"{name}_{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark).rstrip('/')}/{self.id}"
        self.tables: list[str] = []
        self.buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, deal: bool = True) -> DataFrame:
        """A warehouse table bucketed by ``key``: later joins on the key don't move its rows. Rows are dealt by the key first (``deal``), so that
        each bucket is one file."""
        table, buckets = f"netloom_{self.id}_{name}", self.buckets
        with shuffles_removed(self.spark):
            (df.repartition(buckets, key) if deal else df).write.format("parquet").bucketBy(buckets, key).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        """Removes a bucketed table that is no longer read."""
        table = f"netloom_{self.id}_{name}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.remove(table)

    def remove(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, result: DataFrame) -> DataFrame:
        """Writes the result (small rows), drops the rest, and returns the result as a table read back."""
        kept = self.keep(result, "result")
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for child in fs.listStatus(path):
            if child.getPath().getName() != "result":
                fs.delete(child.getPath(), True)
        return kept
