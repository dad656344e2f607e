"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that the cluster names. Where it names none, one of our own serves a local session; on a cluster
    that would be another folder on each machine, and is an error."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder. For loops: what is read back has the size of its files, where a checkpoint keeps the size that was
    estimated for its joins, a product that grows with every round until planning takes longer than the work."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the checkpoints, which all executors share."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="netloom-"))
    return sc.getCheckpointDir()
