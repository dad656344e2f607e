"""Edges as they arrive: micro-batches of files that keep an edge table, a dictionary and degrees up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.operators.index import dense_index


def stream_edges(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, source_column: str = "source", target_column: str = "target", order: str = "seq") -> StreamingQuery:
    """Reads Parquet files from a folder as they come and appends to ``target``: nodes (batch, idx, id), edges (batch, seq, src, dst) and degree
    changes (batch, idx, degree). New ids get numbers after those given; ids of one batch in the order in which it first has them.

    A batch writes partitions of its own number, so one that is run again after a failure overwrites what it wrote and nothing else."""

    def batch(df: DataFrame, number: int) -> None:
        rows = df.select(F.col(order).alias("seq"), F.col(source_column).cast("string").alias("s"), F.col(target_column).cast("string").alias("d")).where("s is not null and d is not null")
        known = read(spark, target, "nodes", "idx long, id string, batch int").where(F.col("batch") < number).select("idx", "id")
        next_idx = (known.agg(F.max("idx")).first()[0] or 0) + 1 if not known.isEmpty() else 0
        ends = rows.select(F.explode(F.array(F.struct(F.col("s").alias("id"), (F.col("seq") * 2).alias("pos")), F.struct(F.col("d").alias("id"), (F.col("seq") * 2 + 1).alias("pos")))).alias("e")).select("e.*")
        fresh = ends.groupBy("id").agg(F.min("pos").alias("pos")).join(known, "id", "left_anti")
        fresh = dense_index(fresh, ["pos"], "place").select((F.col("place") + next_idx).alias("idx"), "id")
        fresh.write.mode("overwrite").parquet(f"{target}/nodes/batch={number}")
        nodes = known.union(spark.read.parquet(f"{target}/nodes/batch={number}").select("idx", "id"))
        a, b = (nodes.select(F.col("idx").alias(i), F.col("id").alias(c)) for i, c in (("src", "s"), ("dst", "d")))
        rows.join(a, "s").join(b, "d").select("seq", "src", "dst").write.mode("overwrite").parquet(f"{target}/edges/batch={number}")
        made = spark.read.parquet(f"{target}/edges/batch={number}")
        made.select(F.explode(F.array("src", "dst")).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("degree")).write.mode("overwrite").parquet(f"{target}/degrees/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, target: str, name: str, schema: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/{name}")


def degrees(spark: SparkSession, target: str) -> DataFrame:
    """idx, degree so far."""
    return read(spark, target, "degrees", "idx long, degree long, batch int").groupBy("idx").agg(F.sum("degree").alias("degree"))
