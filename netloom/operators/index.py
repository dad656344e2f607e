"""Dense numbering without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.lineage import cut


def dense_index(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: its rows' numbers from 0 in the given order.

    Rows are dealt by ranges of the order, sorted and numbered in their range, and moved on by the sizes of the ranges before: one shuffle. Only
    those sizes, one per partition, meet in one place. The numbered rows are written before they are used, so that ties stay as they fell.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_id", 33))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_before")
