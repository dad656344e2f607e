"""The first rows of each key, without all rows of a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks among which the rows of a key are dealt before the last of them ranks what these keep.
SPREAD = 64


def first_rows(rows: DataFrame, by: list[str], order: list[Column], most: int, name: str = "rank", ties: bool = False) -> DataFrame:
    """The first ``most`` rows of each key in the given order, with their place (from 1) as ``name``; with ``ties`` also those equal to the last
    of them. Each task keeps ``most`` of its rows, 64 salts of a key keep as many of what they get, and these are ranked: what meets in one task
    is bounded by ``most`` and not by the rows of the key."""
    place = F.rank() if ties else F.row_number()
    dealt = rows.withColumn("_salt", F.spark_partition_id() % SPREAD)
    for keys in ([*by, "_salt"], by):
        dealt = dealt.withColumn(name, place.over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)
    return dealt.drop("_salt")
