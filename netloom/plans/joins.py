"""Which tables may be broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most so many rows and bytes of text is broadcast; one beyond either meets the other side by a shuffle.
SMALL_ROWS, SMALL_BYTES = 500_000, 16 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcasting if a count of its rows and of the bytes of its texts says that it is small. It is read twice, so it should
    be one that is written already."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"]
    size = reduce(lambda a, b: a + b, texts, F.lit(0)).cast("long")
    rows, text = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL_ROWS and text <= SMALL_BYTES else df
