"""Search of ids by a part of them."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 50


def search_nodes(nodes: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """idx, id, prefix, truncated: ids that hold ``query`` (A-Z and a-z the same), those that begin with it first, each in the order of idx.

    Nodes count up to the one that fills ``limit`` prefix hits or ``limit`` other hits, whichever comes first. ``truncated`` tells whether hits
    were cut off or nodes were left unread. Both bounds are top-k queries, not running counts, so no task sees all rows."""
    hits = nodes.select("idx", "id", F.instr(F.translate("id", string.ascii_uppercase, string.ascii_lowercase), query.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))).alias("at"))
    hits = hits.where((F.col("at") > 0) & F.lit(query != "")).select("idx", "id", (F.col("at") == 1).alias("prefix"))

    def full(prefix: bool) -> DataFrame:
        first = hits.where(F.col("prefix") == prefix).orderBy("idx").limit(limit)
        return first.agg(F.when(F.count(F.lit(1)) >= limit, F.max("idx")).alias("stop"))

    stop = full(True).union(full(False)).agg(F.min("stop")).first()[0]
    within = hits if stop is None else hits.where(F.col("idx") <= stop)
    last = nodes.agg(F.max("idx")).first()[0]
    shown = within.orderBy(F.desc("prefix"), "idx").limit(limit)
    cut = within.limit(limit + 1).count() > limit or (stop is not None and stop < last)
    return shown.withColumn("truncated", F.lit(cut))
