"""Search of ids by a part of them over an index on disk: what ``search.search_nodes`` finds, from the postings of the query's grams alone.

The index has, for every gram of one to three characters (A-Z as a-z), rows of the nodes whose ids hold it, one for each ``WIDTH`` numbers of nodes, clustered
by a hash of the gram; and the ids, clustered by the nodes' numbers. A query of up to three characters is a gram; of a longer one all grams of three
are intersected row by row, and the ids of what is left are compared. Rows are read in the order of the nodes' numbers, twice as many each time,
until hits fill the list, as the search stops there.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.search import LIMIT
from netloom.plans.joins import small
from netloom.plans.lineage import cut, folder
from netloom.sources.clustered import Clustered, write_clustered

WIDTH, LONGEST, KEYS, FIRST_ROWS = 4096, 3, 1 << 20, 4
_FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def _folded(id: Column) -> Column:
    return F.translate(id, string.ascii_uppercase, string.ascii_lowercase)


def postings(nodes: DataFrame) -> DataFrame:
    """gram, chunk, nodes (sorted idx): for each gram of an id, one row for each WIDTH numbers of nodes."""
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("f")), lambda i: F.array(*(F.substring("f", i, F.lit(k)) for k in range(1, LONGEST + 1)))))
    each = nodes.select("idx", _folded(F.col("id")).alias("f")).where("length(f) > 0").select("idx", F.explode(F.array_distinct(parts)).alias("gram"))
    return each.groupBy("gram", F.floor(F.col("idx") / WIDTH).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list("idx")).alias("nodes"))


@dataclass(frozen=True)
class SearchIndex:
    """``nodes``: how many there are, numbered from 0; ``grams`` and ``ids``: the two tables."""

    nodes: int
    grams: Clustered
    ids: Clustered

    def held(self, gram: str) -> DataFrame:
        """chunk, nodes of a gram."""
        key = zlib.crc32(gram.encode()) % KEYS
        return self.grams.between([(key, key)]).where(F.col("gram") == gram).select("chunk", "nodes")

    def candidates(self, query: str, first: int, last: int) -> DataFrame:
        """idx of the nodes in rows ``first`` to ``last`` that have all grams of the query."""
        grams = [query] if len(query) <= LONGEST else sorted({query[i : i + LONGEST] for i in range(len(query) - LONGEST + 1)})
        lists = [self.held(g).where(F.col("chunk").between(first, last)).withColumnRenamed("nodes", f"n{i}") for i, g in enumerate(grams)]
        both = reduce(lambda a, b: a.join(b, "chunk"), lists)
        return both.select(F.explode(reduce(F.array_intersect, [F.col(f"n{i}") for i in range(len(grams))])).alias("idx"))

    def search(self, query: str, limit: int = LIMIT) -> DataFrame:
        """idx, id, prefix, truncated, as ``search.search_nodes`` gives them; at most ``limit`` rows."""
        spark, asked = self.ids.table.sparkSession, query.translate(_FOLD)
        found: dict[bool, list] = {True: [], False: []}
        rows, width, stop = -(-self.nodes // WIDTH), FIRST_ROWS, None
        first = 0 if asked else rows
        while first < rows and stop is None:
            last = min(first + width, rows) - 1
            near = cut(self.candidates(asked, first, last))
            hits = self.ids.between([(first * WIDTH, (last + 1) * WIDTH - 1)]).join(small(near), "idx", "left_semi")
            hits = hits.select("idx", "id", F.instr(_folded(F.col("id")), asked).alias("at")).where("at > 0").select("idx", "id", (F.col("at") == 1).alias("prefix"))
            for kind in (True, False):
                found[kind] += [tuple(r) for r in hits.where(F.col("prefix") == kind).orderBy("idx").limit(limit - len(found[kind])).collect()]
            full = [x[limit - 1][0] for x in found.values() if len(x) >= limit]
            stop = min(full) if full else None
            first, width = last + 1, 2 * width
        within = [r for kind in (True, False) for r in found[kind] if stop is None or r[0] <= stop]
        cut_off = len(within) > limit or (stop is not None and stop < self.nodes - 1)
        return spark.createDataFrame([(*r, cut_off) for r in within[:limit]], "idx long, id string, prefix boolean, truncated boolean")


def write_search(nodes: DataFrame, path: str, **bands) -> SearchIndex:
    """The index of ``nodes`` (idx from 0 on, id), which are written already."""
    n = nodes.count()
    rows = postings(nodes).withColumn("key", (F.crc32("gram") % KEYS).cast("long"))
    grams = write_clustered(rows, f"{path}/grams", "key", KEYS - 1, max(n, KEYS // 64), ("gram", "chunk"), **bands)
    return SearchIndex(n, grams, write_clustered(nodes.select("idx", "id"), f"{path}/ids", "idx", max(n - 1, 0), n, **bands))


def indexed(nodes: DataFrame, **bands) -> SearchIndex:
    """The index of nodes in a new folder of the shared one."""
    nodes = cut(nodes.select("idx", "id"))
    return write_search(nodes, folder(nodes.sparkSession, "search"), **bands)
