"""Tables clustered by a whole number of 0 or more, of which a read opens only what it asks for.

Rows are sorted by the key and written to folders by band, a run of keys of a power of two. A read names its bands, so that other files are not
opened, and its intervals, so that row groups and pages of those files are passed over by their statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.plans.joins import small

BAND = "_band"
#: Folders of a table; rows of a folder in the mean, where the table has fewer than that; intervals of one read; bytes of a row group.
MOST_BANDS, BAND_ROWS, MOST_INTERVALS, GROUP_BYTES = 4096, 1 << 16, 256, 8 << 20


def merged(intervals: list[tuple[int, int]], most: int = MOST_INTERVALS) -> list[tuple[int, int]]:
    """Inclusive intervals in order, those that touch as one; beyond ``most`` those with the narrowest gaps between them as one too."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1])[: len(out) - most]
        closed, wide = set(gaps), []
        for i, x in enumerate(out):
            if i in closed:
                wide[-1] = (wide[-1][0], x[1])
            else:
                wide.append(x)
        out = wide
    return out


def within(key: Column, intervals: list[tuple[int, int]]) -> Column:
    """Whether ``key`` lies in one of the intervals, which are in order. They are halved again and again, each half behind a test of its whole span: a row
    is tested against a few, where a plain chain of hundreds tests all in code too long to be compiled. Scans prune by it as by a chain."""
    if len(intervals) == 1:
        return key.between(*intervals[0])
    half = len(intervals) // 2
    inner = within(key, intervals[:half]) | within(key, intervals[half:])
    return key.between(intervals[0][0], intervals[-1][1]) & inner if len(intervals) > 2 else inner


@dataclass(frozen=True)
class Clustered:
    """``table`` with its band; ``key`` is its key column, whose bits above ``shift`` are the band."""

    table: DataFrame
    key: str
    shift: int

    @property
    def rows(self) -> DataFrame:
        return self.table.drop(BAND)

    def between(self, intervals: list[tuple[int, int]]) -> DataFrame:
        """The rows whose key lies in one of the inclusive intervals. Of very many intervals neighbours are read as one and told apart by a join, in
        which a row meets the intervals of its own band alone."""
        asked = merged(intervals, len(intervals))
        if not asked:
            return self.rows.where("false")
        read = merged(asked)
        touched = lambda x, y: range(max(x, 0) >> self.shift, (max(y, 0) >> self.shift) + 1)
        banded = sum(len(touched(x, y)) for x, y in read) <= 4 * MOST_BANDS
        found = self.table.where(F.col(BAND).isin(sorted({b for x, y in read for b in touched(x, y)}))) if banded else self.table
        found = found.where(within(F.col(self.key), read))
        if len(read) < len(asked):
            inside = F.col(self.key).between(F.col("_from"), F.col("_to"))
            if banded:
                spans = [(b, x, y) for x, y in asked for b in touched(x, y)]
                found = found.join(F.broadcast(self.table.sparkSession.createDataFrame(spans, "_of int, _from long, _to long")), (F.col(BAND) == F.col("_of")) & inside, "left_semi")
            else:
                found = found.join(F.broadcast(self.table.sparkSession.createDataFrame(asked, "_from long, _to long")), inside, "left_semi")
        return found.drop(BAND)

    def among(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in ``keys``, a written table with one column of the key's name. A few keys go into the filter, of more the bands do."""
        few = [r[0] for r in keys.limit(MOST_INTERVALS + 1).collect()]
        if len(few) <= MOST_INTERVALS:
            return self.between([(k, k) for k in few])
        bands = [r[0] for r in keys.select(F.shiftright(F.col(self.key).cast("long"), self.shift).alias("b")).distinct().limit(MOST_BANDS + 1).collect()]
        return self.table.where(F.col(BAND).isin(bands)).join(small(keys.distinct()), self.key, "left_semi").drop(BAND)


def write_clustered(df: DataFrame, path: str, key: str, largest: int, rows: int, order: tuple[str, ...] = (), band_rows: int = BAND_ROWS) -> Clustered:
    """``df``, of about ``rows`` rows with keys up to ``largest``, clustered by ``key`` and then ``order``. Rows are dealt by ranges of both, so that a
    key of many rows is spread over tasks."""
    bands = max(1, min(MOST_BANDS, -(-rows // band_rows)))
    shift = max(0, (largest // bands).bit_length())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    banded = df.withColumn(BAND, F.shiftright(F.col(key).cast("long"), shift).cast("int"))
    banded.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).write.option("parquet.block.size", GROUP_BYTES).partitionBy(BAND).parquet(path)
    return open_clustered(df.sparkSession, path, df, key, shift)


def open_clustered(spark: SparkSession, path: str, like: DataFrame, key: str, shift: int) -> Clustered:
    """A table written before, of the columns of ``like``."""
    return Clustered(spark.read.schema(like.withColumn(BAND, F.lit(0)).schema).parquet(path), key, shift)


def files_read(df: DataFrame) -> tuple[int, int]:
    """Files that the scans of a collected query without shuffles opened, and the rows that they gave on: what pruning left."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves, files, rows = plan.collectLeaves(), 0, 0
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        for name in ("numFiles", "numOutputRows"):
            value = metrics.get(name)
            n = value.get().value() if value.isDefined() else 0
            files, rows = (files + n, rows) if name == "numFiles" else (files, rows + n)
    return files, rows
