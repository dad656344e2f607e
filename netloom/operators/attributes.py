"""Attribute tables joined onto nodes: join report, profiles, filters, histograms, styles."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import isfinite

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import styling

BINS, TOP, CATEGORIES = 24, 12, 3
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header as a table for ``attach``; types are inferred from all rows. A field in quotes may hold doubled quotes."""
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"')


def visible_edges(edges: DataFrame, styled: DataFrame) -> DataFrame:
    """``edges`` (src, dst, ...) that a style (idx, visible) shows: those both of whose ends are visible."""
    shown = styled.where("visible").select("idx")
    return edges.join(shown.select(F.col("idx").alias("src")), "src", "left_semi").join(shown.select(F.col("idx").alias("dst")), "dst", "left_semi")


@dataclass(frozen=True)
class Range:
    column: str
    low: float
    high: float

    def where(self) -> Column:
        """Inclusive; no filter at all if a bound isn't finite; null is outside."""
        return F.col(self.column).cast("double").between(self.low, self.high) if isfinite(self.low) and isfinite(self.high) else F.lit(True)


@dataclass(frozen=True)
class OneOf:
    column: str
    values: tuple[str, ...]

    def where(self) -> Column:
        return F.col(self.column).cast("string").isin(*self.values) if self.values else F.lit(False)


Filter = Range | OneOf


def all_of(filters: list[Filter]) -> Column:
    return reduce(lambda a, b: a & b, (f.where() for f in filters), F.lit(True))


@dataclass
class Style:
    """What to show: a column by colour, one by size, and the filters."""

    colour: str | None = None
    size: str | None = None
    filters: list[Filter] = field(default_factory=list)


class Attributes:
    """``nodes`` (idx, id, degree) and, once attached, a table whose ``key`` column holds ids."""

    def __init__(self, nodes: DataFrame):
        self.nodes, self.table, self.key, self.order = nodes.select("idx", "id", "degree"), None, None, None
        self.joined = self.nodes.drop("id")
        self.columns = ["degree"]

    def attach(self, table: DataFrame, key: str | None = None, order: list[str] | None = None) -> Attributes:
        """Joins the table's row for each id onto its node; of several the first by ``order`` (all columns by default). An unknown key
        column means the first. A column named as one of the nodes' gets a number, as SQL engines do. Names are told apart by case alone."""
        self.table, self.key = table, key if key in table.columns else table.columns[0]
        self.order = order or table.columns
        self.joined = self._joined()
        self.columns = [c for c in self.joined.columns if c != "idx"]
        return self

    def _joined(self) -> DataFrame:
        """A row of the table travels as one struct, so no name of its columns can clash with those of the join; the first row of an id is the least by
        ``order``, found by partial minima and without sorting an id's rows."""
        columns = [c for c in self.table.columns if c != self.key]
        field = lambda c: F.col("`" + c.replace("`", "``") + "`")
        each = self.table.select(field(self.key).cast("string").alias("key"), F.struct(*map(field, self.order)).alias("order"), F.struct(F.lit(0).alias("_"), *map(field, columns)).alias("row"))
        first = each.where("key is not null").groupBy("key").agg(F.min_by("row", "order").alias("row"))
        taken, names = {"idx", "id", "degree"}, []
        for c in columns:
            name, n = c, 0
            while name.lower() in taken or n and name in columns:
                n += 1
                name = f"{c}_{n}"
            taken.add(name.lower() if name.lower() in ("idx", "id", "degree") or n else "idx")
            names.append(name)
        joined = self.nodes.join(first, F.col("id") == F.col("key"), "left")
        return joined.select("idx", "degree", *(F.col("row").getField(c).alias(n) for c, n in zip(columns, names, strict=True)))

    def report(self) -> DataFrame:
        """rows, matched nodes, unmatched rows (null keys too), duplicates (rows without distinct keys, null ones too)."""
        keys = self.table.select(F.col(self.key).cast("string").alias("id"))
        each = keys.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(self.nodes.select("id", F.lit(True).alias("known")), "id", "left")
        return each.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count_if(F.col("known")).alias("matched"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unmatched"),
            (F.coalesce(F.sum("n"), F.lit(0)) - F.count("id")).alias("duplicates"),
        )

    def numeric(self, column: str) -> bool:
        return isinstance(self.joined.schema[column].dataType, _NUMERIC)

    def profile_numeric(self) -> DataFrame:
        """column, low, high, nulls of all numeric columns in one pass; low and high are 0 where all are null."""
        names = [c for c in self.columns if self.numeric(c)]
        whole = self.joined.agg(*(x for i, c in enumerate(names) for v in [F.col(c).cast("double")] for x in (F.coalesce(F.min(v), F.lit(0.0)).alias(f"l{i}"), F.coalesce(F.max(v), F.lit(0.0)).alias(f"h{i}"), F.count_if(v.isNull()).alias(f"n{i}"))))
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(names))))
        return whole.select(rows.alias("r")).select("r.*")

    def profile_categorical(self) -> DataFrame:
        """column, distinct, nulls of the others, from one unpivot."""
        return self._values().groupBy("column").agg(F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))

    def _values(self) -> DataFrame:
        names = [c for c in self.columns if not self.numeric(c)]
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names)))
        return self.joined.select(each.alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("n"))

    def top_values(self, column: str, limit: int = TOP) -> DataFrame:
        """value, n: the most frequent, ties by value."""
        counts = self.joined.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return counts.orderBy(F.desc("n"), "value").limit(limit)

    def span(self, column: str) -> tuple[float, float]:
        v = F.col(column).cast("double")
        row = self.joined.agg(F.min(v), F.max(v)).first()
        return (0.0, 0.0) if row[0] is None else (row[0], row[1])

    def histogram(self, column: str, bins: int = BINS) -> DataFrame:
        """bin, n for bins of equal width, empty ones too; all 0 where there is no width, nothing for a column that isn't numeric."""
        empty = self.joined.sparkSession.range(bins if self.numeric(column) else 0).select(F.col("id").alias("bin"))
        if not self.numeric(column):
            return empty.withColumn("n", F.lit(0).cast("long"))
        low, high = self.span(column)
        if not high > low:
            return empty.withColumn("n", F.lit(0).cast("long"))
        v = F.col(column).cast("double")
        counts = self.joined.where(v.isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor((v - low) / ((high - low) / bins))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        return empty.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))

    def matching(self, filters: list[Filter]) -> DataFrame:
        return self.joined.where(all_of(filters)).select("idx")

    def card(self, idx: int) -> DataFrame:
        return self.joined.where(F.col("idx") == idx).drop("idx").limit(1)

    def styled(self, style: Style) -> DataFrame:
        """idx, c, s, style, visible: c is the place on the ramp or the slot of a category, s the place by size, style both in one number.
        What the filters drop is hidden."""
        rows, visible = self.joined, all_of(style.filters)
        if style.colour is None:
            c, colour = F.lit(-1.0), F.lit(styling.rgb(styling.NEUTRAL))
        elif self.numeric(style.colour):
            c = styling.unit(F.col(style.colour), *self.span(style.colour))
            colour = styling.sequential(c)
        else:
            place = styling.slot(F.col(style.colour), [r["value"] for r in self.top_values(style.colour, CATEGORIES).collect()])
            c, colour = place.cast("double"), styling.category(place)
        s = F.lit(-1.0) if style.size is None else styling.unit(F.col(style.size), *self.span(style.size))
        rows = rows.select("idx", c.alias("c"), s.alias("s"), colour.alias("colour"), F.coalesce(visible, F.lit(False)).alias("visible"))
        size = F.when(F.col("visible"), styling.size_code(F.col("s"))).otherwise(styling.HIDDEN_SIZE)
        return rows.select("idx", "c", "s", styling.packed(F.col("colour"), size).alias("style"), "visible")

    def legend(self, column: str) -> DataFrame:
        """slot, value, hex, n: the categories shown, and slot 0 for all others together."""
        counts = self.joined.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        top = counts.orderBy(F.desc("n"), "value").limit(CATEGORIES)
        rank = F.row_number().over(Window.orderBy(F.desc("n"), "value"))  # of CATEGORIES rows
        shown = top.select(rank.alias("slot"), "value", "n")
        colours = F.array(*(F.lit(c) for c in styling.CATEGORICAL))
        shown = shown.select("slot", "value", F.element_at(colours, F.col("slot")).alias("hex"), "n")
        others = counts.join(F.broadcast(top.select("value")), "value", "left_anti").agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        other = others.where("values > 0").select(F.lit(0).alias("slot"), F.concat(F.lit("other ("), F.col("values").cast("string"), F.lit(" more values)")).alias("value"), F.lit(styling.NEUTRAL).alias("hex"), "n")
        return shown.union(other)
