"""Bounded samples to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WIDTH = 1 << 40


def bounded_sample(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows, never above 1.25 times that: those whose hash of ``keys`` lies below a bound set from the number of rows. Each task
    sends what it has of them and nothing is sorted. All rows if there are no more than ``most``."""
    n = rows.count()
    if n <= most:
        return rows
    hashed = F.pmod(F.xxhash64(*keys), F.lit(_WIDTH))
    return rows.where(hashed < F.lit(_WIDTH * most // n)).limit(most + most // 4)


def bounded_by_class(rows: DataFrame, most: int, least: int, classes: int, by: str, *keys: str) -> DataFrame:
    """``bounded_sample`` with a bound for each value of ``by`` (not null) from its own number of rows: about its share of ``most``, and about
    ``least`` rows where that is fewer. Rows with equal keys are taken together or not at all. Of more than ``classes`` values those with the
    most rows count, so the sample and what is counted on the driver are bounded however many values there are."""
    found = rows.groupBy(by).count().orderBy(F.desc("count"), by).limit(classes + 1).collect()
    counts = {r[by]: r["count"] for r in found[:classes]}
    if len(found) > classes:
        rows = rows.where(F.col(by).isin(list(counts)))
    n = sum(counts.values())
    if n <= most:
        return rows
    bounds = {c: min(_WIDTH, max(_WIDTH * most // n, _WIDTH * least // k)) for c, k in counts.items()}
    expected = sum(k * bounds[c] for c, k in counts.items()) // _WIDTH + 1
    rare = {c: b for c, b in bounds.items() if b > _WIDTH * most // n}
    bound = F.lit(_WIDTH * most // n)
    if rare:
        bound = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in rare.items() for x in pair)), F.col(by)), bound)
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(_WIDTH)) < bound).limit(expected + expected // 4 + least)
