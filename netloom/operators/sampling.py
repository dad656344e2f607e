"""Samples that stay samples when cut shorter, and orders of which any beginning is a sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.draws import bits_at
from netloom.functions.permutation import Permutation
from netloom.sources.clustered import Clustered


def sample_edges(edges: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` distinct edges by a hash of a seed and their number; a smaller k gives a beginning of the same. Each task keeps k rows, then one keeps k of these."""
    return edges.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("seq").cast("string"))), "seq").limit(k)


def ranked(rows: DataFrame, size: int, number: str = "seq", seed: int = 42, name: str = "place") -> DataFrame:
    """``rows`` (edges by seq, nodes by idx, numbered 0 .. size - 1) with their place in a random order. Nothing is sorted or moved."""
    return rows.withColumn(name, Permutation(size, seed).place(F.col(number)))


def first_places(stored: Clustered, size: int, k: int, seed: int = 42, name: str = "place") -> DataFrame:
    """The rows at the first ``k`` places of ``ranked``'s order, with their place: the numbers are computed from the places, and only they are read.
    ``k`` is what a screen draws, a bound set by the caller."""
    places = np.arange(min(k, size))
    numbers = Permutation(size, seed).walked(places.copy(), back=True).tolist()
    drawn = stored.table.sparkSession.createDataFrame(list(zip(places.tolist(), numbers, strict=True)), f"{name} long, {stored.key} long")
    return stored.between([(x, x) for x in numbers]).join(F.broadcast(drawn), stored.key)


def swapped(size: int, k: int, seed: int = 42) -> list[int]:
    """``k`` distinct numbers of 0 .. size - 1 in random order, in time and memory of k: the first k steps of a shuffle, of which only the places that
    were swapped are kept. A smaller k gives a beginning of the same. Step j draws from what is left by 64 bits of draws 2j and 2j + 1."""
    k = min(k, size)
    draws = bits_at(seed, np.arange(2 * k))
    moved: dict[int, int] = {}
    out = []
    for j in range(k):
        at = j + ((int(draws[2 * j]) << 32 | int(draws[2 * j + 1])) * (size - j) >> 64)
        out.append(moved.get(at, at))
        moved[at] = moved.pop(j, j)
    return out


def sample_stored(stored: Clustered, size: int, k: int, seed: int = 42) -> DataFrame:
    """``k`` distinct rows of a table of ``size`` rows clustered by their numbers, with ``draw``, their place in the sample: the numbers come from
    ``swapped``, and of the table only what holds them is read. ``k`` is what a screen draws, a bound set by the caller; the numbers go through the driver."""
    numbers = swapped(size, k, seed)
    drawn = stored.table.sparkSession.createDataFrame(list(enumerate(numbers)), f"draw long, {stored.key} long")
    return stored.between([(x, x) for x in numbers]).join(F.broadcast(drawn), stored.key)
