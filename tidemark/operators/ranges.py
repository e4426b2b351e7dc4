"""Rows dealt out by ranges of a column, the same in every job that reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWN = 32


def cuts(rows: DataFrame, column: str, size: int) -> list:
    """Values that cut the rows into ranges of about `size`, drawn by hash, DRAWN for each range: where ranges end depends on
    what is drawn, what is in them does not."""
    n = rows.count() // size
    if not n:
        return []
    known = rows.where(F.col(column).isNotNull()).select(column)
    drawn = sorted(r[0] for r in known.orderBy(F.xxhash64(column)).limit(DRAWN * (n + 1)).collect())
    return sorted(set(drawn[DRAWN::DRAWN]))


def range_of(value: Column, edges: list) -> Column:
    """The number of edges that are not above the value (null: 0), by binary search."""
    if not edges:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    known = F.array(*map(F.lit, edges))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step - 1) <= value, at + step).otherwise(at))
