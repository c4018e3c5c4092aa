"""Joins against small derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000


def sized(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` as a broadcast of its computed rows when at most ``limit`` of them exist.

    The rows are computed once, at most ``limit + 1`` reach the driver, and the
    large side of the join then needs no shuffle. A larger table is returned as
    it is, and the join shuffles both sides under adaptive execution.
    """
    rows = small.limit(limit + 1).collect()
    if len(rows) > limit:
        return small
    return F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null keys match each other; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_n_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(renamed[f"_n_{k}"])
    return left.join(renamed, match, how).drop(*[f"_n_{k}" for k in keys])
