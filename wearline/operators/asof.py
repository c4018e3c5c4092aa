"""Backward as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.operators.slices import AUTO, Running, running


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    left_on: str,
    right_on: str,
    take: list[str],
    right_ties: list[str] = [],
    slice_length: int | None | str = AUTO,
    store: bool = False,
) -> DataFrame:
    """Each left row takes the latest right row at or before its time, nulls if none.

    Both sides are stacked and scanned once in time order, so no row pairs are
    built. Among right rows of one time the last by ``right_ties`` wins. A right
    row without a time or a key matches nothing. ``store`` is for costly inputs,
    see ``slices.running``.
    """
    right = right.dropna("any", subset=[right_on, *by])
    payload = F.struct(*take)
    ties = [f"_t{i}" for i in range(len(right_ties))]
    kept = left.columns
    left_side = left.select(
        *[F.col(k) for k in by],
        F.col(left_on).alias("_at"),
        F.lit(1).alias("_side"),
        *[F.lit(None).cast(right.schema[t].dataType).alias(n) for t, n in zip(right_ties, ties)],
        F.struct(*kept).alias("_left"),
        F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"),
    )
    right_side = right.select(
        *[F.col(k) for k in by],
        F.col(right_on).alias("_at"),
        F.lit(0).alias("_side"),
        *[F.col(t).alias(n) for t, n in zip(right_ties, ties)],
        F.lit(None).cast(left_side.schema["_left"].dataType).alias("_left"),
        payload.alias("_right"),
    )
    merged = running(
        left_side.unionByName(right_side),
        by,
        ["_at", "_side", *ties],
        [Running("_hit", "last", F.col("_right"))],
        slice_length=slice_length,
        store=store,
    )
    return merged.where(F.col("_side") == 1).select(
        "_left.*", *[F.col(f"_hit.{c}").alias(c) for c in take]
    )
