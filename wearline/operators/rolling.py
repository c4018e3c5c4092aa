"""Rolling and cumulative statistics over long readings.

Long form is one row per ``(machine_id, sensor, recorded_at)``. A frame is
closed on both ends, ``[t - w, t]``, and covers rows sharing the same time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators import moving
from wearline.operators.slices import (
    AUTO,
    HOME,
    SLICE,
    Running,
    axis,
    resolve,
    running,
    with_lookback,
)

KEYS = ["machine_id", "sensor"]
STATS = ["mean", "std", "min", "max", "median", "rms", "range", "rate_of_change"]
MICROS = 1_000_000


def _frame(keys: list[str], window_s: int) -> Window:
    return (
        Window.partitionBy(*keys, SLICE)
        .orderBy("_at")
        .rangeBetween(-window_s * MICROS, Window.currentRow)
    )


def rolling_stats(
    df: DataFrame,
    windows_s: list[int],
    *,
    keys: list[str] = KEYS,
    order: list[str] = ["recorded_at"],
    value: str = "value",
    stats: list[str] = STATS,
    min_rows: int = 2,
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """One row per reading and window size, with ``window_s``, ``n`` and the statistics.

    One shuffle and one sort; work per row does not grow with the window
    (``moving``). Rows whose frame holds fewer than ``min_rows`` samples are not
    emitted. Null values do not count; rows without a time share a frame.
    """
    return moving.moving_statistics(
        df,
        windows_s,
        stats,
        keys=keys,
        order=order,
        value=value,
        min_rows=min_rows,
        length=resolve(df, keys, order[0], slice_length),
    )


def rolling_capped(
    df: DataFrame,
    window_s: int,
    rate_hz: float,
    *,
    keys: list[str] = KEYS,
    order: list[str] = ["recorded_at"],
    value: str = "value",
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """Window samples limited to the newest ``max(2, int(w * rate * 2))``, as an array.

    The cap is the operator's own definition (a bounded sample buffer); a row
    frame bounds the array, a time test trims it to the window.
    """
    cap = max(2, int(window_s * rate_hz * 2))
    length = resolve(df, keys, order[0], slice_length)
    base = with_lookback(df, order[0], length, window_s * MICROS).withColumn(
        "_at", axis(df, order[0])
    )
    newest = Window.partitionBy(*keys, SLICE).orderBy("_at", *order[1:]).rowsBetween(1 - cap, 0)
    pairs = F.collect_list(F.struct("_at", F.col(value).alias("v"))).over(newest)
    return (
        base.withColumn("_pairs", pairs)
        .where(F.col(SLICE) == F.col(HOME))
        .withColumn("_floor", F.col("_at") - F.lit(window_s * MICROS))
        .withColumn("_kept", F.filter("_pairs", lambda p: p["_at"] >= F.col("_floor")))
        .select(*df.columns, F.transform("_kept", lambda p: p["v"]).alias("samples"))
    )


def window_samples(
    df: DataFrame,
    window_s: int,
    *,
    keys: list[str] = KEYS,
    order: list[str] = ["recorded_at"],
    value: str = "value",
    min_rows: int = 2,
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """Raw samples of each frame, oldest first, for rows with at least ``min_rows``."""
    length = resolve(df, keys, order[0], slice_length)
    base = with_lookback(df, order[0], length, window_s * MICROS).withColumn(
        "_at", axis(df, order[0])
    )
    frame = _frame(keys, window_s)
    # Range frames order by time alone; sorting the pairs fixes ties by the other columns.
    pair = F.struct(F.col("_at"), *[F.col(c) for c in order[1:]], F.col(value).alias("v"))
    return (
        base.withColumn("_pairs", F.array_sort(F.collect_list(pair).over(frame)))
        .where((F.col(SLICE) == F.col(HOME)) & (F.size("_pairs") >= min_rows))
        .select(*df.columns, F.transform("_pairs", lambda p: p["v"]).alias("samples"))
    )


def cumulative_stats(
    df: DataFrame,
    *,
    keys: list[str] = KEYS,
    order: list[str] = ["recorded_at"],
    value: str = "value",
    slice_length: int | None | str = AUTO,
    store: bool = False,
) -> DataFrame:
    """Mean and maximum since the start of the key."""
    v = F.col(value)
    out = running(
        df,
        keys,
        order,
        [Running("_n", "count", v), Running("_s", "sum", v), Running("cumulative_max", "max", v)],
        slice_length=slice_length,
        store=store,
    )
    return out.select(
        *df.columns, (F.col("_s") / F.col("_n")).alias("cumulative_mean"), "cumulative_max"
    )


def with_segment(
    df: DataFrame,
    reset: Column,
    *,
    keys: list[str] = ["machine_id"],
    order: list[str] = ["recorded_at"],
    name: str = "segment_id",
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """Numbers the stretches between resets; add the name to the keys of later operators.

    A row where ``reset`` holds opens the next segment.
    """
    flag = F.when(reset, F.lit(1)).otherwise(F.lit(0))
    return running(df, keys, order, [Running(name, "sum", flag)], slice_length=slice_length)


def named_features(stats_df: DataFrame, stats: list[str] = STATS) -> DataFrame:
    """Statistics as one row per feature name, ``{sensor}_{window}s_{stat}``."""
    entries = F.array(
        *[
            F.struct(
                F.concat_ws("_", "sensor", F.concat(F.col("window_s").cast("string"), F.lit("s")), F.lit(s)).alias("name"),
                F.col(s).cast("double").alias("feature"),
            )
            for s in stats
        ]
    )
    others = [c for c in stats_df.columns if c not in {*stats, "value", "sensor", "n"}]
    return stats_df.select(*others, F.inline(entries))


def feature_map(
    named: DataFrame, by: list[str], name: str = "temporal"
) -> DataFrame:
    """Collects feature rows of one reading and window into a map column.

    A group holds the features of one reading: sensors times statistics.
    """
    return named.groupBy(*by).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("name"), F.col("feature"))))
        ).alias(name)
    )
