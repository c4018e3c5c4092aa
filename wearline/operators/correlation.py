"""Pairwise Pearson correlation inside rolling windows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.operators import moving
from wearline.operators.slices import AUTO, resolve

CONSTANT_BELOW = 1e-12  # a deviation below this counts as a constant signal


def sensor_pairs(sensors: list[str]) -> list[tuple[str, str]]:
    """All unordered pairs of the list, names sorted."""
    return list(combinations(sorted(sensors), 2))


def rolling_pearson(
    df: DataFrame,
    sensors: list[str],
    window_s: int,
    *,
    keys: list[str] = ["machine_id"],
    order: str = "recorded_at",
    min_samples: int = 10,
    aligned: bool = False,
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """Adds ``{a}_x_{b}_pearson`` per pair of the wide sensor columns.

    Null when a pair has fewer than ``min_samples`` rows with both values, or
    when either signal is constant. ``aligned`` promises that every row carries
    all sensors, so no row has to be left out of a pair. Work per row grows with
    the logarithm of the frame only (``moving``).
    """
    if min_samples < 2:
        raise ValueError(f"min_samples must be at least 2, got {min_samples}")
    return moving.moving_pearson(
        df,
        sensor_pairs(sensors),
        window_s,
        keys=keys,
        order=order,
        min_samples=min_samples,
        constant_below=CONSTANT_BELOW,
        aligned=aligned,
        length=resolve(df, keys, order, slice_length),
    )


def _bound(value: Column, of) -> Column:
    """``of(value)``, with ``value`` computed once however often ``of`` uses it."""
    return F.get(F.transform(F.array(value), of), 0)


def array_pearson(a: Column, b: Column, min_samples: int = 10) -> Column:
    """Pearson of two sample arrays, the longer one cut from its oldest end; work in proportion to their length."""
    n = F.least(F.size(a), F.size(b))

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / n

    def of_means(cut: Column, at: Column) -> Column:
        off = F.struct(
            mean(F.transform(cut["a"], lambda x: (x - at["a"]) * (x - at["a"]))).alias("a"),
            mean(F.transform(cut["b"], lambda x: (x - at["b"]) * (x - at["b"]))).alias("b"),
            mean(F.zip_with(cut["a"], cut["b"], lambda x, y: (x - at["a"]) * (y - at["b"]))).alias("ab"),
        )
        return _bound(off, of_spread)

    def of_spread(off: Column) -> Column:
        spread_a, spread_b = F.sqrt(off["a"]), F.sqrt(off["b"])
        usable = (spread_a >= CONSTANT_BELOW) & (spread_b >= CONSTANT_BELOW)
        return F.when(usable, F.try_divide(off["ab"], spread_a * spread_b))

    def of_cut(cut: Column) -> Column:
        return _bound(F.struct(mean(cut["a"]).alias("a"), mean(cut["b"]).alias("b")), lambda at: of_means(cut, at))

    cut = F.struct(F.slice(a, -n, n).alias("a"), F.slice(b, -n, n).alias("b"))
    return F.when(n >= min_samples, _bound(cut, of_cut))


def pair_rows(df: DataFrame, by: list[str], sensor: str = "sensor", value: str = "value") -> DataFrame:
    """One row per sensor pair ``a < b`` present in the same ``by`` group.

    Expects one row per ``(by, sensor)``. The group is first gathered into one
    map of sensor to value (sensors of one machine at one time, a bounded
    vocabulary), then pairs are formed inside the row, so nothing is joined.
    """
    gathered = df.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(F.col(sensor).alias("s"), F.col(value).alias("v")))).alias("_g")
    )
    firsts = gathered.select(*by, "_g", F.posexplode("_g").alias("_i", "_a"))
    rest = F.slice(F.col("_g"), F.col("_i") + 2, F.size("_g"))
    return firsts.select(*by, "_a", F.explode(rest).alias("_b")).select(
        *by,
        F.col("_a.s").alias("sensor_a"),
        F.col("_b.s").alias("sensor_b"),
        F.col("_a.v").alias("value_a"),
        F.col("_b.v").alias("value_b"),
    )
