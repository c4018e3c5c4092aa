"""Feature maps to columns, scaling, and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.operators.lookups import join_null_safe, sized

GROUPS = ["temporal", "spectral", "correlation"]
_COLUMN_LIMIT = 20_000  # names collected to the driver when maps become columns


def _as_map(column: Column) -> Column:
    return F.coalesce(column, F.create_map().cast("map<string,double>"))


def merge_maps(groups: list[str] = GROUPS) -> Column:
    """One map of all groups; a later group wins on equal names.

    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``, which ``session.prepare`` sets.
    """
    return F.map_concat(*[_as_map(F.col(g)) for g in groups])


def prefixed_map(groups: list[str] = GROUPS) -> Column:
    """One map with names ``{group}__{name}``."""

    def prefixed(group: str) -> Column:
        return F.transform_keys(_as_map(F.col(group)), lambda k, v: F.concat(F.lit(f"{group}__"), k))

    return F.map_concat(*[prefixed(g) for g in groups])


def map_names(df: DataFrame, column: str, limit: int = _COLUMN_LIMIT) -> list[str]:
    """Sorted distinct keys of a map column; an error beyond ``limit`` distinct names."""
    rows = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} names in {column}; keep the map form")
    return sorted(r["k"] for r in rows)


def map_to_columns(df: DataFrame, column: str, names: list[str] | None = None) -> DataFrame:
    """One double column per name; absent names are null."""
    wanted = map_names(df, column) if names is None else names
    return df.select(
        *[c for c in df.columns if c != column],
        *[F.try_element_at(F.col(column), F.lit(n)).cast("double").alias(n) for n in wanted],
    )


def flatten_features(
    df: DataFrame, groups: list[str] = GROUPS, names: list[str] | None = None
) -> DataFrame:
    """Feature rows with three maps to wide rows with prefixed columns."""
    wide = df.withColumn("_all", prefixed_map(groups)).drop(*groups)
    return map_to_columns(wide, "_all", names)


def drop_sensors(column: str, names: list[str]) -> Column:
    """Map without the listed sensors."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.map_filter(column, lambda k, v: ~F.array_contains(listed, k))


def impute(df: DataFrame, features: list[str], label: str = "health_label") -> DataFrame:
    """Missing features and remaining life become 0, a missing label ``healthy``."""
    out = df.na.fill(0, subset=[c for c in [*features, "rul_cycles"] if c in df.columns])
    if label in df.columns:
        out = out.na.fill("healthy", subset=[label])
    return out


def minmax_scale(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] per group; a constant column becomes 0.0."""
    bounds = df.groupBy(*by).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns],
        *[F.max(c).alias(f"_hi_{c}") for c in columns],
    )
    joined = join_null_safe(df, sized(bounds), by)
    scaled = {}
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        scaled[c] = F.when(span > 0, (F.col(c) - F.col(f"_lo_{c}")) / span).otherwise(F.lit(0.0))
    return joined.withColumns(scaled).select(*df.columns)


def zscore_fit(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, one aggregate row."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


def zscore_apply(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    guard = 1e-8
    return df.withColumns(
        {c: (F.col(c) - F.lit(m)) / (F.lit(s) + F.lit(guard)) for c, (m, s) in fitted.items()}
    )


def wide_to_long(df: DataFrame, sensors: list[str], keep: list[str]) -> DataFrame:
    """One row per sensor column that holds a value."""
    entries = F.array(
        *[F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("value")) for s in sensors]
    )
    return df.select(*keep, F.inline(entries)).where(F.col("value").isNotNull())


def readings_to_long(df: DataFrame, keep: list[str], column: str = "readings") -> DataFrame:
    return df.select(*keep, F.explode(column).alias("sensor", "value"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name of the frames given, missing columns as nulls."""
    if not frames:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
