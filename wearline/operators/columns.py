"""Schema checks and column selectors made on the driver, before planning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Snapshot columns that are not model inputs.
SNAPSHOT_METADATA = {
    "machine_id",
    "snapshot_at",
    "computed_at",
    "window_s",
    "feature_version",
    "rul_cycles",
    "health_label",
    "dataset_version",
    "split",
    "cycle",
}


def require(df: DataFrame, names: Iterable[str]) -> None:
    """Refuse a frame lacking any of ``names``; the message lists them sorted."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def feature_columns(df: DataFrame, metadata: Iterable[str] = SNAPSHOT_METADATA) -> list[str]:
    """All columns that are not metadata, sorted."""
    return sorted(set(df.columns) - set(metadata))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ("machine_id",)) -> list[str]:
    """Numeric columns other than identifiers, in frame order."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
