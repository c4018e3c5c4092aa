"""Offline dataset job: features, cycles, labels, split, snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.operators.asof import asof_backward
from wearline.operators.assemble import flatten_features
from wearline.operators.columns import feature_columns
from wearline.operators.labels import HEALTH_THRESHOLDS, RUL_CAP, assign_health, assign_rul
from wearline.operators.splits import machine_split, with_split
from wearline.sources import snapshots, tables


def with_cycles(
    features: DataFrame, cycles: DataFrame, ties: list[str] = [], store: bool = False
) -> DataFrame:
    """Latest cycle at or before each feature row; rows before any cycle are dropped."""
    lookup = cycles.withColumnRenamed("recorded_at", "_cycle_at")
    joined = asof_backward(
        features,
        lookup,
        by=["machine_id"],
        left_on="computed_at",
        right_on="_cycle_at",
        take=["cycle"],
        right_ties=ties,
        store=store,
    )
    return joined.dropna(subset=["cycle"]).withColumn("cycle", F.col("cycle").cast("int"))


def build_dataset(
    features: DataFrame,
    cycles: DataFrame,
    *,
    train: float = 0.7,
    validation: float = 0.15,
    cap: int = RUL_CAP,
    thresholds: dict[str, float] = HEALTH_THRESHOLDS,
    ties: list[str] = [],
    store: bool = False,
) -> DataFrame:
    """Labelled rows with their split; ``store`` is for derived inputs, see ``slices.running``."""
    merged = with_cycles(features, cycles, ties, store)
    labelled = assign_health(assign_rul(merged, cap), thresholds)
    return with_split(labelled, machine_split(merged.select("machine_id"), train, validation))


def run(
    spark: SparkSession,
    features_path: str,
    readings_path: str,
    snapshot_path: str,
    version: str,
    start: str,
    end: str,
    snapshot_at: str,
    machines: list[str] | None = None,
) -> DataFrame:
    """Reads a time range, builds the dataset and saves it as a snapshot version."""
    features = flatten_features(tables.extract_window(spark, features_path, start, end, machines))
    cycles = tables.machine_cycles(spark, readings_path, start, end, machines)
    data = build_dataset(features, cycles)
    names = [c for c in feature_columns(data) if "__" in c]
    snapshots.save_snapshot(data, snapshot_path, version, names, snapshot_at)
    return data
