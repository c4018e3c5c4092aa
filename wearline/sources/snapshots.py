"""Versioned training snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.operators.assemble import map_to_columns
from wearline.operators.columns import require
from wearline.schemas import HEALTH_LABELS, SPLITS


def save_snapshot(
    df: DataFrame,
    path: str,
    version: str,
    features: list[str],
    snapshot_at: str,
    keep: list[str] = [],
) -> None:
    """Writes labelled rows of ``version``, partitioned by version and split; a repeated run replaces its rows.

    ``df`` carries its ``split``; features become one JSON object per row, and
    all rows share the snapshot time.
    """
    require(df, ["machine_id", "rul_cycles", "health_label", "split", *features])
    wrong = (
        ~F.col("split").isin(SPLITS)
        | ~F.col("health_label").isin(HEALTH_LABELS)
        | F.col("rul_cycles").isNull()
        | F.col("health_label").isNull()
    )
    checked = df.withColumn(
        "split",
        F.when(wrong, F.raise_error(F.lit("invalid split or label in snapshot"))).otherwise(F.col("split")),
    )
    rows = checked.select(
        F.lit(snapshot_at).cast("timestamp").alias("snapshot_at"),
        "machine_id",
        *keep,
        F.to_json(F.struct(*features)).alias("feature_vector"),
        "rul_cycles",
        "health_label",
        F.lit(version).alias("dataset_version"),
        "split",
    )
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset_version", "split").parquet(path)


def load_snapshot(
    spark: SparkSession,
    path: str,
    version: str,
    split: str,
    keep: list[str] = [],
    features: list[str] | None = None,
) -> DataFrame:
    """One split of one version with features as columns; unknown or empty is refused."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}, expected one of {SPLITS}")
    rows = spark.read.parquet(path).where(
        (F.col("dataset_version") == version) & (F.col("split") == split)
    )
    if rows.isEmpty():
        raise ValueError(f"snapshot {version} has no {split} rows")
    parsed = rows.select(
        "snapshot_at",
        "machine_id",
        *keep,
        "rul_cycles",
        "health_label",
        "split",
        F.from_json("feature_vector", "map<string,double>").alias("_features"),
    )
    return map_to_columns(parsed, "_features", features)
