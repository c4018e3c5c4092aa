"""Time-bucket roll-ups and their incremental refresh."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SENSORS = ["temperature", "vibration", "pressure"]


def sensor_value(sensor: str, column: str = "readings") -> Column:
    """A map entry as a number, null when the sensor is absent."""
    return F.try_element_at(F.col(column), F.lit(sensor)).cast("double")


def bucket_rollup(
    df: DataFrame,
    bucket: str,
    values: dict[str, Column],
    *,
    time: str = "recorded_at",
    keys: list[str] = ["machine_id"],
    extremes: list[str] = [],
) -> DataFrame:
    """Averages per machine and bucket, plus min / max of the ``extremes`` names.

    ``values`` maps output names to value columns. Works on batch and streams.
    """
    aggs = [F.avg(v).alias(f"avg_{n}") for n, v in values.items()]
    for n in extremes:
        aggs += [F.min(values[n]).alias(f"min_{n}"), F.max(values[n]).alias(f"max_{n}")]
    return (
        df.groupBy(F.window(time, bucket).alias("_w"), *keys)
        .agg(*aggs, F.count("*").alias("reading_count"))
        .withColumn("bucket", F.col("_w.start"))
        .drop("_w")
    )


def rollup_readings(
    df: DataFrame, bucket: str, sensors: list[str] = DEFAULT_SENSORS, extremes: list[str] = []
) -> DataFrame:
    return bucket_rollup(df, bucket, {s: sensor_value(s) for s in sensors}, extremes=extremes)


def refresh_range(
    as_of: datetime, start_offset: timedelta, end_offset: timedelta, bucket: timedelta
) -> tuple[datetime, datetime]:
    """Whole buckets inside ``[as_of - start_offset, as_of - end_offset)``."""
    epoch = datetime(1970, 1, 1, tzinfo=as_of.tzinfo)

    def up(t: datetime) -> datetime:
        return epoch + -(-(t - epoch) // bucket) * bucket

    def down(t: datetime) -> datetime:
        return epoch + (t - epoch) // bucket * bucket

    return up(as_of - start_offset), down(as_of - end_offset)


def refreshed_rollup(
    materialized: DataFrame, recomputed: DataFrame, start: datetime, end: datetime
) -> DataFrame:
    """Stored buckets outside the range together with the recomputed ones inside."""
    inside = (F.col("bucket") >= F.lit(start)) & (F.col("bucket") < F.lit(end))
    return materialized.where(~inside).unionByName(recomputed.where(inside))
