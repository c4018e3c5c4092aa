"""Partitioned parquet tables: day layout, range reads, retention, keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "event_day"
# Days kept per table.
RETENTION_DAYS = {"sensor_readings": 90, "computed_features": 90, "model_predictions": 365}
# Partition length in days per table.
CHUNK_DAYS = {
    "sensor_readings": 1,
    "computed_features": 1,
    "feature_snapshots": 7,
    "model_predictions": 1,
}
_SALTS = 32  # writers per partition value, so a hot day is no single task


def day_of(time: Column, chunk_days: int = 1) -> Column:
    """First day of the time's chunk."""
    day = F.to_date(time)
    if chunk_days == 1:
        return day
    return F.date_sub(day, F.pmod(F.unix_date(day), F.lit(chunk_days)).cast("int"))


def write_by_day(
    df: DataFrame, path: str, time: str, *, mode: str = "append", chunk_days: int = 1
) -> None:
    """Appends rows under ``event_day=...``; rows of a day spread over several writers."""
    _dealt_by_day(df, time, chunk_days).write.mode(mode).partitionBy(DAY).parquet(path)


def _dealt_by_day(df: DataFrame, time: str, chunk_days: int) -> DataFrame:
    out = df.withColumn(DAY, day_of(F.col(time), chunk_days))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in _hashable(df)]), F.lit(_SALTS))
    return out.repartition(DAY, salt)


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def overwrite_days(df: DataFrame, path: str, time: str, chunk_days: int = 1) -> None:
    """Replaces just the days present in ``df``, so a repeated run leaves the same rows."""
    (
        _dealt_by_day(df, time, chunk_days)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )


def read_range(
    spark: SparkSession,
    path: str,
    time: str,
    start: str | None = None,
    end: str | None = None,
    machines: list[str] | None = None,
    chunk_days: int = 1,
) -> DataFrame:
    """Inclusive time range; the day condition is derived here, so days are pruned."""
    out = spark.read.parquet(path)
    if start is not None:
        low = F.lit(start).cast("timestamp")
        out = out.where((F.col(time) >= low) & (F.col(DAY) >= day_of(low, chunk_days)))
    if end is not None:
        high = F.lit(end).cast("timestamp")
        out = out.where((F.col(time) <= high) & (F.col(DAY) <= day_of(high, chunk_days)))
    if machines:
        out = out.where(F.col("machine_id").isin(list(machines)))
    return out.drop(DAY)


def extract_window(
    spark: SparkSession, path: str, start: str, end: str, machines: list[str] | None = None
) -> DataFrame:
    """Feature rows of a time range in time order per machine; empty ranges are refused."""
    out = read_range(spark, path, "computed_at", start, end, machines)
    if out.isEmpty():
        raise ValueError(f"no features between {start} and {end}")
    return out


def machine_cycles(
    spark: SparkSession, path: str, start: str, end: str, machines: list[str] | None = None
) -> DataFrame:
    """(machine_id, recorded_at, cycle) where a cycle is known, all machines in one scan."""
    out = read_range(spark, path, "recorded_at", start, end, machines)
    return out.where(F.col("cycle").isNotNull()).select("machine_id", "recorded_at", "cycle")


def expired_days(df: DataFrame, as_of: str, keep_days: int) -> Column:
    return F.col(DAY) < F.date_sub(F.lit(as_of).cast("date"), keep_days)


def apply_retention(spark: SparkSession, path: str, as_of: str, keep_days: int) -> int:
    """Deletes the day folders older than ``keep_days`` before ``as_of``; returns how many.

    Whole partitions go through the file system, no row is read or rewritten.
    Partition values come from the file listing, one per stored day.
    """
    stored = spark.read.parquet(path)
    days = [r[DAY] for r in stored.where(expired_days(stored, as_of, keep_days)).select(DAY).distinct().collect()]
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for day in days:
        fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"{DAY}={day}"), True)
    return len(days)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows, one per key, whose key is not stored yet."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def latest_by_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write per key of an append-only log: the read side of an upsert."""
    rest = [c for c in log.columns if c not in keys]
    return (
        log.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, "_r.*")
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
