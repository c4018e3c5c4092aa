"""Dashboard views over predictions, machines and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.operators.rules import severity_rank
from wearline.schemas import LATENCY_BOUNDS_MS, SEVERITIES

TIMES = ("timestamp", "timestamp_ntz")


def latest_per_machine(
    df: DataFrame, order: list[str] = ["predicted_at"], key: str = "machine_id"
) -> DataFrame:
    """Newest row per machine by partial aggregation; no sort, no whole-group task."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("_r")).select(key, "_r.*")


def health_distribution(predictions: DataFrame, order: list[str] = ["predicted_at"]) -> DataFrame:
    latest = latest_per_machine(predictions, order)
    return latest.groupBy("health_label").agg(F.count("*").alias("machines"))


def fleet_overview(
    machines: DataFrame, predictions: DataFrame, order: list[str] = ["predicted_at"]
) -> DataFrame:
    """Every machine with its latest prediction, defaults where there is none."""
    latest = latest_per_machine(predictions, order).select(
        "machine_id", "health_label", "rul_cycles", "rul_hours", "anomaly_score", "predicted_at"
    )
    return machines.join(latest, "machine_id", "left").select(
        "machine_id",
        F.coalesce("machine_type", F.lit("unknown")).alias("machine_type"),
        F.coalesce("health_label", F.lit("healthy")).alias("health_label"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("rul_cycles", "rul_hours", "anomaly_score")],
        "predicted_at",
    )


def fleet_summary(overview: DataFrame) -> DataFrame:
    """Card counts in one pass."""
    label = F.col("health_label")
    return overview.agg(
        F.count("*").alias("total"),
        F.count_if(label.isin("critical", "imminent_failure")).alias("critical"),
        F.count_if(label == "degrading").alias("degrading"),
        F.count_if(label == "healthy").alias("healthy"),
    )


def newest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Top-k report: the ``n`` last rows of the order."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def oldest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def time_range(
    df: DataFrame,
    time: str,
    start: Column | None = None,
    end: Column | None = None,
    machines: list[str] | None = None,
) -> DataFrame:
    """Rows in an inclusive time range, optionally of listed machines."""
    out = df
    if start is not None:
        out = out.where(F.col(time) >= start)
    if end is not None:
        out = out.where(F.col(time) <= end)
    if machines:
        out = out.where(F.col("machine_id").isin(list(machines)))
    return out


def rul_trend(
    predictions: DataFrame, as_of: Column, hours: int, machine_id: str | None = None
) -> DataFrame:
    """Predictions of the last ``hours``, oldest first."""
    since = as_of - F.make_interval(hours=F.lit(hours))
    rows = time_range(predictions, "predicted_at", since, as_of, [machine_id] if machine_id else None)
    return rows.select("machine_id", "predicted_at", "rul_cycles").orderBy("predicted_at", "machine_id")


def equal_width_histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts per equal-width bin over [min, max]; bins without rows included."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).first()
    low, high = bounds["_lo"], bounds["_hi"]
    if low is None:
        return df.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_start"), F.lit(0).alias("n")).limit(0)
    width = (high - low) / bins
    position = F.lit(0) if width == 0 else F.floor((F.col(value) - F.lit(low)) / F.lit(width))
    counts = (
        df.where(F.col(value).isNotNull())
        .select(F.least(position, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def latency_percentiles(df: DataFrame, value: str = "latency_ms", by: list[str] = []) -> DataFrame:
    """Exact p50, p95 and p99; latencies are whole milliseconds, so few values to count."""
    shares = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    out = counts.groupBy(*by).agg(F.percentile(value, shares, F.col("_n")).alias("_p"))
    return out.select(
        *by, *[F.col("_p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))]
    )


def latency_histogram(
    df: DataFrame, value: str = "latency_ms", bounds: list[int] = LATENCY_BOUNDS_MS
) -> DataFrame:
    """Cumulative counts at or below each bound, the last row being unbounded."""
    v = F.col(value)
    sums = df.agg(*[F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(v).alias("all"))
    rows = [
        F.struct(F.lit(float(b)).alias("upper_ms"), F.col(f"b{i}").alias("n"))
        for i, b in enumerate(bounds)
    ]
    rows.append(F.struct(F.lit(float("inf")).alias("upper_ms"), F.col("all").alias("n")))
    return sums.select(F.inline(F.array(*rows)))


def incident_filter(
    incidents: DataFrame,
    machine_id: str | None = None,
    status: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Conjunction of the filters given."""
    out = incidents
    for name, wanted in (("machine_id", machine_id), ("status", status), ("severity", severity)):
        if wanted is not None:
            out = out.where(F.col(name) == wanted)
    return out


def incident_page(incidents: DataFrame, limit: int, offset: int, **filters) -> DataFrame:
    """One listing page, newest first, with the total and whether more follow."""
    rows = incident_filter(incidents, **filters)
    total = rows.count()
    page = rows.orderBy(F.col("triggered_at").desc(), F.col("incident_id").desc())
    return page.offset(offset).limit(limit).select(
        "*",
        F.lit(total).cast("long").alias("total"),
        F.lit(offset + limit < total).alias("has_more"),
    )


def active_incident_count(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        F.count_if(F.col("status").isin("open", "acknowledged")).alias("active_incidents")
    )


def severity_counts(incidents: DataFrame) -> DataFrame:
    """Counts in the fixed severity order, absent severities as 0."""
    kinds = F.array(*[F.lit(s) for s in SEVERITIES])
    grid = incidents.sparkSession.range(1).select(F.explode(kinds).alias("severity"))
    counts = incidents.groupBy("severity").agg(F.count("*").alias("n"))
    return grid.join(counts, "severity", "left").select(
        "severity",
        severity_rank(F.col("severity")).alias("position"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def last_incident(incidents: DataFrame) -> DataFrame:
    return latest_per_machine(incidents, ["triggered_at", "incident_id"])


def label_counts(df: DataFrame, label: str = "health_label") -> DataFrame:
    name = F.coalesce(F.col(label), F.lit("unknown")).alias(label)
    return df.groupBy(name).agg(F.count("*").alias("n"))


def machine_lookup(machines: DataFrame, machine_id: str) -> DataFrame:
    """The registry row of one machine, or nothing."""
    return machines.where(F.col("machine_id") == machine_id).limit(1)


def orphan_audit(child: DataFrame, parent: DataFrame, on: str, relation: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(on), on, "left_anti").withColumn("relation", F.lit(relation))


def priority_sensors(readings: DataFrame, priority: list[str], n: int = 6) -> DataFrame:
    """Top-n sensors of a panel: listed ones first in list order, the rest by name."""
    names = readings.select("sensor").distinct()
    listed = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("sensor"))
    rank = F.when(listed > 0, listed).otherwise(F.lit(len(priority) + 1))
    return names.select("sensor", rank.alias("rank")).orderBy("rank", "sensor").limit(n)


def extraction_summary(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.count_distinct("machine_id").alias("machines"),
        F.lit(len(features)).cast("long").alias("features"),
    )


def label_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("rul_cycles").alias("min_rul"),
        F.max("rul_cycles").alias("max_rul"),
        F.avg("rul_cycles").alias("mean_rul"),
    )


def message_counts(checked: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """processed / rejected / dlq; a rejected message counts in both of the latter."""
    status = F.when(F.col("rejected"), F.array(F.lit("rejected"), F.lit("dlq"))).otherwise(
        F.array(F.lit("processed"))
    )
    all_rows = checked.select(F.explode(status).alias("status")).unionByName(
        parse_errors.select(F.lit("dlq").alias("status"))
    )
    return all_rows.groupBy("status").agg(F.count("*").alias("n"))
