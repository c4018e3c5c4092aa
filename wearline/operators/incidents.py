"""Incidents: building, aggregation, suppression, notification, life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.operators.chains import mark_openers
from wearline.operators.rules import severity_rank
from wearline.operators.slices import AUTO
from wearline.schemas import SEVERITIES

DETAIL_FIELDS = [
    "rule_id",
    "rule_name",
    "condition_type",
    "thresholds",
    "rul_cycles",
    "rul_hours",
    "anomaly_score",
    "health_label",
    "confidence",
    "rul_model_version",
    "health_model_version",
    "previous_rul",
    "active_sensor_count",
    "predicted_at",
]


def incident_title() -> Column:
    """``[SEVERITY] machine: rule name``."""
    return F.concat(
        F.lit("["), F.upper("severity"), F.lit("] "), F.col("machine_id"), F.lit(": "), F.col("rule_name")
    )


def incident_id(*parts: str) -> Column:
    """Replay-safe identifier: the same trigger always yields the same id."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def build_incidents(fires: DataFrame, time: str = "predicted_at") -> DataFrame:
    """Open incident rows from fired hits; absent detail fields are left out."""
    present = [c for c in DETAIL_FIELDS if c in fires.columns]
    details = F.to_json(F.struct(*present, "machine_id"))
    return fires.select(
        incident_id("machine_id", "rule_id", time).alias("incident_id"),
        "rule_id",
        "machine_id",
        "severity",
        incident_title().alias("title"),
        F.lit("open").alias("status"),
        details.alias("details"),
        F.col(time).alias("triggered_at"),
    )


def aggregate_incidents(
    incidents: DataFrame,
    window_s: int = 300,
    ties: list[str] = ["incident_id"],
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """One row per (machine, rule, anchored window): the most severe, then newest incident.

    The first incident opens a window that includes ages up to ``window_s``.
    """
    marked = mark_openers(
        incidents.withColumn("_window_s", F.lit(window_s)),
        ["machine_id", "rule_id"],
        "triggered_at",
        ties,
        "_window_s",
        closed=True,
        slice_length=slice_length,
    )
    rank = severity_rank(F.col("severity"))
    newest = F.struct(rank, F.col("triggered_at"), *[F.col(t) for t in ties])
    others = [c for c in incidents.columns if c not in ("machine_id", "rule_id")]
    best = F.max_by(F.struct(*others), newest).alias("_best")
    return (
        marked.groupBy("machine_id", "rule_id", F.col("opened_at").alias("window_start"))
        .agg(F.count("*").alias("merged"), best)
        .select("machine_id", "rule_id", "window_start", "merged", "_best.*")
    )


def flush_groups(aggregated: DataFrame, flush_s: int = 300) -> DataFrame:
    """Aggregated incidents grouped per machine and flush tick, most severe first.

    A group holds at most one row per rule and open window of the tick.
    """
    tick = F.timestamp_seconds(
        F.floor(F.unix_seconds(F.col("window_start").cast("timestamp")) / flush_s) * flush_s
    )
    member = F.struct(
        (-severity_rank(F.col("severity"))).alias("order"),
        F.col("triggered_at"),
        F.col("rule_id"),
        F.col("title"),
        F.col("severity"),
    )
    return (
        aggregated.withColumn("flushed_at", tick)
        .groupBy("machine_id", "flushed_at")
        .agg(F.sort_array(F.collect_list(member)).alias("incidents"))
    )


def group_summary(incidents: DataFrame, by: list[str]) -> DataFrame:
    """Highest severity, its title and the earliest trigger per group, without gathering rows."""
    rank = severity_rank(F.col("severity"))
    first = F.struct(-rank, F.col("triggered_at"), F.col("rule_id"))
    return incidents.groupBy(*by).agg(
        F.max(rank).alias("_rank"),
        F.min_by("title", first).alias("title"),
        F.min("triggered_at").alias("triggered_at"),
        F.count("*").alias("incident_count"),
    ).select(
        *by,
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("_rank")).alias("severity"),
        "title",
        "triggered_at",
        "incident_count",
    )


def in_quiet_hours(time: Column, start: int, end: int) -> Column:
    """UTC hour in ``[start, end)``; a start after the end spans midnight."""
    hour = F.hour(time)
    if start <= end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def maintenance_state(events: DataFrame) -> DataFrame:
    """Machines whose latest switch turned maintenance on."""
    latest = events.groupBy("machine_id").agg(F.max_by("enabled", "changed_at").alias("enabled"))
    return latest.where("enabled").select("machine_id")


def with_suppression(
    groups: DataFrame,
    maintenance: DataFrame,
    quiet_hours: tuple[int, int] | None = None,
    time: str = "triggered_at",
) -> DataFrame:
    """Adds ``suppressed``: machine in maintenance, or quiet hours unless critical."""
    flagged = groups.join(
        maintenance.select("machine_id", F.lit(True).alias("_off")).distinct(), "machine_id", "left"
    )
    silent = F.coalesce("_off", F.lit(False))
    if quiet_hours is not None:
        quiet = in_quiet_hours(F.col(time).cast("timestamp"), *quiet_hours)
        silent = silent | (quiet & (F.col("severity") != "critical"))
    return flagged.withColumn("suppressed", silent).drop("_off")


def notifications(
    groups: DataFrame, maintenance: DataFrame, quiet_hours: tuple[int, int] | None = None
) -> DataFrame:
    """Payload rows of the groups that are not suppressed."""
    top = F.col("incidents")[0]
    rows = groups.select(
        "machine_id",
        "flushed_at",
        top["severity"].alias("severity"),
        top["title"].alias("title"),
        F.array_min(F.transform("incidents", lambda i: i["triggered_at"])).alias("triggered_at"),
        F.size("incidents").alias("incident_count"),
        "incidents",
    )
    kept = with_suppression(rows, maintenance, quiet_hours).where(~F.col("suppressed"))
    payload = F.to_json(
        F.struct(
            "machine_id",
            "severity",
            "title",
            "triggered_at",
            F.transform(
                "incidents",
                lambda i: F.struct(
                    i["rule_id"].alias("rule_id"),
                    i["severity"].alias("severity"),
                    i["title"].alias("title"),
                    i["triggered_at"].alias("triggered_at"),
                ),
            ).alias("incidents"),
        )
    )
    return kept.withColumn("payload", payload).drop("suppressed", "incidents")


def current_incidents(log: DataFrame) -> DataFrame:
    """Current state per incident from its event log.

    Log rows have ``incident_id``, ``action`` (open, acknowledge, close),
    ``event_at``, ``event_no``, ``actor`` and ``note``. Actions before the
    opening have no effect. The first close wins; the first acknowledgement
    counts only if it precedes that close. So the fold is minima per incident,
    which combine map-side.
    """
    at = F.struct("event_at", "event_no")
    opens = (
        log.where(F.col("action") == "open").groupBy("incident_id").agg(F.min(at).alias("_open"))
    )
    later = log.join(opens, "incident_id").where((F.col("action") == "open") | (at > F.col("_open")))
    full = F.struct("event_at", "event_no", "actor", "note")

    def first(action: str) -> Column:
        return F.min(F.when(F.col("action") == action, full)).alias(f"_{action}")

    folded = later.groupBy("incident_id").agg(
        F.min("_open").alias("_open"), first("acknowledge"), first("close")
    )
    acked, closed = F.col("_acknowledge"), F.col("_close")

    def key(e: Column) -> Column:
        return F.struct(e["event_at"], e["event_no"])

    acked_ok = acked.isNotNull() & (closed.isNull() | (key(acked) < key(closed)))
    return folded.select(
        "incident_id",
        F.when(closed.isNotNull(), "closed").when(acked_ok, "acknowledged").otherwise("open").alias("status"),
        F.col("_open")["event_at"].alias("triggered_at"),
        F.when(acked_ok, acked["event_at"]).alias("acknowledged_at"),
        F.when(acked_ok, acked["actor"]).alias("acknowledged_by"),
        closed["event_at"].alias("closed_at"),
        closed["note"].alias("resolution_note"),
    )
