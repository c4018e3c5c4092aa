"""Remaining-life and health labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.operators.columns import require
from wearline.operators.lookups import join_null_safe, sized
from wearline.operators.slices import AUTO, Running, running, with_key_aggregates, with_previous
from wearline.schemas import HEALTH_LABELS

# Lower bounds of remaining cycles per label, and the label cap.
HEALTH_THRESHOLDS = {"healthy": 100, "degrading": 50, "critical": 20, "imminent_failure": 0}
RUL_CAP = 125

# Serving preset, upper bounds with "at most" semantics.
SERVING_LIMITS = [(30.0, "imminent_failure"), (90.0, "critical"), (180.0, "degrading")]


def with_life(
    df: DataFrame, order: list[str], cycle: str = "cycle", slice_length: int | None | str = AUTO
) -> DataFrame:
    """Numbers the lives of a machine slot: a falling cycle counter opens a new life."""
    stepped = with_previous(
        df, ["machine_id"], order, {"_before": F.col(cycle)}, slice_length=slice_length
    )
    opened = F.when(F.col(cycle) < F.col("_before"), 1).otherwise(0)
    return running(
        stepped, ["machine_id"], order, [Running("life_id", "sum", opened)], slice_length=slice_length, store=True
    ).drop("_before")


def assign_rul(
    df: DataFrame, cap: int | None = RUL_CAP, keys: list[str] = ["machine_id"]
) -> DataFrame:
    """Adds ``rul_cycles``: cycles left until the key's last cycle, at most ``cap``."""
    require(df, [*keys, "cycle"])
    if cap is not None and cap <= 0:
        raise ValueError(f"cap must be positive, got {cap}")
    left = F.col("_last_cycle") - F.col("cycle")
    rul = left if cap is None else F.least(left, F.lit(cap))
    return (
        with_key_aggregates(df, keys, {"_last_cycle": F.max("cycle")})
        .withColumn("rul_cycles", rul)
        .select(*df.columns, "rul_cycles")
    )


def health_of(rul: Column, thresholds: dict[str, float] = HEALTH_THRESHOLDS) -> Column:
    """First label, by falling threshold, whose threshold the value reaches."""
    absent = sorted(set(HEALTH_LABELS) - set(thresholds))
    if absent:
        raise ValueError(f"thresholds missing for: {absent}")
    label = F.lit(None).cast("string")
    for name, floor in sorted(thresholds.items(), key=lambda kv: kv[1]):
        label = F.when(rul >= F.lit(floor), F.lit(name)).otherwise(label)
    return F.coalesce(label, F.lit("imminent_failure"))


def assign_health(df: DataFrame, thresholds: dict[str, float] = HEALTH_THRESHOLDS) -> DataFrame:
    require(df, ["rul_cycles"])
    return df.withColumn("health_label", health_of(F.col("rul_cycles"), thresholds))


def serving_health_of(rul: Column, limits: list[tuple[float, str]] = SERVING_LIMITS) -> Column:
    """Label of a predicted remaining life: the first limit not exceeded."""
    label = F.lit("healthy")
    for limit, name in reversed(limits):
        label = F.when(rul <= F.lit(limit), F.lit(name)).otherwise(label)
    return label


def quartile_classes(df: DataFrame, rul: str = "rul_cycles", classes: int = 4) -> DataFrame:
    """Adds ``rul_class`` by falling quartile edges: class 0 holds the longest lives.

    Edges are exact percentiles from one global aggregate: the column's distinct
    values with their counts, merged map-side, are all it keeps.
    """
    counts = df.groupBy(rul).agg(F.count("*").alias("_n"))
    edges = counts.agg(
        F.percentile(rul, F.array(F.lit(0.75), F.lit(0.5), F.lit(0.25)), F.col("_n")).alias("_e")
    ).first()["_e"]
    value = F.col(rul)
    # Falling bins: a value belongs past every edge it lies below.
    past = [F.when(value < F.lit(e), 1).otherwise(0) for e in edges]
    return df.withColumn("rul_class", (sum(past[1:], past[0]) % classes).cast("int"))


def class_weights(df: DataFrame, label: str = "health_label") -> DataFrame:
    """``n / (k * n_c)`` per class, so that classes weigh the same in total."""
    counts = df.groupBy(label).agg(F.count("*").alias("support"))
    total = counts.agg(F.sum("support").alias("_n"), F.count("*").alias("_k"))
    # counts has one row per class and total exactly one, so the scalar side is constant-size.
    scalar = total.first()
    return counts.withColumn(
        "weight", F.lit(float(scalar["_n"] or 0)) / (F.lit(scalar["_k"]) * F.col("support"))
    )


def with_class_weight(df: DataFrame, label: str = "health_label") -> DataFrame:
    return join_null_safe(df, sized(class_weights(df, label).select(label, "weight")), [label])
