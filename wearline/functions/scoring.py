"""Column expressions of prediction rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearline.schemas import HEALTH_LABELS

HOURS_PER_CYCLE = 0.5
MAX_SEQUENCE = 200
MAX_ID_LENGTH = 64


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def rul_hours(rul: Column, hours_per_cycle: float = HOURS_PER_CYCLE) -> Column:
    return rul * F.lit(hours_per_cycle)


def interval(samples: Column) -> Column:
    """Struct of mean, 5th and 95th percentile of an ensemble, not negative, ordered."""
    n = F.size(samples)
    ordered = F.array_sort(samples)

    def at(share: float) -> Column:
        place = (n - 1) * F.lit(share)
        below = F.floor(place).cast("int")
        low = F.get(ordered, below)
        return low + (F.coalesce(F.get(ordered, below + 1), low) - low) * (place - below)

    mean = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x) / n
    low = F.greatest(F.lit(0.0), at(0.05))
    return F.struct(
        F.greatest(F.lit(0.0), mean).alias("rul_cycles"),
        low.alias("rul_lower_bound"),
        F.greatest(low, at(0.95)).alias("rul_upper_bound"),
    )


def confidence(rul: Column, lower: Column, upper: Column) -> Column:
    """1 minus the interval width relative to twice the estimate, clipped."""
    return clip(F.lit(1.0) - (upper - lower) / (F.greatest(rul, F.lit(1.0)) * 2.0))


def anomaly_score(confidence_value: Column) -> Column:
    return clip(F.lit(1.0) - confidence_value)


def normalized(probabilities: Column) -> Column:
    """Array divided by its total; unchanged when the total is not positive."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(
        total > 0, F.transform(probabilities, lambda p: p / total)
    ).otherwise(probabilities)


def named_probabilities(probabilities: Column, labels: list[str] = HEALTH_LABELS) -> Column:
    names = F.slice(F.array(*[F.lit(n) for n in labels]), F.lit(1), F.size(probabilities))
    return F.map_from_arrays(names, normalized(probabilities))


def top_label(probabilities: Column, labels: list[str] = HEALTH_LABELS) -> Column:
    """Label of the first maximum."""
    at = F.array_position(probabilities, F.array_max(probabilities))
    return F.element_at(F.array(*[F.lit(n) for n in labels]), at.cast("int"))


def valid_id(column: Column) -> Column:
    return F.coalesce(F.length(column).between(1, MAX_ID_LENGTH), F.lit(False))


def evaluation_error() -> Column:
    """Why a prediction row may not be evaluated against rules; null when it may."""
    return (
        F.when(~valid_id(F.col("machine_id")), "machine_id")
        .when(F.coalesce(F.col("rul_cycles") < 0, F.lit(True)), "rul_cycles")
        .when(~F.coalesce(F.col("anomaly_score").between(0, 1), F.lit(False)), "anomaly_score")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence")
    )


def scoring_error(kind: Column, sequence: Column, features: Column) -> Column:
    """Why a scoring request fails; null when it may be scored."""
    n = F.coalesce(F.size(sequence), F.lit(0))
    return (
        F.when(~valid_id(F.col("machine_id")), "machine_id must have 1 to 64 characters")
        .when((kind == "rul") & (n < 1), "feature_sequence must not be empty")
        .when((kind == "rul") & (n > MAX_SEQUENCE), f"feature_sequence exceeds {MAX_SEQUENCE} steps")
        .when(
            (kind == "health") & (F.coalesce(F.size(features), F.lit(0)) < 1),
            "features must not be empty",
        )
        .when(~kind.isin("rul", "health"), "unknown prediction_type")
    )
