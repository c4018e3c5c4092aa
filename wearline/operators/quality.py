"""Reading quality: flags, rejection, forward fill.

A reading row has ``machine_id``, ``recorded_at`` and ``readings`` (a map of
sensor to value, missing values NaN or null). Rejection depends on the row
alone, so it is decided first; what depends on the previous accepted reading
(duplicate time, fill) is then a running value per machine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.operators.slices import AUTO, Running, running
from wearline.schemas import QUALITY_FLAGS

_KEY_LIMIT = 2_000  # more sensor names than this are filled in long form


@dataclass(frozen=True)
class QualityLimits:
    max_null_fraction: float = 0.3
    max_future_drift_s: float = 300.0
    min_sensor_count: int = 5
    iqr_factor: float = 1.5
    iqr_min_values: int = 4

    def __post_init__(self) -> None:
        if not 0.0 <= self.max_null_fraction <= 1.0:
            raise ValueError(f"max_null_fraction must lie in [0, 1], got {self.max_null_fraction}")


def missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def null_counts(df: DataFrame) -> DataFrame:
    """Adds ``_size`` and ``_nulls`` of the readings map, so flags do not recount it."""
    values = F.map_values("readings")
    return df.withColumns(
        {
            "_size": F.coalesce(F.size(values), F.lit(0)),
            "_nulls": F.coalesce(F.size(F.filter(values, missing)), F.lit(0)),
        }
    )


def stateless_flags(limits: QualityLimits, as_of: Column) -> dict[str, Column]:
    """The flags that need only the row itself; expects the columns of ``null_counts``."""
    size, nulls = F.col("_size"), F.col("_nulls")
    drift_s = (
        F.unix_micros(F.col("recorded_at").cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))
    ) / F.lit(1e6)
    high = nulls / F.greatest(size, F.lit(1)) > F.lit(limits.max_null_fraction)
    return {
        "MISSING_ID": F.col("machine_id").isNull() | (F.trim("machine_id") == ""),
        "FUTURE_TIMESTAMP": drift_s > F.lit(limits.max_future_drift_s),
        "NULL_FRACTION_HIGH": (nulls > 0) & high,
        "NULL_FRACTION_LOW": (nulls > 0) & ~high,
        "SENSOR_COUNT_LOW": size < limits.min_sensor_count,
    }


def quantile_of_sorted(values: Column, share: float) -> Column:
    """Linear-interpolated quantile of a sorted array without missing values."""
    at = (F.size(values) - 1) * F.lit(share)
    below = F.floor(at).cast("int")
    low = F.get(values, below)
    high = F.coalesce(F.get(values, below + 1), low)
    return low + (high - low) * (at - below)


def outlier_flag(readings: Column, limits: QualityLimits) -> Column:
    """Any present value outside the interquartile fences of its own reading."""
    present = F.sort_array(F.filter(F.map_values(readings), lambda v: ~missing(v)))
    q1, q3 = quantile_of_sorted(present, 0.25), quantile_of_sorted(present, 0.75)
    reach = F.lit(limits.iqr_factor) * (q3 - q1)
    # The array is sorted, so only its ends can lie outside.
    outside = (F.get(present, F.lit(0)) < q1 - reach) | (F.get(present, F.size(present) - 1) > q3 + reach)
    return (F.size(present) >= limits.iqr_min_values) & F.coalesce(outside, F.lit(False))


def sensor_names(df: DataFrame, column: str = "readings", limit: int = _KEY_LIMIT) -> list[str] | None:
    """Distinct map keys, sorted; ``None`` when there are more than ``limit``."""
    rows = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(r["k"] for r in rows)


def _fill_wide(df, names, keys, order, accepted, extra, slice_length) -> DataFrame:
    """One pass over known sensor names; rows not ``accepted`` feed nothing forward."""
    known = []
    for i, name in enumerate(names):
        value = F.try_element_at("readings", F.lit(name))
        event = F.when(~F.map_contains_key("readings", F.lit(name)), F.lit(0.0)).when(
            ~missing(value), value
        )
        known.append(Running(f"_f{i}", "last", F.when(accepted, event)))
    seen = running(
        df, keys, order, [*extra, *known], include_current=False, slice_length=slice_length
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("k"), F.col(f"_f{i}").alias("v")) for i, n in enumerate(names)]
    )
    filled = F.transform_values(
        "readings",
        lambda k, v: F.when(
            missing(v), F.coalesce(F.try_element_at(F.col("_last"), k), F.lit(0.0))
        ).otherwise(v),
    )
    return (
        seen.withColumn("_last", F.map_from_entries(pairs))
        .withColumn("filled", F.when(accepted, filled).otherwise(F.col("readings")))
        .drop("_last", *[f"_f{i}" for i in range(len(names))])
    )


def forward_fill(
    df: DataFrame,
    *,
    keys: list[str] = ["machine_id"],
    order: list[str] = ["recorded_at"],
    accepted: Column | None = None,
    sensors: list[str] | None = None,
    extra: list[Running] = [],
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """Adds ``filled``: missing values take the previous accepted filled value, else 0.0.

    A sensor absent from a reading counts there as 0.0, which is what the next
    reading would fill from; so the fill is the last known value per sensor.
    ``extra`` running values (over earlier rows) ride along in the same pass.
    """
    use = F.lit(True) if accepted is None else accepted
    names = sensors if sensors is not None else sensor_names(df)
    if names:
        return _fill_wide(df, names, keys, order, use, extra, slice_length)
    out = df
    if extra:
        out = running(out, keys, order, extra, include_current=False, slice_length=slice_length)
    fine = _fill_long(out.where(use), keys, order, slice_length)
    rest = out.where(~use).withColumn("filled", F.col("readings"))
    return fine.unionByName(rest)


def _fill_long(df, keys, order, slice_length) -> DataFrame:
    """Same fill for an open sensor vocabulary: one row per reading and sensor."""
    numbered = running(
        df, keys, order, [Running("_seq", "count", F.lit(1))], slice_length=slice_length
    )
    long = numbered.select(*keys, *order, "_seq", F.explode("readings").alias("_s", "_v"))
    long = long.withColumn("_v", F.when(~missing(F.col("_v")), F.col("_v")))
    by = [*keys, "_s"]
    long = running(
        long,
        by,
        order,
        [Running("_prev_seq", "last", F.col("_seq"))],
        include_current=False,
        slice_length=slice_length,
        store=True,
    )
    fresh = F.col("_prev_seq").isNull() | (F.col("_prev_seq") != F.col("_seq") - 1)
    event = F.coalesce(F.col("_v"), F.when(fresh, F.lit(0.0)))
    long = running(long, by, order, [Running("_f", "last", event)], slice_length=slice_length, store=True)
    filled = long.groupBy(*keys, "_seq").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("_s"), F.col("_f")))).alias("filled")
    )
    return (
        numbered.join(filled, [*keys, "_seq"], "left")
        .withColumn("filled", F.coalesce("filled", F.col("readings")))
        .select(*df.columns, "filled")
    )


def check_quality(
    df: DataFrame,
    limits: QualityLimits = QualityLimits(),
    *,
    as_of: Column | None = None,
    order: list[str] = ["recorded_at"],
    sensors: list[str] | None = None,
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """Adds ``rejected``, ``flag_bits``, ``flag_names`` and ``filled``.

    Rejected rows keep their readings and never serve as a previous reading.
    """
    clock = F.current_timestamp() if as_of is None else as_of
    flags = stateless_flags(limits, clock)
    reject = flags["MISSING_ID"] | flags["FUTURE_TIMESTAMP"] | flags["NULL_FRACTION_HIGH"]
    marked = null_counts(df).select(
        *df.columns, reject.alias("rejected"), *[c.alias(f"_q_{n}") for n, c in flags.items()]
    )
    accepted = ~F.col("rejected")
    out = forward_fill(
        marked,
        order=order,
        accepted=accepted,
        sensors=sensors,
        extra=[Running("_prev_at", "last", F.when(accepted, F.col("recorded_at")))],
        slice_length=slice_length,
    )
    states = {
        **{n: F.col(f"_q_{n}") for n in flags},
        "DUPLICATE_TIMESTAMP": F.coalesce(F.col("recorded_at") == F.col("_prev_at"), F.lit(False)),
        "OUTLIER_DETECTED": accepted & outlier_flag(F.col("filled"), limits),
    }
    out = out.select("*", *[c.alias(f"_s_{n}") for n, c in states.items()])
    bits, names_of = flag_columns({n: F.col(f"_s_{n}") for n in states})
    out = out.withColumn("flag_bits", bits).withColumn("flag_names", names_of)
    return out.select(*df.columns, "rejected", "flag_bits", "flag_names", "filled")


def flag_columns(states: dict[str, Column]) -> tuple[Column, Column]:
    """Bit mask and name list, both in the declared flag order."""
    bits = F.lit(0)
    for i, name in enumerate(QUALITY_FLAGS):
        bits = bits + F.when(states[name], F.lit(1 << i)).otherwise(F.lit(0))
    names = F.array_compact(F.array(*[F.when(states[n], F.lit(n)) for n in QUALITY_FLAGS]))
    return bits, names


def accepted_and_rejected(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean readings (filled values in place) and rejects for the dead-letter sink."""
    good = (
        checked.where(~F.col("rejected"))
        .withColumn("readings", F.col("filled"))
        .withColumnRenamed("flag_names", "quality_flags")
        .drop("filled", "rejected", "flag_bits")
    )
    return good, checked.where(F.col("rejected")).drop("filled")
