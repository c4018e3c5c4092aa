"""Fixed-length row sequences per machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.operators.slices import AUTO, HOME, SLICE, resolve, rows_per_slice, with_cycle, with_lookback


def sliding_sequences(
    df: DataFrame,
    features: list[str],
    label: str,
    length: int,
    *,
    keys: list[str] = ["machine_id"],
    order: list[str] = ["cycle"],
    slice_length: int | None | str = AUTO,
) -> DataFrame:
    """Every run of ``length`` consecutive rows of a key, labelled by its last row.

    Adds ``sequence`` (array of feature arrays, oldest first) and ``label``;
    keys with fewer rows yield nothing. Oversized keys are cut by row number,
    with the ``length - 1`` preceding rows copied into the next slice.
    """
    cut = resolve(df, keys, order[0], slice_length)
    numbered = with_cycle(df, keys, order, "_row", slice_length=cut)
    by_row = None if cut is None else rows_per_slice(df)
    if isinstance(slice_length, int):
        by_row = max(length, 2)  # an explicit slice also cuts the row axis
    base = with_lookback(numbered, "_row", by_row, length - 1)
    frame = Window.partitionBy(*keys, SLICE).orderBy("_row").rowsBetween(1 - length, 0)
    step = F.array(*[F.col(c).cast("double") for c in features])
    return (
        base.withColumn("sequence", F.collect_list(step).over(frame))
        .where((F.col(SLICE) == F.col(HOME)) & (F.col("_row") >= length))
        .select(*df.columns, "sequence", F.col(label).alias("label"))
    )


def padded(sequence: Column, length: int, width: int) -> Column:
    """Zero steps in front until ``length`` steps are reached."""
    zero = F.array(*[F.lit(0.0)] * width)
    lack = F.greatest(F.lit(length) - F.size(sequence), F.lit(0))
    return F.concat(F.array_repeat(zero, lack), sequence)


def short_sequences(
    df: DataFrame,
    features: list[str],
    label: str,
    length: int,
    *,
    keys: list[str] = ["machine_id"],
    order: list[str] = ["cycle"],
) -> DataFrame:
    """One zero-padded sequence per key with fewer than ``length`` rows.

    Long keys are removed by count first, so a gathered group stays below ``length`` rows.
    """
    short = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") < length).drop("_n")
    step = F.struct(
        *order,
        F.array(*[F.col(c).cast("double") for c in features]).alias("step"),
        F.col(label).alias("label"),
    )
    gathered = df.join(short, keys, "left_semi").groupBy(*keys).agg(
        F.array_sort(F.collect_list(step)).alias("_g")
    )
    return gathered.select(
        *keys,
        padded(F.transform("_g", lambda g: g["step"]), length, len(features)).alias("sequence"),
        F.element_at("_g", -1)["label"].alias("label"),
    )


def flat_names(features: list[str], length: int) -> list[str]:
    """``{feature}_t{step}``; one step stays unsuffixed."""
    if length == 1:
        return list(features)
    return [f"{f}_t{i}" for i in range(length) for f in features]


def flatten_sequence(
    df: DataFrame, features: list[str], length: int, sequence: str = "sequence"
) -> DataFrame:
    """Sequence column to one scalar column per feature and step."""
    picks = [
        F.col(sequence)[i][j].alias(name)
        for (i, j), name in zip(
            ((i, j) for i in range(length) for j in range(len(features))),
            flat_names(features, length),
        )
    ]
    return df.select(*[c for c in df.columns if c != sequence], *picks)
