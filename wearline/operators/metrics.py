"""Regression and classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.schemas import HEALTH_LABELS

# Time constants of the asymmetric score and the MAPE guard.
EARLY_SCALE = 13.0
LATE_SCALE = 10.0
MAPE_GUARD = 1e-8


def phm_term(error: Column) -> Column:
    """Penalty of one prediction; late predictions (positive error) cost more."""
    return F.when(error < 0, F.exp(-error / F.lit(EARLY_SCALE)) - 1).otherwise(
        F.exp(error / F.lit(LATE_SCALE)) - 1
    )


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, by: list[str] = []
) -> DataFrame:
    """n, mae, rmse, r2, mape and phm_score in one pass."""
    y, e = F.col(actual), F.col(predicted) - F.col(actual)
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.sum(e * e).alias("_res"),
        (F.var_pop(y) * F.count("*")).alias("_tot"),
        (F.avg(F.abs(e) / (F.abs(y) + F.lit(MAPE_GUARD))) * 100).alias("mape"),
        F.sum(phm_term(e)).alias("phm_score"),
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("_res"), F.col("_tot"))
    return sums.withColumn("r2", r2).select(*by, "n", "mae", "rmse", "r2", "mape", "phm_score")


def interval_width(df: DataFrame, lower: str, upper: str) -> DataFrame:
    return df.agg(F.avg(F.col(upper) - F.col(lower)).alias("mean_interval_width"))


def _label_rows(df: DataFrame, labels: list, name: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in labels])).alias(name))


def label_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, labels: list = HEALTH_LABELS
) -> DataFrame:
    """Every (actual, predicted) cell of the label list, zero cells included."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"))
            for a in labels
            for p in labels
        ]
    )
    grid = df.sparkSession.range(1).select(F.inline(cells))
    counts = label_counts(df, actual, predicted)
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def class_report(
    df: DataFrame, actual: str, predicted: str, labels: list = HEALTH_LABELS
) -> DataFrame:
    """Precision, recall, F1 and support per label; undefined ratios are 0."""
    counts = label_counts(df, actual, predicted)
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("n").alias("support"),
            F.lit(0).cast("long").alias("named"),
            F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("long").alias("support"),
            F.col("n").alias("named"),
            F.lit(0).cast("long").alias("hit"),
        ),
    )
    per_label = (
        counts.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "named", "hit")])
    )
    full = _label_rows(df, labels, "label").join(per_label, "label", "left").na.fill(0)
    precision = F.coalesce(F.try_divide("hit", "named"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    both = F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))
    return full.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        both.alias("f1"),
        "support",
        "hit",
    )


def classification_metrics(
    df: DataFrame,
    actual: str,
    predicted: str,
    labels: list = HEALTH_LABELS,
    watch: object = "imminent_failure",
) -> DataFrame:
    """One row: accuracy, macro and weighted F1, and the recall of the watched label."""
    report = class_report(df, actual, predicted, labels)
    total = F.sum("support")
    return report.agg(
        F.try_divide(F.sum("hit"), total).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
        F.max(F.when(F.col("label") == F.lit(watch), F.col("recall"))).alias("watched_recall"),
    )


def unknown_labels(df: DataFrame, column: str, labels: list = HEALTH_LABELS) -> DataFrame:
    """Distinct labels outside the list."""
    return df.select(column).distinct().subtract(_label_rows(df, labels, column))
