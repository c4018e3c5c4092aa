"""Drift tests and A/B model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.functions.tails import kolmogorov_tail, student_upper_tail
from wearline.operators.columns import require
from wearline.operators.slices import Running, running
from wearline.session import cut

KS_THRESHOLD = 0.05
ERROR_RISE = 0.20
SIGNIFICANCE = 0.05
INCONCLUSIVE_ABOVE = 0.30
RECALL_SLACK = 0.02
MIN_ERRORS = 10


def _unpivot(df: DataFrame, features: list[str], side: int) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    )
    long = df.select(F.inline(entries)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.withColumn("side", F.lit(side))


def ks_test(
    reference: DataFrame,
    current: DataFrame,
    features: list[str],
    p_threshold: float = KS_THRESHOLD,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov per feature; features empty on a side are left out.

    Rows first collapse to distinct values with two counts, so ties and hot
    values cost one row; that table is stored once, and cumulative counts are
    running sums in value order. An empty sample is refused; infinities count.
    """
    require(reference, features)
    require(current, features)
    counts = (
        _unpivot(reference, features, 0)
        .unionByName(_unpivot(current, features, 1))
        .groupBy("feature", "value")
        .agg(
            F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")
        )
    )
    if reference.isEmpty() or current.isEmpty():
        raise ValueError("reference and current samples must not be empty")
    counts = cut(counts)
    # asinh keeps the order and tames outliers, which makes it a usable slicing axis.
    end = F.lit(2.0**60)
    scaled = F.greatest(F.least(F.asinh("value") * F.lit(2.0**50), end), -end)
    placed = counts.withColumn("_at", scaled.cast("long"))
    summed = running(
        placed,
        ["feature"],
        ["_at", "value"],
        [Running("_ca", "sum", F.col("a")), Running("_cb", "sum", F.col("b"))],
    )
    sizes = counts.groupBy("feature").agg(
        F.sum("a").alias("n_reference"), F.sum("b").alias("n_current")
    )
    gap = F.abs(F.col("_ca") / F.col("n_reference") - F.col("_cb") / F.col("n_current"))
    gaps = (
        summed.join(sizes, "feature")
        .where((F.col("n_reference") > 0) & (F.col("n_current") > 0))
        .select("feature", "n_reference", "n_current", gap.alias("_gap"))
    )
    out = gaps.groupBy("feature").agg(
        F.max("n_reference").alias("n_reference"),
        F.max("n_current").alias("n_current"),
        F.max("_gap").alias("ks_statistic"),
    )
    p = kolmogorov_tail(F.col("ks_statistic"), F.col("n_reference"), F.col("n_current"))
    return out.withColumn("p_value", p).withColumn("drifted", F.col("p_value") < p_threshold)


def data_drift_report(tests: DataFrame, p_threshold: float = KS_THRESHOLD) -> DataFrame:
    """One row: detected, affected features and the recommendation."""
    flagged = F.count_if("drifted") > 0
    near = F.count_if(F.col("p_value") < 3 * p_threshold) > 0
    return tests.agg(
        flagged.alias("detected"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias(
            "affected_features"
        ),
        F.max("ks_statistic").alias("ks_statistic"),
        F.min("p_value").alias("p_value"),
        F.when(flagged, "retrain").when(near, "monitor").otherwise("ok").alias("recommendation"),
    ).withColumn("drift_type", F.lit("covariate"))


def t_ratio(difference: Column, error: Column) -> Column:
    """difference / error with the limits a zero error implies."""
    return (
        F.when(error > 0, F.try_divide(difference, error))
        .when(difference > 0, F.lit(float("inf")))
        .when(difference < 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )


def _below(p: Column, limit: float) -> Column:
    return ~F.isnan(p) & (p < limit)  # NaN sorts above every number, and must not pass


def validate_errors(df: DataFrame, error: str, side: str) -> dict[int, int]:
    """Counts per side; refuses an empty side and non-finite values."""
    _refuse_non_finite(df, error)
    sizes = {r[side]: r["n"] for r in df.groupBy(side).agg(F.count("*").alias("n")).collect()}
    if sizes.get(0, 0) == 0 or sizes.get(1, 0) == 0:
        raise ValueError("baseline and recent errors must not be empty")
    return sizes


def welch_moments(df: DataFrame, error: str, side: str) -> DataFrame:
    """Moments of |error| on both sides with Welch's t and degrees of freedom.

    ``side`` is 0 for the baseline and 1 for the recent rows.
    """
    base = F.when(F.col(side) == 0, F.abs(F.col(error)))
    late = F.when(F.col(side) == 1, F.abs(F.col(error)))
    m = df.agg(
        F.count(base).alias("n_baseline"),
        F.count(late).alias("n_recent"),
        F.avg(base).alias("baseline_mae"),
        F.avg(late).alias("recent_mae"),
        (F.var_samp(base) / F.count(base)).alias("_vb"),
        (F.var_samp(late) / F.count(late)).alias("_vr"),
    )
    spread = F.col("_vb") + F.col("_vr")
    freedom = F.try_divide(
        spread * spread,
        F.col("_vb") * F.col("_vb") / (F.col("n_baseline") - 1)
        + F.col("_vr") * F.col("_vr") / (F.col("n_recent") - 1),
    )
    rise = F.when(F.col("baseline_mae") == 0, F.lit(0.0)).otherwise(
        (F.col("recent_mae") - F.col("baseline_mae")) / F.col("baseline_mae")
    )
    return m.select(
        "n_baseline",
        "n_recent",
        "baseline_mae",
        "recent_mae",
        rise.alias("error_increase"),
        t_ratio(F.col("recent_mae") - F.col("baseline_mae"), F.sqrt(spread)).alias("t_statistic"),
        F.coalesce(freedom, F.lit(1.0)).alias("freedom"),
    )


def _refuse_non_finite(df: DataFrame, error: str) -> None:
    value = F.col(error)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    if df.agg(F.count_if(bad)).first()[0]:
        raise ValueError("errors contain non-finite values")


def concept_drift(
    df: DataFrame,
    error: str,
    side: str,
    p_threshold: float = KS_THRESHOLD,
    rise_threshold: float = ERROR_RISE,
) -> DataFrame:
    """One row: Welch's one-sided test, the MAE rise and the recommendation.

    Null, NaN and infinite errors are refused. Without rows on a side nothing is detected.
    """
    _refuse_non_finite(df, error)
    m = welch_moments(df, error, side)
    m = m.withColumn("p_value", student_upper_tail("t_statistic", "freedom"))
    rise = F.col("error_increase")
    detected = _below(F.col("p_value"), p_threshold) & (rise > rise_threshold)
    advice = F.when(F.col("detected"), "retrain").when(rise > rise_threshold * 0.5, "monitor")
    return (
        m.withColumn("detected", F.coalesce(detected, F.lit(False)))
        .withColumn("recommendation", advice.otherwise("ok"))
        .withColumn("drift_type", F.lit("concept"))
    )


def recommendation(better: Column, p: Column) -> Column:
    return (
        F.when(better, "promote")
        .when(~F.isnan(p) & (p > INCONCLUSIVE_ABOVE), "inconclusive")
        .otherwise("discard")
    )


def compare_rul(
    df: DataFrame,
    actual: str,
    baseline: str,
    challenger: str,
    significance: float = SIGNIFICANCE,
) -> DataFrame:
    """Paired one-sided t-test on absolute errors; lower is better."""
    base = F.abs(F.col(baseline) - F.col(actual))
    chal = F.abs(F.col(challenger) - F.col(actual))
    d = chal - base
    m = df.agg(
        F.count("*").alias("n"),
        F.avg(base).alias("baseline_mae"),
        F.avg(chal).alias("challenger_mae"),
        F.avg(d).alias("delta_mae"),
        (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("_se"),
    )
    m = m.withColumn("t_statistic", t_ratio(F.col("delta_mae"), F.col("_se")))
    # "less": the lower tail of t is the upper tail of -t.
    m = m.withColumn("p_value", student_upper_tail(-F.col("t_statistic"), F.col("n") - 1))
    better = _below(F.col("p_value"), significance) & (F.col("delta_mae") < 0)
    return (
        m.withColumn("challenger_better", better)
        .withColumn("recommendation", recommendation(F.col("challenger_better"), F.col("p_value")))
        .drop("_se")
    )


def first_max_index(values: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def one_hot(index: Column, classes: int) -> Column:
    """Probability array of a class index taken modulo ``classes``."""
    at = F.pmod(index, F.lit(classes))
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0)
    )


def compare_health(
    df: DataFrame,
    actual: str,
    baseline: str,
    challenger: str,
    classes: int = 4,
    significance: float = SIGNIFICANCE,
) -> DataFrame:
    """Macro-F1 gain, paired t-test on true-class probability, and the critical-recall gate.

    ``baseline`` and ``challenger`` are probability arrays, ``actual`` an index.
    """
    base_p = F.element_at(F.col(baseline), F.col(actual) + 1)
    chal_p = F.element_at(F.col(challenger), F.col(actual) + 1)
    scored = df.select(
        F.col(actual).cast("int").alias("_y"),
        first_max_index(F.col(baseline)).alias("_base"),
        first_max_index(F.col(challenger)).alias("_chal"),
        base_p.alias("_bp"),
        chal_p.alias("_cp"),
    )
    watched = min(3, classes - 1)
    counts = scored.groupBy("_y", "_base", "_chal").agg(F.count("*").alias("_n"))
    d = F.col("_cp") - F.col("_bp")
    moments = scored.agg(
        F.count("*").alias("n"),
        F.avg(d).alias("_mean"),
        (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("_se"),
        (F.avg(F.abs(F.col("_cp") - 1)) - F.avg(F.abs(F.col("_bp") - 1))).alias("delta_mae"),
    )
    sides = [
        _side_scores(counts, "_base", classes, watched, "baseline"),
        _side_scores(counts, "_chal", classes, watched, "challenger"),
    ]
    m = moments
    for side in sides:  # three one-row frames side by side
        m = m.withColumn("_one", F.lit(1)).join(side.withColumn("_one", F.lit(1)), "_one").drop("_one")
    m = m.withColumn("delta_f1", F.col("challenger_f1") - F.col("baseline_f1"))
    m = m.withColumn("t_statistic", t_ratio(F.col("_mean"), F.col("_se")))
    m = m.withColumn("p_value", student_upper_tail(F.col("t_statistic"), F.col("n") - 1))
    held = F.coalesce(
        F.col("challenger_recall") >= F.col("baseline_recall") - RECALL_SLACK, F.lit(True)
    )
    better = _below(F.col("p_value"), significance) & (F.col("delta_f1") > 0) & held
    return (
        m.withColumn("recall_held", held)
        .withColumn("challenger_better", better)
        .withColumn("recommendation", recommendation(F.col("challenger_better"), F.col("p_value")))
        .drop("_mean", "_se")
    )


def _side_scores(counts: DataFrame, predicted: str, classes: int, watched: int, name: str) -> DataFrame:
    """Macro F1 over the labels that occur, and recall of the watched class, from cell counts."""
    sides = F.array(
        F.struct(
            F.col("_y").alias("label"),
            F.col("_n").alias("support"),
            F.lit(0).cast("long").alias("named"),
            F.when(F.col("_y") == F.col(predicted), F.col("_n")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col(predicted).alias("label"),
            F.lit(0).cast("long").alias("support"),
            F.col("_n").alias("named"),
            F.lit(0).cast("long").alias("hit"),
        ),
    )
    per = (
        counts.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "named", "hit")])
    )
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("support") + F.col("named")), F.lit(0.0))
    recall = F.when(
        (F.col("label") == watched) & (F.col("support") > 0), F.col("hit") / F.col("support")
    )
    return per.agg(F.avg(f1).alias(f"{name}_f1"), F.max(recall).alias(f"{name}_recall"))


