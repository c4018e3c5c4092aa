"""Retraining job: drift tests, decision, training, promotion, drift event."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.operators import drift
from wearline.operators.columns import numeric_columns
from wearline.operators.labels import assign_health
from wearline.operators.splits import machine_split, rows_of_split
from wearline.plans import training
from wearline.plans.models import ModelLog, promotion, should_retrain
from wearline.schemas import DRIFT_EVENT, HEALTH_LABELS
from wearline.sources.tables import append

# Fixed value: errors younger than this are the recent ones.
ERROR_DAYS = 7
REFERENCE_SHARE = 2 / 3  # of the feature rows, by time; the later ones are the current sample
RUL, HEALTH = "lifespan_predictor", "condition_classifier"


@dataclass(frozen=True)
class Sizes:
    """Model sizes of a run."""

    boost_trees: int = training.BOOST_TREES
    boost_depth: int = training.BOOST_DEPTH
    forest_trees: int = training.FOREST_TREES
    forest_depth: int = training.FOREST_DEPTH


def error_rows(audit: DataFrame, as_of: datetime) -> DataFrame:
    """All absolute errors, with ``side`` 0 before and 1 within the last week; rows without a prediction or an actual value are left out.

    NaN and infinite errors stay: ``concept_drift`` refuses them.
    """
    cut = F.lit(as_of) - F.expr(f"INTERVAL {ERROR_DAYS} DAYS")
    rows = audit.select(
        "created_at", F.abs(F.col("predicted_rul") - F.col("actual_rul")).alias("abs_error")
    )
    side = F.when(F.col("created_at") < cut, 0).otherwise(1)
    return rows.withColumn("side", side).where(F.col("abs_error").isNotNull())


def time_windows(features: DataFrame, share: float = REFERENCE_SHARE) -> tuple[DataFrame, DataFrame]:
    """The feature rows before and from the time that ``share`` of them lie before."""
    at = F.unix_micros("computed_at")
    edge = features.agg(F.percentile_approx(at, share, 100_000)).first()[0]
    return features.where(at < F.lit(edge)), features.where(at >= F.lit(edge))


def drift_decision(
    features: DataFrame, audit: DataFrame, as_of: datetime, forced: bool = False
) -> DataFrame:
    """One row: both drift verdicts and whether to retrain."""
    names = numeric_columns(features, exclude=("machine_id", "window_s"))
    tests = drift.ks_test(*time_windows(features), names)
    data = drift.data_drift_report(tests).select(
        F.col("detected").alias("data_drift"), "affected_features", "ks_statistic", "p_value"
    )
    concept = drift.concept_drift(error_rows(audit, as_of), "abs_error", "side").select(
        (
            F.col("detected")
            & (F.col("n_baseline") >= drift.MIN_ERRORS)
            & (F.col("n_recent") >= drift.MIN_ERRORS)
        ).alias("concept_drift"),
        "error_increase",
    )
    # Two one-row frames side by side.
    both = data.withColumn("_one", F.lit(1)).join(concept.withColumn("_one", F.lit(1)), "_one", "left")
    return both.drop("_one").withColumn(
        "retrain", should_retrain(F.lit(forced), F.col("data_drift"), F.col("concept_drift"))
    )


def training_rows(features: DataFrame, rul_labels: DataFrame) -> DataFrame:
    """All labelled feature rows with their health label."""
    named = rul_labels.select("machine_id", F.col("recorded_at").alias("computed_at"), "rul_cycles")
    joined = features.join(named, ["machine_id", "computed_at"], "inner")
    return assign_health(joined)


def run(
    spark: SparkSession,
    features: DataFrame,
    audit: DataFrame,
    rul_labels: DataFrame,
    log: ModelLog,
    model_dir: str,
    events_path: str,
    as_of: datetime,
    *,
    reason: str = "scheduled",
    forced: bool = False,
    auto_promote: bool = False,
    min_rows: int = training.MIN_TRAINING_ROWS,
    sizes: Sizes = Sizes(),
) -> dict:
    """The whole job; returns a summary of what was decided."""
    verdict = drift_decision(features, audit, as_of, forced).first()
    summary = {"reason": reason, "triggered": bool(verdict["retrain"]), "trained": False}
    summary.update(rul_promoted=False, health_promoted=False)
    if not summary["triggered"]:
        return summary
    rows = training_rows(features, rul_labels)
    summary["rows"] = rows.count()
    if summary["rows"] < min_rows:
        return summary
    names = numeric_columns(features, exclude=("machine_id", "window_s"))
    parts = machine_split(rows.select("machine_id"))
    train = rows_of_split(rows, parts, "train")
    test = rows_of_split(rows, parts, "test")
    challengers = {
        RUL: training.train_rul(train, names, trees=sizes.boost_trees, depth=sizes.boost_depth),
        HEALTH: training.train_health(train, names, trees=sizes.forest_trees, depth=sizes.forest_depth),
    }
    summary["trained"] = True
    for kind, model in challengers.items():
        run_id = f"{kind}-{as_of:%Y%m%dT%H%M%S}"
        path = f"{model_dir}/{run_id}"
        model.write().overwrite().save(path)
        version = log.register(kind, run_id, path, as_of)
        summary[f"{'rul' if kind == RUL else 'health'}_promoted"] = _promote_if_better(
            log, kind, version, model, test, names, as_of, auto_promote
        )
    event = (
        as_of,
        "concept" if verdict["concept_drift"] and not verdict["data_drift"] else "data",
        verdict["affected_features"],
        verdict["ks_statistic"],
        verdict["p_value"],
        True,
        json.dumps({k: v for k, v in summary.items()}),
    )
    append(spark.createDataFrame([event], DRIFT_EVENT), events_path)
    return summary


def _promote_if_better(log, kind, version, model, test, names, at, auto_promote) -> bool:
    """Compares on the held-out machines and moves the challenger to production if it won."""
    column = "predicted_rul" if kind == RUL else "predicted_label"
    predict = training.predict_rul if kind == RUL else training.predict_health
    scored = predict(model, test, names)
    if not training.usable_model(scored, column):
        return False
    current = log.production(kind)
    comparison = None
    if current is not None and not auto_promote:
        _, baseline = log.load_production(kind)
        comparison = compare(kind, baseline, model, test, names)
    if not promotion(current is not None, auto_promote, comparison):
        return False
    log.promote(kind, version, at)
    return True


def compare(kind: str, baseline, challenger, test: DataFrame, names: list[str]) -> DataFrame:
    """Both models on the same rows."""
    if kind == RUL:
        both = training.predict_rul(baseline, test, names).withColumnRenamed("predicted_rul", "_base")
        both = training.predict_rul(challenger, both, names)
        return drift.compare_rul(both, "rul_cycles", "_base", "predicted_rul")
    order = F.array(*[F.lit(n) for n in HEALTH_LABELS])
    shares = F.array(*[F.try_element_at("health_probabilities", F.lit(n)) for n in HEALTH_LABELS])
    both = training.predict_health(baseline, test, names).withColumn("_base", shares)
    both = both.drop("health_probabilities", "predicted_label")
    both = training.predict_health(challenger, both, names).withColumn("_chal", shares)
    actual = (F.array_position(order, F.col("health_label")) - 1).cast("int")
    return drift.compare_health(both.withColumn("_y", actual), "_y", "_base", "_chal")
