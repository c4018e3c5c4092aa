"""Queries that build datasets, train and score."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline import session
from wearline.operators import labels, metrics, splits
from wearline.operators.rolling import rolling_stats
from wearline.plans import offline, roles, training
from wearline.plans.catalog import CYCLES, longs, query, rounded
from wearline.plans.queries_datasets import cycles
from wearline.plans.roles import DAY_S, EVENT_ORDER

FEATURES = ["value", "mean", "std", "max", "cycle"]


@query(
    "offline_dataset",
    f"""WITH {CYCLES}, v AS (SELECT * FROM c WHERE sensor = 'view'),
    x AS (SELECT machine_id, recorded_at, cycle FROM c WHERE sensor = 'error'),
    m AS (SELECT v.machine_id, v.recorded_at AS computed_at, v.value, x.cycle
      FROM v ASOF JOIN x ON v.machine_id = x.machine_id AND v.recorded_at >= x.recorded_at),
    k AS (SELECT *, least(max(cycle) OVER (PARTITION BY machine_id) - cycle, 125) AS rul FROM m),
    ids AS (SELECT machine_id, row_number() OVER (ORDER BY machine_id) - 1 AS pos, count(*) OVER () AS n
      FROM (SELECT DISTINCT machine_id FROM m))
    SELECT machine_id, computed_at, round(value, 6) + 0.0 AS value, CAST(cycle AS BIGINT) AS cycle,
      CAST(rul AS BIGINT) AS rul_cycles, CASE WHEN rul >= 100 THEN 'healthy' WHEN rul >= 50 THEN 'degrading'
        WHEN rul >= 20 THEN 'critical' ELSE 'imminent_failure' END AS health_label,
      CASE WHEN pos < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train'
        WHEN pos < greatest(1, floor(n * 0.7::DOUBLE)) + greatest(1, floor(n * 0.15::DOUBLE)) THEN 'validation'
        ELSE 'test' END AS split FROM k JOIN ids USING (machine_id)""",
)
def offline_dataset(spark, folder):
    """The whole dataset job: view events are features, error events carry cycles."""
    numbered = cycles(spark, folder)
    features = numbered.where(F.col("sensor") == "view").select(
        "machine_id", F.col("recorded_at").alias("computed_at"), "value"
    )
    known = numbered.where(F.col("sensor") == "error").select(
        "machine_id", "recorded_at", "event_id", "cycle"
    )
    out = offline.build_dataset(features, known, ties=["event_id"], store=True)
    return longs(rounded(out, ["value"]), "cycle", "rul_cycles")


def training_rows(spark, folder):
    """Wide feature rows with both labels, stored once: every tree level and fold reads them."""
    base = cycles(spark, folder)
    rolled = rolling_stats(
        base, [7 * DAY_S], keys=["machine_id"], order=EVENT_ORDER, stats=["mean", "std", "max"]
    )
    return session.cut(labels.assign_health(labels.assign_rul(rolled)))


def _parts(spark, folder):
    rows = training_rows(spark, folder)
    parts = splits.machine_split(rows.select("machine_id"))
    return splits.rows_of_split(rows, parts, "train"), splits.rows_of_split(rows, parts, "test")


@query("rf_health")
def rf_health(spark, folder):
    """Forest trained on the train machines, predictions on the test machines."""
    train, test = _parts(spark, folder)
    model = training.train_health(train, FEATURES)
    scored = training.predict_health(model, test, FEATURES)
    return scored.select(
        "machine_id",
        "event_id",
        "health_label",
        "predicted_label",
        F.try_element_at("health_probabilities", F.lit("healthy")).alias("p_healthy"),
    )


@query("rf_health_metrics")
def rf_health_metrics(spark, folder):
    train, test = _parts(spark, folder)
    model = training.train_health(train, FEATURES)
    return metrics.classification_metrics(
        training.predict_health(model, test, FEATURES), "health_label", "predicted_label"
    )


@query("feature_importance")
def feature_importance(spark, folder):
    train, _ = _parts(spark, folder)
    model = training.train_health(train, FEATURES)
    return training.feature_importance(model, train, FEATURES)


@query("gbt_rul")
def gbt_rul(spark, folder):
    train, test = _parts(spark, folder)
    model = training.train_rul(train, FEATURES)
    scored = training.predict_rul(model, test, FEATURES)
    return metrics.regression_metrics(scored, "rul_cycles", "predicted_rul")


@query("rul_intervals")
def rul_intervals(spark, folder):
    """Per-tree spread as interval, with every field of a prediction."""
    train, test = _parts(spark, folder)
    model = training.train_rul_ensemble(train, FEATURES)
    return training.predict_rul_interval(model, test, FEATURES).select(
        "machine_id",
        "event_id",
        "rul_cycles",
        "rul_lower_bound",
        "rul_upper_bound",
        "rul_hours",
        "confidence",
        "anomaly_score",
        "serving_label",
    )


@query("batch_scoring")
def batch_scoring(spark, folder):
    """Every event as a scoring request, alternating in type; zero k makes a bad request."""
    rows = training_rows(spark, folder)
    train = splits.rows_of_split(rows, splits.machine_split(rows.select("machine_id")), "train")
    rul = training.train_rul_ensemble(train, FEATURES)
    health = training.train_health(train, FEATURES)
    pairs = [x for c in FEATURES for x in (F.lit(c), F.col(c).cast("double"))]
    named = F.create_map(*pairs)
    even = F.pmod("event_id", F.lit(2)) == 0
    sequence = F.when(F.col("sensor") == "error", F.array().cast("array<map<string,double>>")).otherwise(
        F.array(named)
    )
    requests = rows.select(
        F.col("event_id").alias("ordinal"),
        "machine_id",
        F.when(even, "rul").otherwise("health").alias("prediction_type"),
        sequence.alias("feature_sequence"),
        named.alias("features"),
    )
    out = training.score_batch(requests, rul, health, FEATURES)
    return out.select("ordinal", "prediction_type", "success", "error", "health_label", "rul_cycles")


@query("walk_forward_scores")
def walk_forward_scores(spark, folder):
    rows = training_rows(spark, folder)
    return training.cross_validate(rows, FEATURES, EVENT_ORDER, "rul_cycles")
