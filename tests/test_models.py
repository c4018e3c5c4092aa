import threading
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import labels
from wearline.plans import models, queries_models, retraining, training

NOW = datetime(2024, 3, 1, tzinfo=timezone.utc)
SMALL = retraining.Sizes(boost_trees=4, boost_depth=3, forest_trees=6, forest_depth=4)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = []
    for m in range(10):
        for c in range(60):
            rul = (59 - c) * 2.5
            rows.append((f"M{m}", NOW - timedelta(hours=60 - c), rul + rng.normal(), rng.normal(), rul))
    df = spark.createDataFrame(rows, "machine_id string, computed_at timestamp, a double, b double, rul_cycles double")
    return labels.assign_health(df).cache()


@pytest.fixture(scope="module")
def fitted(data):
    return (
        training.train_rul_ensemble(data, ["a", "b"], trees=6, depth=5),
        training.train_health(data, ["a", "b"], trees=6, depth=5),
    )


def test_health_model_learns_and_keeps_all_labels(spark, data, fitted):
    scored = training.predict_health(fitted[1], data, ["a", "b"])
    agree = scored.agg(F.avg((F.col("health_label") == F.col("predicted_label")).cast("double"))).first()[0]
    assert agree > 0.85
    row = scored.first()
    assert set(row["health_probabilities"]) == set(labels.HEALTH_LABELS)
    assert sum(row["health_probabilities"].values()) == pytest.approx(1.0)
    top = training.feature_importance(fitted[1], data, ["a", "b"]).first()
    assert top["feature"] == "a"


def test_intervals(data, fitted):
    out = training.predict_rul_interval(fitted[0], data, ["a", "b"])
    wrong = out.where(
        "rul_lower_bound < 0 OR rul_upper_bound < rul_lower_bound OR confidence NOT BETWEEN 0 AND 1 "
        "OR abs(rul_hours - rul_cycles * 0.5) > 1e-9 OR abs(anomaly_score + confidence - 1) > 1e-9"
    )
    assert wrong.count() == 0 and training.usable_model(out, "rul_cycles")


def test_batch_scoring(spark, fitted):
    step = {"a": 10.0, "b": 0.0}
    rows = [
        (0, "M", "rul", [step], None),
        (1, "M", "health", None, step),
        (2, "", "health", None, step),
        (3, "M", "rul", [], None),
        (4, "M", "rul", [step] * 201, None),
        (5, "M", "health", None, {}),
        (6, "M", "other", None, step),
        (7, "M", "rul", [{"a": 500.0, "b": 0.0}, step], None),
    ]
    df = spark.createDataFrame(
        rows,
        "ordinal int, machine_id string, prediction_type string, "
        "feature_sequence array<map<string,double>>, features map<string,double>",
    )
    out = training.score_batch(df, *fitted, ["a", "b"]).collect()
    assert [r["ordinal"] for r in out] == list(range(8))
    assert [r["success"] for r in out] == [True, True, False, False, False, False, False, True]
    assert out[0]["rul_cycles"] == out[7]["rul_cycles"] and out[1]["health_label"] in labels.HEALTH_LABELS
    assert "empty" in out[3]["error"] and "200" in out[4]["error"]


def test_model_log(spark, tmp_path):
    log = models.ModelLog(spark, str(tmp_path / "log"))
    assert log.production("x") is None
    assert [log.register("x", f"run{i}", "p", NOW) for i in (1, 2, 3)] == [1, 2, 3]
    log.promote("x", 1, NOW)
    log.promote("x", 3, NOW)
    assert log.production("x")["version"] == 3
    stages = {r["version"]: r["stage"] for r in models.current_versions(log.read()).collect()}
    assert stages == {1: "archived", 2: "staging", 3: "production"}
    assert log.rollback("x", NOW) == 1
    stages = {r["version"]: r["stage"] for r in models.current_versions(log.read()).collect()}
    assert stages == {1: "production", 2: "staging", 3: "archived"}
    runs = spark.createDataFrame([("run3", 0.5)], "run_id string, score double")
    assert [r["version"] for r in models.run_of_version(log.read(), runs).collect()] == [3]
    with pytest.raises(ValueError):
        log.promote("x", 9, NOW)
    with pytest.raises(ValueError):
        log.rollback("y", NOW)
    assert models.promotion(False, False, None) and models.promotion(True, True, None)
    assert not models.promotion(True, False, None)


def audit(spark, recent):
    rows = [("M", float(i % 5), 0.0, NOW - timedelta(days=10, minutes=i)) for i in range(100)]
    rows += [("M", float(i % 5) + recent, 0.0, NOW - timedelta(days=1, minutes=i)) for i in range(100)]
    return spark.createDataFrame(rows, "machine_id string, predicted_rul double, actual_rul double, created_at timestamp")


def test_retraining(spark, data, tmp_path):
    # Time in no order with the lives, so that early and late rows are alike.
    mixed = F.timestamp_micros(F.unix_micros(F.lit(NOW)) - F.pmod(F.xxhash64("machine_id", "computed_at"), F.lit(10**12)))
    data = data.withColumn("computed_at", mixed)
    features = data.select("machine_id", "computed_at", F.lit(60).alias("window_s"), F.col("b").alias("b"), "a")
    rul = data.select("machine_id", F.col("computed_at").alias("recorded_at"), "rul_cycles")
    log = models.ModelLog(spark, str(tmp_path / "log"))
    paths = (log, str(tmp_path / "models"), str(tmp_path / "events"))
    calm = retraining.drift_decision(features, audit(spark, 0.0), NOW).first()
    assert not calm["retrain"]
    quiet = retraining.run(spark, features, audit(spark, 0.0), rul, *paths, NOW)
    assert quiet["triggered"] is False
    few = retraining.run(spark, features, audit(spark, 9.0), rul, *paths, NOW, min_rows=10_000, sizes=SMALL)
    assert few["triggered"] and not few["trained"] and few["rows"] == 600
    first = retraining.run(spark, features, audit(spark, 9.0), rul, *paths, NOW, sizes=SMALL)
    assert first["rul_promoted"] and first["health_promoted"]
    again = retraining.run(
        spark, features, audit(spark, 0.0), rul, *paths, NOW + timedelta(hours=1), forced=True, sizes=SMALL
    )
    # The same data gives the same model, so the challenger does not win.
    assert again["trained"] and not again["rul_promoted"] and not again["health_promoted"]
    assert log.production(retraining.RUL)["version"] == 1
    events = spark.read.parquet(str(tmp_path / "events"))
    assert events.count() == 2 and events.where("drift_type = 'concept'").count() == 1
    version, model = log.load_production(retraining.RUL)
    assert version == 1 and log.load_production(retraining.RUL)[1] is model


def test_forests_remember_the_nodes_of_their_rows(fitted):
    assert all(model.stages[-1].getOrDefault("cacheNodeIds") for model in fitted)


def test_folds_are_fitted_side_by_side(data, monkeypatch):
    meet, fit = threading.Barrier(2), training.train_rul

    def together(*args, **options):
        meet.wait(timeout=60)
        return fit(*args, **options)

    monkeypatch.setattr(training, "train_rul", together)
    out = training.cross_validate(
        data, ["a", "b"], ["computed_at", "machine_id"], "rul_cycles", n_folds=2, trees=2, depth=2
    )
    assert [r["fold_id"] for r in out.orderBy("fold_id").collect()] == [0, 1]


def test_cross_validation(data):
    out = training.cross_validate(
        data, ["a", "b"], ["computed_at", "machine_id"], "rul_cycles", n_folds=2, trees=3, depth=3
    )
    assert [r["fold_id"] for r in out.orderBy("fold_id").collect()] == [0, 1]
    out = training.cross_validate(
        data, ["a", "b"], ["computed_at", "machine_id"], "health_label", n_folds=1, classify=True, trees=3, depth=3
    )
    assert 0 <= out.first()["accuracy"] <= 1


def test_queries_train_models_of_the_default_sizes(spark, monkeypatch):
    sizes = []

    def record(rows, features, *args, **options):
        sizes.append(options)
        raise StopIteration

    monkeypatch.setattr(training, "train_health", record)
    monkeypatch.setattr(training, "train_rul", record)
    monkeypatch.setattr(training, "train_rul_ensemble", record)
    monkeypatch.setattr(training, "cross_validate", record)
    names = ["rf_health", "rf_health_metrics", "feature_importance", "gbt_rul", "rul_intervals", "batch_scoring", "walk_forward_scores"]
    for name in names:
        with pytest.raises(StopIteration):
            getattr(queries_models, name)(spark, "/root/testdata/sf0.001")
    assert len(sizes) == len(names) and not any(sizes)
