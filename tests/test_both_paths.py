"""Rows with null times, null keys, NaN and odd rule bounds get the same result on every physical path."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wearline.operators import asof, assemble, drift, labels, rolling, rules, slices, splits
from wearline.schemas import RULE
from wearline.streaming import jobs

ORDER = ["recorded_at", "seq"]


def readings(spark):
    rows = [("M1", "s", at(i) if i % 5 else None, i, float(i)) for i in range(40)]
    rows += [(None, "s", at(i), 100 + i, float(i)) for i in range(5)]
    return spark.createDataFrame(rows, "machine_id string, sensor string, recorded_at timestamp, seq long, value double")


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("stats", [["mean", "std", "min"], ["median"], ["rate_of_change"]])
def test_null_times_in_windows(spark, stats):
    df = readings(spark)
    plain, sliced = (rolling.rolling_stats(df, [10], order=ORDER, stats=stats, slice_length=n) for n in (None, 7_000_000))
    assert bag(plain) == bag(sliced) and plain.where("recorded_at IS NULL").count() > 0


def test_null_times_in_running_values(spark):
    plain, sliced = (
        slices.running(readings(spark), ["machine_id"], ORDER, [slices.Running("n", "sum", F.col("value"))], slice_length=n)
        for n in (None, 3_000_000)
    )
    assert bag(plain) == bag(sliced) and plain.count() == 45


PRED = "machine_id string, predicted_at timestamp, seq long, rul_cycles double, health_label string, anomaly_score double"
NAN = float("nan")


@pytest.mark.parametrize("limit", [rules.INLINE_LIMIT, 0])
def test_nan_and_null_fire_nothing(spark, limit):
    rows = [(NAN, "healthy", NAN), (None, None, None), (90.0, "healthy", 0.1), (NAN, "healthy", 0.1), (80.0, "healthy", 0.1)]
    df = spark.createDataFrame([("M1", at(i), i, *r) for i, r in enumerate(rows)], PRED)
    hits = rules.rule_hits(rules.with_context(df, ["predicted_at", "seq"]), rules.default_rules(spark), limit)
    assert hits.collect() == []


@pytest.mark.parametrize("limit", [rules.INLINE_LIMIT, 0])
def test_one_reading_of_bounds(spark, limit):
    bounds = {"a": "1_0", "b": "10d", "c": "0x1p4", "d": " 1e1 ", "e": "+10.", "f": ".5", "g": "nan", "h": "Infinity", "i": "", "j": None}
    table = [(k, k, "", "info", "rul_below", {"threshold": v}, 60, True) for k, v in bounds.items()]
    df = spark.createDataFrame([("M1", at(0), 0, 5.0, "healthy", 0.0)], PRED)
    hits = rules.rule_hits(rules.with_context(df, ["predicted_at", "seq"]), spark.createDataFrame(table, RULE), limit)
    assert sorted(r.rule_id for r in hits.collect()) == ["d", "e"]


def test_time_mode_of_expiring_state():
    assert jobs._time_mode(None) == "none" and jobs._time_mode(5) == "processingTime"


def test_null_keys_stay(spark):
    df = spark.createDataFrame([("A", 1), ("A", 3), (None, 2), (None, 5)], "machine_id string, cycle int")
    assert sorted((r.cycle, r.rul_cycles) for r in labels.assign_rul(df).collect()) == [(1, 2), (2, 3), (3, 0), (5, 0)]
    scaled = assemble.minmax_scale(df.withColumn("x", F.col("cycle").cast("double")), ["x"], ["machine_id"])
    assert sorted((r.cycle, r.x) for r in scaled.collect()) == [(1, 0.0), (2, 0.0), (3, 1.0), (5, 1.0)]
    split = spark.createDataFrame([("A", "train"), (None, "test")], "machine_id string, split string")
    assert sorted(r.split for r in splits.with_split(df, split).collect()) == ["test", "test", "train", "train"]


def test_asof_ignores_right_rows_without_time(spark):
    left = spark.createDataFrame([("A", 5)], "k string, t long")
    right = spark.createDataFrame([("A", None, "never"), ("A", 3, "this"), (None, 4, "other")], "k string, u long, v string")
    assert [r.v for r in asof.asof_backward(left, right, by=["k"], left_on="t", right_on="u", take=["v"]).collect()] == ["this"]


def test_drift_on_odd_samples(spark):
    a = spark.createDataFrame([(float(i),) for i in range(50)] + [(math.inf,), (-math.inf,), (NAN,), (None,)], "x double")
    row = drift.ks_test(a, a, ["x"]).first()
    assert row.n_reference == 52 and row.ks_statistic == 0 and not row.drifted
    with pytest.raises(ValueError):
        drift.ks_test(a, a.limit(0), ["x"])
    for bad in (NAN, math.inf, None):
        errors = spark.createDataFrame([(1.0, 0), (bad, 1)], "e double, side int")
        with pytest.raises(ValueError):
            drift.concept_drift(errors, "e", "side")
    assert drift.concept_drift(spark.createDataFrame([(1.0, 0)], "e double, side int"), "e", "side").first().detected is False
