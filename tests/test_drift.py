import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.functions.tails import student_upper
from tests.conftest import at
from wearline.operators import drift, slices
from wearline.plans import retraining

RNG = np.random.default_rng(7)


def frame(spark, **columns):
    rows = list(zip(*[[float(x) for x in c] for c in columns.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))


@pytest.mark.parametrize(
    "t, df, p",
    # Published table values of Student's distribution.
    [(1.812461, 10, 0.05), (2.228139, 10, 0.025), (1.644854, 1e7, 0.05), (0.0, 5, 0.5), (6.313752, 1, 0.05)],
)
def test_student_tail(t, df, p):
    assert student_upper(t, df) == pytest.approx(p, abs=1e-6)
    assert student_upper(-t, df) == pytest.approx(1 - p, abs=1e-6)


def test_stable_and_shifted(spark):
    ref = RNG.normal(size=500)
    same = drift.ks_test(frame(spark, f=ref), frame(spark, f=RNG.normal(size=500)), ["f"])
    report = drift.data_drift_report(same).first()
    assert not report["detected"] and report["recommendation"] in ("ok", "monitor")
    moved = drift.ks_test(frame(spark, f=ref), frame(spark, f=RNG.normal(3, 1, 500)), ["f"])
    report = drift.data_drift_report(moved).first()
    assert report["detected"] and report["recommendation"] == "retrain"


def test_only_the_shifted_feature_is_listed(spark):
    a = frame(spark, x=RNG.normal(size=400), y=RNG.normal(size=400))
    b = frame(spark, x=RNG.normal(size=400), y=RNG.normal(5, 1, 400))
    report = drift.data_drift_report(drift.ks_test(a, b, ["x", "y"])).first()
    assert report["affected_features"] == ["y"]


def test_statistic_against_plain_ecdf_sliced_or_not(spark):
    a, b = RNG.integers(0, 40, 300) / 8.0, RNG.integers(5, 45, 200) / 8.0
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    for rows in ("2000000", "10"):
        spark.conf.set(slices.ROWS_SETTING, rows)
        try:
            got = drift.ks_test(frame(spark, f=a), frame(spark, f=b), ["f"]).first()
        finally:
            spark.conf.unset(slices.ROWS_SETTING)
        assert got["ks_statistic"] == pytest.approx(want)


def test_empty_feature_is_left_out(spark):
    ref = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    cur = spark.createDataFrame([(1.0, 3.0)], "x double, y double")
    assert [r["feature"] for r in drift.ks_test(ref, cur, ["x", "y"]).collect()] == ["x"]
    with pytest.raises(ValueError):
        drift.ks_test(ref, cur, ["z"])


def sides(spark, base, late):
    rows = [(float(x), 0) for x in base] + [(float(x), 1) for x in late]
    return spark.createDataFrame(rows, "e double, side int")


def test_concept_drift(spark):
    up = drift.concept_drift(
        sides(spark, RNG.uniform(0, 5, 200), RNG.uniform(30, 40, 200)), "e", "side"
    ).first()
    assert up["detected"] and up["recommendation"] == "retrain"
    flat = drift.concept_drift(
        sides(spark, RNG.uniform(0, 5, 300), RNG.uniform(0, 5, 300)), "e", "side"
    ).first()
    assert not flat["detected"]
    const = drift.concept_drift(sides(spark, [2.0] * 50, [5.0] * 50), "e", "side").first()
    assert const["error_increase"] == pytest.approx(1.5) and const["p_value"] == 0.0


def test_error_validation(spark):
    with pytest.raises(ValueError):
        drift.validate_errors(sides(spark, [], [1.0]), "e", "side")
    with pytest.raises(ValueError):
        drift.validate_errors(sides(spark, [1.0], [float("inf")]), "e", "side")
    assert drift.validate_errors(sides(spark, [1.0], [2.0, 3.0]), "e", "side") == {0: 1, 1: 2}


def test_compare_rul(spark):
    y = RNG.uniform(0, 100, 300)
    df = frame(spark, y=y, b=y + RNG.normal(0, 9, 300), c=y + RNG.normal(0, 2, 300))
    assert drift.compare_rul(df, "y", "b", "c").first()["recommendation"] == "promote"
    back = drift.compare_rul(df, "y", "c", "b").first()
    assert not back["challenger_better"] and back["recommendation"] == "inconclusive"
    same = drift.compare_rul(df, "y", "b", "b").first()
    assert not same["challenger_better"] and same["recommendation"] == "discard"


def test_compare_health_gate(spark):
    rows = []
    for i in range(200):
        y = i % 4
        base = [0.2] * 4
        base[y] = 0.4 + 0.001 * (i % 7)
        chal = list(base)
        if y == 3:  # worse on the critical class, better elsewhere
            chal = [0.5, 0.1, 0.1, 0.3]
        else:
            chal[y] = 0.7
        rows.append((y, base, chal))
    df = spark.createDataFrame(rows, "y int, b array<double>, c array<double>")
    row = drift.compare_health(df, "y", "b", "c").first()
    assert row["baseline_recall"] == 1.0 and row["challenger_recall"] == 0.0
    assert not row["recall_held"] and not row["challenger_better"]


def test_class_helpers(spark):
    df = spark.createDataFrame([([0.3, 0.4, 0.4],)], "p array<double>")
    row = df.select(
        drift.first_max_index(F.col("p")).alias("i"), drift.one_hot(F.lit(5), 4).alias("h")
    ).first()
    assert row["i"] == 1 and row["h"] == [0.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_broken_predictions_are_refused_not_dropped(spark, bad):
    rows = [(at(-86_400 * d), 10.0 if d > 7 else bad, 9.0) for d in range(1, 15)]
    rows += [(at(0), None, 1.0), (at(0), 1.0, None)]
    audit = spark.createDataFrame(rows, "created_at timestamp, predicted_rul double, actual_rul double")
    kept = retraining.error_rows(audit, at(0))
    assert kept.count() == 14
    with pytest.raises(ValueError, match="non-finite"):
        drift.concept_drift(kept, "abs_error", "side")
