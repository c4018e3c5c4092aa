import pytest
from pyspark.sql import functions as F

from wearline.operators import labels, metrics

SCHEMA = "machine_id string, cycle int"


def ruls(spark, rows, **kw):
    out = labels.assign_rul(spark.createDataFrame(rows, SCHEMA), **kw)
    return {(r["machine_id"], r["cycle"]): r["rul_cycles"] for r in out.collect()}


def test_rul(spark):
    assert list(ruls(spark, [("M", c) for c in range(1, 6)]).values()) == [4, 3, 2, 1, 0]
    assert ruls(spark, [("M", c) for c in range(1, 101)])[("M", 1)] == 99
    assert max(ruls(spark, [("M", c) for c in range(1, 51)], cap=10).values()) == 10
    both = ruls(spark, [("A", 1), ("A", 2), ("A", 3), ("B", 1), ("B", 2)])
    assert both[("A", 1)] == 2 and both[("B", 1)] == 1


def test_rul_errors(spark):
    df = spark.createDataFrame([("M", 1)], SCHEMA)
    with pytest.raises(ValueError):
        labels.assign_rul(df, cap=0)
    with pytest.raises(ValueError, match=r"\['cycle'\]"):
        labels.assign_rul(df.drop("cycle"))


def test_health(spark):
    expected = {
        "healthy": [100, 150, 200],
        "degrading": [50, 75, 99],
        "critical": [20, 30, 49],
        "imminent_failure": [0, 5, 10, 19],
    }
    rows = [(r, name) for name, rs in expected.items() for r in rs]
    out = labels.assign_health(spark.createDataFrame(rows, "rul_cycles int, want string"))
    assert out.where("health_label <> want").count() == 0
    with pytest.raises(ValueError):
        labels.health_of(F.col("rul_cycles"), {"healthy": 1})


def test_serving_labels_include_their_limit(spark):
    df = spark.createDataFrame([(30.0,), (90.0,), (180.0,), (181.0,)], "r double")
    got = [r[0] for r in df.select(labels.serving_health_of(F.col("r"))).collect()]
    assert got == ["imminent_failure", "critical", "degrading", "healthy"]


def test_class_weights_balance(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "health_label string")
    got = {r["health_label"]: r["weight"] for r in labels.class_weights(df).collect()}
    assert got == pytest.approx({"a": 8 / 12, "b": 2.0})


def test_metrics_on_known_values(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 17.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    import math

    assert row["mae"] == 2.5 and row["rmse"] == pytest.approx(math.sqrt(6.5))
    assert row["r2"] == pytest.approx(1 - 13 / 50)
    assert row["phm_score"] == pytest.approx(math.exp(0.2) - 1 + math.exp(3 / 13) - 1)
