import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wearline.operators import quality

SCHEMA = "machine_id string, recorded_at timestamp, seq long, readings map<string,double>"
ORDER = ["recorded_at", "seq"]
NAN = float("nan")
NOW = at(0)


def check(spark, rows, limits=quality.QualityLimits(), **kw):
    rows = [(m, at(t), i, v) for i, (m, t, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = quality.check_quality(df, limits, as_of=F.lit(NOW), order=ORDER, **kw)
    return sorted(out.collect(), key=lambda r: r["seq"])


def five(first=10.0):
    return {"a": first, "b": 11.0, "c": 12.0, "d": 13.0, "e": 14.0}


@pytest.mark.parametrize("blank", ["", "   "])
def test_blank_id_rejected(spark, blank):
    (row,) = check(spark, [(blank, -5, five())])
    assert row["rejected"] and row["flag_names"] == ["MISSING_ID"] and row["flag_bits"] == 1


def test_future(spark):
    far, near, edge = check(spark, [("A", 600, five()), ("B", 100, five()), ("C", 300, five())])
    assert far["rejected"] and far["flag_names"] == ["FUTURE_TIMESTAMP"]
    assert not near["rejected"] and near["flag_names"] == []
    assert not edge["rejected"]  # the limit itself is allowed


def test_null_fractions(spark):
    many = {k: (NAN if k != "e" else 14.0) for k in "abcde"}
    (row,) = check(spark, [("A", -5, many)])
    assert row["rejected"] and row["flag_names"] == ["NULL_FRACTION_HIGH"]
    loose = quality.QualityLimits(max_null_fraction=0.5)
    first, second = check(spark, [("A", -5, five()), ("A", -4, five(NAN))], loose)
    assert second["flag_names"] == ["NULL_FRACTION_LOW"] and second["filled"]["a"] == 10.0
    (alone,) = check(spark, [("A", -5, five(NAN))], loose)
    assert alone["filled"]["a"] == 0.0


def test_outlier_kept(spark):
    values = {"a": 1.0, "b": 1.1, "c": 1.2, "d": 1.3, "e": 999999.0}
    (row,) = check(spark, [("A", -5, values)])
    assert row["flag_names"] == ["OUTLIER_DETECTED"] and not row["rejected"]
    assert row["filled"]["e"] == 999999.0


def test_duplicate_and_count(spark):
    first, second = check(spark, [("A", -5, five()), ("A", -5, five())])
    assert first["flag_names"] == [] and second["flag_names"] == ["DUPLICATE_TIMESTAMP"]
    (few,) = check(spark, [("A", -5, {"a": 1.0, "b": 2.0})], quality.QualityLimits(min_sensor_count=10))
    assert few["flag_names"] == ["SENSOR_COUNT_LOW"] and not few["rejected"]


def test_limit_is_checked():
    with pytest.raises(ValueError):
        quality.QualityLimits(max_null_fraction=1.5)


def plain_loop(rows, limits):
    """The stateful rules as an ordinary loop over readings."""
    last, out = {}, []
    for machine, when, readings in rows:
        nulls = sum(math.isnan(v) for v in readings.values())
        rejected = nulls / max(len(readings), 1) > limits.max_null_fraction
        seen = last.get(machine)
        duplicate = seen is not None and seen[0] == when
        filled = dict(readings)
        if not rejected:
            filled = {
                k: ((seen[1].get(k, 0.0) if seen else 0.0) if math.isnan(v) else v) for k, v in readings.items()
            }
            last[machine] = (when, filled)
        out.append((rejected, duplicate, filled))
    return out


@pytest.mark.parametrize("slice_length", [None, 9_000_000])
@pytest.mark.parametrize("names", [["a", "b", "c", "d", "e"], []])
def test_fill_matches_plain_loop(spark, slice_length, names):
    """Known vocabulary and open vocabulary, sliced and not."""
    rng = random.Random(5)
    rows = []
    for i in range(160):
        keys = [k for k in "abcde" if rng.random() < 0.8] or ["a"]
        values = {k: (NAN if rng.random() < 0.2 else rng.uniform(0, 9)) for k in keys}
        rows.append((rng.choice(["A", "A", "B"]), -200 + i // 2, values))
    limits = quality.QualityLimits()
    want = plain_loop(rows, limits)
    got = check(spark, rows, limits, sensors=names, slice_length=slice_length)
    for row, (rejected, duplicate, filled) in zip(got, want, strict=True):
        assert row["rejected"] == rejected
        assert ("DUPLICATE_TIMESTAMP" in row["flag_names"]) == duplicate
        if not rejected:
            assert row["filled"] == pytest.approx(filled)


def test_split(spark):
    rows = [("A", at(-5), 0, five()), ("", at(-4), 1, five())]
    df = spark.createDataFrame(rows, SCHEMA)
    good, bad = quality.accepted_and_rejected(quality.check_quality(df, as_of=F.lit(NOW), order=ORDER))
    assert good.count() == 1 and bad.count() == 1
    assert good.first()["quality_flags"] == []
