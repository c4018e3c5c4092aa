import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wearline.operators import rolling

SCHEMA = "machine_id string, sensor string, recorded_at timestamp, seq long, value double"
ORDER = ["recorded_at", "seq"]


def series(spark, values, machine="M1", sensor="s", step=1):
    rows = [(machine, sensor, at(i * step), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def last_row(df, window=None):
    out = df if window is None else df.where(F.col("window_s") == window)
    return out.orderBy(F.col("seq").desc()).first()


@pytest.mark.parametrize(
    "values, stat, expected",
    [
        (range(1, 6), "mean", 3.0),
        ([42] * 10, "std", 0.0),
        ([5] * 8, "rms", 5.0),
        ([10, 20, 30, 40], "rate_of_change", 10.0),
        ([10, 20, 30, 40, 50], "range", 40.0),
        ([1, 2, 3, 4], "median", 2.5),
    ],
)
def test_reference_values(spark, values, stat, expected):
    out = rolling.rolling_stats(series(spark, values), [30], order=ORDER)
    assert last_row(out)[stat] == pytest.approx(expected)


def test_windows_differ_and_single_sample_is_silent(spark):
    out = rolling.rolling_stats(series(spark, range(70)), [30, 60], order=ORDER).cache()
    assert last_row(out, 30)["mean"] != last_row(out, 60)["mean"]
    assert rolling.rolling_stats(series(spark, [1.0]), [30], order=ORDER).count() == 0


def test_machines_do_not_mix(spark):
    both = series(spark, [1, 2, 3, 4], "A").unionByName(series(spark, [100, 200, 300, 400], "B"))
    out = rolling.rolling_stats(both, [30], order=ORDER, stats=["mean"])
    means = {r["machine_id"]: r["mean"] for r in out.where("seq = 3").collect()}
    assert means == {"A": 2.5, "B": 250.0}


def test_nan_inside_does_not_fail(spark):
    out = rolling.rolling_stats(series(spark, [1.0, float("nan"), 3.0]), [30], order=ORDER)
    assert math.isnan(last_row(out)["mean"])


def test_cumulative(spark):
    out = rolling.cumulative_stats(series(spark, range(1, 21)), order=ORDER)
    assert last_row(out)["cumulative_mean"] == pytest.approx(10.5)
    out = rolling.cumulative_stats(series(spark, [3, 1, 9, 2, 4]), order=ORDER)
    assert last_row(out)["cumulative_max"] == 9.0


def test_segments_restart_only_their_machine(spark):
    both = series(spark, [1, 2, 3, 4], "A").unionByName(series(spark, [1, 2, 3, 4], "B"))
    reset = (F.col("machine_id") == "A") & (F.col("seq") == 2)
    cut = rolling.with_segment(both, reset, order=ORDER)
    out = rolling.cumulative_stats(cut, keys=["machine_id", "segment_id"], order=ORDER)
    means = {r["machine_id"]: r["cumulative_mean"] for r in out.where("seq = 3").collect()}
    assert means == {"A": 3.5, "B": 2.5}


def test_names(spark):
    out = rolling.rolling_stats(series(spark, [1, 2]), [30], order=ORDER, stats=["mean"])
    assert rolling.named_features(out, ["mean"]).first()["name"] == "s_30s_mean"


def brute(rows, windows):
    out = {}
    for m, s, t, seq, _ in rows:
        for w in windows:
            inside = sorted(
                (r[2], r[3], r[4]) for r in rows if r[0] == m and r[1] == s and 0 <= (t - r[2]).total_seconds() <= w
            )
            v = np.array([x[2] for x in inside])
            if len(v) >= 2:
                out[(m, s, seq, w)] = (
                    len(v), v.mean(), v.std(), v.min(), v.max(), np.median(v),
                    math.sqrt((v * v).mean()), v.max() - v.min(), np.abs(np.diff(v)).mean(),
                )
    return out


@pytest.mark.parametrize("slice_length", [None, 25_000_000, 7_000_000])
def test_matches_brute_force_sliced_or_not(spark, slice_length):
    rng = random.Random(3)
    times = sorted(rng.sample(range(400), 120))
    rows = [
        # One machine holds most rows, as a hot key would.
        ("hot" if i % 4 else "cold", rng.choice("ab"), at(t), i, rng.uniform(-5, 5))
        for i, t in enumerate(times)
    ]
    windows = [10, 45]
    df = spark.createDataFrame(rows, SCHEMA)
    out = rolling.rolling_stats(df, windows, order=ORDER, slice_length=slice_length).collect()
    got = {
        (r["machine_id"], r["sensor"], r["seq"], r["window_s"]): (r["n"], *[r[s] for s in rolling.STATS])
        for r in out
    }
    want = brute(rows, windows)
    assert got.keys() == want.keys()
    for key, values in want.items():
        # STATS: mean std min max median rms range rate_of_change
        assert got[key] == pytest.approx(values, abs=1e-9)


def test_row_cap_keeps_newest(spark):
    out = rolling.rolling_capped(series(spark, range(10)), 100, 0.015, order=ORDER)
    assert last_row(out)["samples"] == [7.0, 8.0, 9.0]
    out = rolling.rolling_capped(series(spark, range(10), step=10), 15, 1.0, order=ORDER)
    assert last_row(out)["samples"] == [8.0, 9.0]
