import math
import random

import numpy as np
import pytest

from tests.conftest import at
from wearline.operators import correlation, moving, rolling

STATS = rolling.STATS
SCHEMA = "machine_id string, sensor string, recorded_at timestamp, seq long, value double"


def expected(values, steps):
    """Statistics of one frame as Spark's aggregates define them: NaN is greatest, nulls are left out."""
    x = np.array(values)
    with np.errstate(all="ignore"):
        numbers, ordered, n = x[~np.isnan(x)], np.sort(x), len(x)
        top = math.nan if np.isnan(x).any() else x.max()
        low = numbers.min() if len(numbers) else math.nan
        return {
            "mean": x.mean(),
            "std": x.std() if np.isfinite(x).all() else math.nan,
            "min": low,
            "max": top,
            "median": ordered[n // 2] if n % 2 else 0.5 * ordered[n // 2 - 1] + 0.5 * ordered[n // 2],
            "rms": np.sqrt((x * x).mean()),
            "range": top - low,
            "rate_of_change": sum(steps) / (n - 1) if n > 1 else None,
        }


def same(got, want):
    if want is None or got is None:
        return got is want
    return got == want or (math.isnan(got) and math.isnan(want)) or got == pytest.approx(want, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("odd", [False, True])
def test_columns_equal_brute_force(odd):
    rng = np.random.default_rng(odd)
    for _ in range(150):
        n = int(rng.integers(1, 60))
        groups = np.cumsum(rng.random(n) < 0.1) - 0
        times = np.concatenate([np.sort(rng.integers(0, 30, (groups == g).sum())) for g in np.unique(groups)])
        values = rng.choice([1.0, 2.0, 3.5, -4.0, 5e5, rng.normal()], n)
        valid = np.ones(n, bool)
        if odd:
            values[rng.random(n) < 0.1] = rng.choice([np.nan, np.inf, -np.inf])
            valid = rng.random(n) > 0.2
        window = int(rng.integers(0, 12))
        frames = moving.Frames(groups, times, 12)
        column = moving.Column(values, valid, frames.low(window), frames.high, frames.start)
        with np.errstate(all="ignore"):
            found = {s: getattr(column, s) for s in STATS}
        for i in range(n):
            rows = [j for j in range(n) if groups[j] == groups[i] and times[i] - window <= times[j] <= times[i]]
            inside = [values[j] for j in rows if valid[j]]
            assert column.count[i] == len(inside)
            steps = [abs(values[j] - values[j - 1]) for j in rows[1:] if valid[j] and valid[j - 1]]
            if not inside:
                continue
            for s, want in expected(inside, steps).items():
                assert want is None or same(found[s][i], want), (s, inside)


def test_selection_of_any_rank():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 100):
        values = rng.integers(0, 9, n)
        chosen = moving.Selection(values)
        low = rng.integers(0, n, 200)
        high = low + 1 + (rng.random(200) * (n - low)).astype(int)
        k = (rng.random(200) * (high - low)).astype(int)
        want = [np.sort(values[a:b])[i] for a, b, i in zip(low, high, k)]
        assert chosen.smallest(low, high, k).tolist() == want


def test_small_spread_far_from_zero_and_beside_an_outlier():
    """What differences of prefix sums would lose."""
    values = np.array([1e12, 1e-3, 2e-3, 3e-3, 1e9, 1e9 + 1e-3, 1e9 + 2e-3])
    low, high = np.array([1, 4, 1]), np.array([4, 7, 2])
    column = moving.Column(values, np.ones(7, bool), low, high, np.zeros(7, int))
    assert column.std == pytest.approx([np.std(values[1:4]), np.std(values[4:7]), 0.0], rel=1e-6)
    assert column.std[2] == 0.0


def frames_of(spark, rows, windows, **kw):
    out = rolling.rolling_stats(spark.createDataFrame(rows, SCHEMA), windows, order=["recorded_at", "seq"], **kw)
    return {(r["machine_id"], r["seq"], r["window_s"]): r for r in out.collect()}


@pytest.mark.parametrize("length", [None, 90_000_000])
def test_batches_do_not_matter(spark, monkeypatch, length):
    """Tiny batches and work units, many ties, null keys, times and values."""
    draw = random.Random(7)
    rows = []
    for i in range(600):
        machine = draw.choice(["hot", "hot", "hot", "b", None, "c"])
        when = None if draw.random() < 0.03 else at(draw.randrange(0, 120))
        rows.append((machine, "s", when, i, None if draw.random() < 0.1 else draw.uniform(-9, 9)))
    want = frames_of(spark, rows, [5, 60])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(moving, "LEAST_ROWS", 10)
    try:
        got = frames_of(spark, rows, [5, 60], slice_length=length)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert all(same(got[key][c], row[c]) for c in ["n", *STATS]), key
    for m, s, t, seq, _ in rows:
        inside = [r[4] for r in rows if r[0] == m and r[4] is not None and (r[2] == t if t is None or r[2] is None else 0 <= (t - r[2]).total_seconds() <= 60)]
        row = got.get((m, seq, 60))
        assert (row is None) == (len(inside) < 2)
        if row is not None:
            assert row["n"] == len(inside) and row["mean"] == pytest.approx(np.mean(inside)) and row["median"] == pytest.approx(np.median(inside))


def test_a_frame_wider_than_the_work_unit(spark, monkeypatch):
    monkeypatch.setattr(moving, "LEAST_ROWS", 50)
    rows = [("M", "s", at(i), i, float(i % 17)) for i in range(3000)]
    got = frames_of(spark, rows, [100_000], slice_length=None)
    for i in (1, 49, 50, 1234, 2999):
        x = np.arange(i + 1) % 17
        assert (got[("M", i, 100_000)]["mean"], got[("M", i, 100_000)]["median"]) == (pytest.approx(x.mean()), np.median(x))


def test_pairs_leave_out_rows_without_both(spark):
    draw = random.Random(5)
    rows = [(draw.choice("AB"), at(i // 2), *(None if draw.random() < 0.2 else draw.gauss(0, 3) for _ in range(2)), 4.0) for i in range(300)]
    rows += [("C", at(i), 2.0, float(i), 4.0) for i in range(20)]
    df = spark.createDataFrame(rows, "machine_id string, recorded_at timestamp, a double, b double, c double")
    got = correlation.rolling_pearson(df, ["a", "b", "c"], 30, min_samples=5).collect()
    assert len(got) == len(rows) and all(r["a_x_c_pearson"] is None for r in got)
    checked = 0
    for r in got:
        inside = [x for x in rows if x[0] == r["machine_id"] and 0 <= (r["recorded_at"].timestamp() - x[1].timestamp()) <= 30 and None not in x]
        if len(inside) < 5 or r["machine_id"] == "C":
            assert r["a_x_b_pearson"] is None
            continue
        checked += 1
        assert r["a_x_b_pearson"] == pytest.approx(np.corrcoef([x[2] for x in inside], [x[3] for x in inside])[0, 1])
    assert checked > 200
