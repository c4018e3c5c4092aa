import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wearline.functions import spectral
from wearline.operators import correlation

FS, N = 100.0, 512
T = np.arange(N) / FS


def run(spark, *signals, **kw):
    rows = [(i, "vib", [float(x) for x in s]) for i, s in enumerate(signals)]
    df = spark.createDataFrame(rows, "id int, sensor string, samples array<double>")
    return sorted(spectral.with_spectral(df, FS, **kw).collect(), key=lambda r: r["id"])


def test_sine_noise_and_bands(spark):
    sine = np.sin(2 * np.pi * 10 * T)
    noise = np.random.default_rng(0).normal(size=N)
    low = np.sin(2 * np.pi * 15 * T)
    a, b, c, d = run(spark, sine, 2 * sine, noise, low)
    assert abs(a["dominant_freq_hz"] - 10) <= 2 * FS / N
    assert b["spectral_energy"] == pytest.approx(4 * a["spectral_energy"], rel=0.01)
    assert c["spectral_entropy"] > 3.0 and c["spectral_entropy"] > a["spectral_entropy"]
    assert sum(d[x] for x in spectral.BANDS) <= d["spectral_energy"] * 1.0001
    assert sum(f.startswith("cepstral_") for f in spectral.FEATURES) == 5


def test_matches_definition(spark):
    x = np.random.default_rng(1).normal(size=65)
    (row,) = run(spark, x)
    n, centred = len(x), x - x.mean()
    k = np.arange(n // 2 + 1)
    spectrum = (centred * np.exp(-2j * np.pi * np.outer(k, np.arange(n)) / n)).sum(axis=1)
    power = np.abs(spectrum) ** 2
    p = power / power.sum()
    assert row["spectral_energy"] == pytest.approx(power.sum())
    assert row["dominant_freq_hz"] == pytest.approx(k[power.argmax()] * FS / n)
    assert row["spectral_entropy"] == pytest.approx(-(p * np.log(p + 1e-12)).sum())


def test_constant_signal_has_uniform_entropy(spark):
    (row,) = run(spark, np.full(64, 3.0))
    assert row["spectral_entropy"] == pytest.approx(np.log(33), rel=1e-6)


def test_gates(spark):
    assert run(spark, np.ones(31)) == []
    assert run(spark, T, sensors=["other"]) == []
    df = spark.createDataFrame([(0, "vib", [1.0])], "id int, sensor string, samples array<double>")
    with pytest.raises(ValueError):
        spectral.with_spectral(df, 0.0)
    with pytest.raises(ValueError):
        spectral.with_spectral(df, FS, min_samples=3)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=64, max_size=512))
def test_finite_input_gives_finite_output(values):
    out = spectral._block(np.array([values]), np.array([FS]))
    assert np.isfinite(out).all()


def test_callable_from_sql(spark):
    spectral.register(spark)
    row = spark.sql(
        "SELECT spectral_features(transform(sequence(0, 63), x -> sin(x)), 100D) AS s"
    ).first()
    assert row["s"]["spectral_energy"] > 0


def test_pearson_against_numpy_with_tail_alignment(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=30), rng.normal(size=24)
    df = spark.createDataFrame(
        [([float(x) for x in a], [float(x) for x in b], [1.0] * 30)],
        "a array<double>, b array<double>, c array<double>",
    )
    row = df.select(
        correlation.array_pearson(F.col("a"), F.col("b")).alias("ab"),
        correlation.array_pearson(F.col("a"), F.col("c")).alias("ac"),
        correlation.array_pearson(F.col("a"), F.col("b"), 25).alias("short"),
    ).first()
    assert row["ab"] == pytest.approx(np.corrcoef(a[-24:], b)[0, 1])
    assert row["ac"] is None and row["short"] is None


def test_pearson_work_grows_with_the_samples_not_their_square(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 400))
    df = spark.createDataFrame(
        [(a.tolist(), b.tolist()), ([], [1.0] * 12), (None, [1.0] * 12), ([float("nan"), *a[:11].tolist()], b[:12].tolist())],
        "a array<double>, b array<double>",
    )
    out = df.select(correlation.array_pearson(F.col("a"), F.col("b")).alias("ab"))
    # means stood inside the lambdas of deviations, made anew for every sample: 30 slices in the plan
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("slice(") == 2 and plan.count("aggregate(") == 5
    found = [r["ab"] for r in out.collect()]
    assert found[0] == pytest.approx(np.corrcoef(a, b)[0, 1]) and found[1:3] == [None, None] and np.isnan(found[3])


def test_rolling_pearson_sliced_equals_whole(spark):
    from tests.conftest import at

    rng = np.random.default_rng(4)
    rows = [("M", at(i), float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "machine_id string, recorded_at timestamp, a double, b double")
    def result(length, aligned):
        out = correlation.rolling_pearson(df, ["a", "b"], 20, aligned=aligned, slice_length=length)
        return {r["recorded_at"]: r["a_x_b_pearson"] for r in out.collect()}

    whole = result(None, False)
    assert whole == pytest.approx(result(25_000_000, False))
    assert whole == pytest.approx(result(None, True))
    assert correlation.sensor_pairs(["z", "a", "m"]) == [("a", "m"), ("a", "z"), ("m", "z")]
