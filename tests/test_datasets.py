import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wearline.operators import ordering, sequences, slices, splits
from wearline.operators.asof import asof_backward
from wearline.plans import offline
from wearline.sources import snapshots, tables


@pytest.mark.parametrize("length", [None, 13_000_000])
def test_asof(spark, length):
    rng = random.Random(2)
    left = [(rng.choice("AAAB"), at(rng.randrange(100)), i) for i in range(120)]
    right = [(rng.choice("AAB"), at(rng.randrange(100)), i, float(i)) for i in range(40)]
    ldf = spark.createDataFrame(left, "k string, t timestamp, id int")
    rdf = spark.createDataFrame(right, "k string, u timestamp, no int, v double")
    out = asof_backward(
        ldf, rdf, by=["k"], left_on="t", right_on="u", take=["v", "u"], right_ties=["no"], slice_length=length
    )
    got = {r["id"]: r["v"] for r in out.collect()}
    want = {}
    for k, t, i in left:
        before = [(u, no, v) for kk, u, no, v in right if kk == k and u <= t]
        want[i] = max(before)[2] if before else None
    assert got == want


@pytest.mark.parametrize("kind", ["sum", "count", "min", "max", "last"])
@pytest.mark.parametrize("include", [True, False])
def test_running_sliced_equals_whole(spark, kind, include):
    rng = random.Random(9)
    rows = [
        (rng.choice(["hot", "hot", "cold", None]), rng.randrange(50), i, None if rng.random() < 0.2 else rng.uniform(-3, 3))
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double")
    value = slices.Running("out", kind, F.col("v"))

    def result(length):
        out = slices.running(df, ["k"], ["t", "i"], [value], include_current=include, slice_length=length)
        return {r["i"]: r["out"] for r in out.collect()}

    whole, cut = result(None), result(4)
    for i, want in whole.items():
        if want is None:
            assert cut[i] is None
        else:
            assert cut[i] == pytest.approx(want)


def test_slice_length_reacts_to_a_hot_key(spark):
    df = spark.range(10_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.col("id").alias("t")
    )
    assert slices.slice_length(df, ["k"], "t", rows=20_000) is None
    length = slices.slice_length(df, ["k"], "t", rows=500)
    sizes = df.groupBy("k", F.floor(F.col("t") / length)).count()
    assert sizes.agg(F.max("count")).first()[0] <= 1_000


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    got = [(r["a"], r["b"]) for r in ordering.with_position(df, ["a", "b"]).orderBy("position").collect()]
    assert got == sorted(got) and len(got) == 1000
    assert ordering.with_position(df, ["a", "b"]).agg(F.max("position")).first()[0] == 999


def machines(spark, n):
    return spark.createDataFrame([(f"M{i:03d}",) for i in range(n)], "machine_id string")


def sizes(frame):
    return {r["split"]: r["count"] for r in frame.groupBy("split").count().collect()}


def test_splits(spark):
    assert sizes(splits.machine_split(machines(spark, 20))) == {"train": 14, "validation": 3, "test": 3}
    assert sizes(splits.machine_split(machines(spark, 3), 0.1, 0.1)) == {"train": 1, "validation": 1, "test": 1}
    assert sizes(splits.tail_split(machines(spark, 15))) == {"train": 11, "validation": 2, "test": 2}
    with pytest.raises(ValueError):
        splits.machine_split(machines(spark, 2))
    with pytest.raises(ValueError):
        splits.machine_split(machines(spark, 9), 0.9, 0.2)
    with pytest.raises(ValueError):
        splits.machine_split(machines(spark, 0))


def test_folds(spark):
    df = spark.range(23).withColumnRenamed("id", "t")
    out = splits.walk_forward_folds(df, ["t"], 3, gap=1)
    n, block = 23, 23 // 4
    for fold in range(3):
        end = n - (3 - fold) * block
        rows = out.where(F.col("fold_id") == fold)
        train = sorted(r["t"] for r in rows.where("role = 'train'").collect())
        test = sorted(r["t"] for r in rows.where("role = 'test'").collect())
        assert train == list(range(end)) and test == list(range(end + 1, min(end + 1 + block, n)))
    with pytest.raises(ValueError):
        splits.walk_forward_folds(spark.range(5).withColumnRenamed("id", "t"), ["t"], 3)


@pytest.mark.parametrize("length", [None, 5])
def test_sequences(spark, length):
    rows = [("A", c, float(c), c * 10) for c in range(12)] + [("B", c, float(c), c) for c in range(2)]
    df = spark.createDataFrame(rows, "machine_id string, cycle long, f double, y int")
    out = sequences.sliding_sequences(df, ["f"], "y", 3, slice_length=length)
    got = {r["cycle"]: (r["sequence"], r["label"]) for r in out.collect()}
    assert got == {c: ([[c - 2.0], [c - 1.0], [float(c)]], c * 10) for c in range(2, 12)}
    short = sequences.short_sequences(df, ["f"], "y", 3).collect()
    assert [(r["machine_id"], r["sequence"], r["label"]) for r in short] == [("B", [[0.0], [0.0], [1.0]], 1)]
    assert sequences.flat_names(["f"], 1) == ["f"] and sequences.flat_names(["f"], 2) == ["f_t0", "f_t1"]


def test_offline_job(spark, tmp_path):
    features, readings, snaps = (str(tmp_path / n) for n in ("f", "r", "s"))
    rows, cycles = [], []
    for m in range(10):
        for c in range(30):
            cycles.append((f"M{m}", at(c * 60), c))
            rows.append((f"M{m}", at(c * 60 + 5), 10, {"a": float(c)}, {}, {"p": 0.5}, "v1"))
    tables.write_by_day(
        spark.createDataFrame(
            rows,
            "machine_id string, computed_at timestamp, window_s int, temporal map<string,double>, "
            "spectral map<string,double>, correlation map<string,double>, feature_version string",
        ),
        features,
        "computed_at",
    )
    tables.write_by_day(
        spark.createDataFrame(cycles, "machine_id string, recorded_at timestamp, cycle int"), readings, "recorded_at"
    )
    offline.run(spark, features, readings, snaps, "v1", "2024-01-01", "2024-01-02", "2024-02-01 00:00:00")
    train = snapshots.load_snapshot(spark, snaps, "v1", "train")
    assert train.count() == 7 * 30
    assert train.where("temporal__a + rul_cycles <> 29").count() == 0
    assert {"temporal__a", "correlation__p"} <= set(train.columns)
    with pytest.raises(ValueError):
        tables.extract_window(spark, features, "2025-01-01", "2025-01-02")
