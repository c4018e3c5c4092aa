import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wearline.functions.windowing import statistics
from wearline.operators import quality, rolling, rules
from wearline.plans import models, retraining, training
from wearline.streaming import jobs

NAN = float("nan")


def write_cuts(spark, rows, schema, folder, cuts):
    """The same rows as one file per micro-batch, in order."""
    size = -(-len(rows) // cuts)
    for i in range(cuts):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return jobs.file_stream(spark, folder, part.schema, 1)


def drain(query):
    query.awaitTermination()
    assert query.exception() is None


READING = "machine_id string, recorded_at timestamp, seq long, readings map<string,double>, value string"


def readings(n=90):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        keys = [k for k in ("vibration_x", "vibration_y", "temp") if rng.random() < 0.85] or ["temp"]
        values = {k: (NAN if rng.random() < 0.1 else rng.uniform(0, 9)) for k in keys}
        rows.append((rng.choice("AAB"), at(i // 2 * 2), i, values, f"raw{i}"))
    return rows


@pytest.mark.parametrize("cuts", [1, 4])
def test_features_equal_batch(spark, tmp_path, cuts):
    rows = readings()
    limits = quality.QualityLimits(max_null_fraction=0.4, min_sensor_count=2)
    as_of = F.lit(at(10_000))
    order = ["recorded_at", "seq"]
    jobs.use_rocksdb(spark)
    source = write_cuts(spark, rows, READING, str(tmp_path / "in"), cuts)
    processed = jobs.feature_rows(
        source, windows_s=[10, 40], limits=limits, as_of=as_of, fft_sensors=["vibration_x"], delay_s=0
    )
    out = str(tmp_path / "out")
    drain(jobs.start(processed, lambda b, i: jobs.write_batch(b, out, i), str(tmp_path / "cp"), available_now=True))
    stream = {r["seq"]: r for r in jobs.assembled(jobs.read_batches(spark, out)).collect()}

    batch = quality.check_quality(
        spark.createDataFrame(rows, READING), limits, as_of=as_of, order=order
    ).cache()
    want = {r["seq"]: r for r in batch.collect()}
    assert stream.keys() == want.keys()
    for seq, row in want.items():
        got = stream[seq]
        assert (got["rejected"], got["flag_bits"], got["quality_flags"]) == (
            row["rejected"], row["flag_bits"], row["flag_names"],
        )
        if not row["rejected"]:
            assert got["filled"] == pytest.approx(row["filled"])

    # Rows of one time see only earlier arrivals in the stream; compare the last of each time.
    good = batch.where(~F.col("rejected")).select(
        "machine_id", "recorded_at", "seq", F.explode("filled").alias("sensor", "value")
    )
    rolled = rolling.rolling_stats(good, [10, 40], order=order).collect()
    last = {}
    for r in rolled:
        key = (r["machine_id"], r["sensor"], r["recorded_at"])
        last[key] = max(last.get(key, -1), r["seq"])
    checked = 0
    for r in rolled:
        if r["seq"] != last[(r["machine_id"], r["sensor"], r["recorded_at"])]:
            continue
        temporal = next(w["temporal"] for w in stream[r["seq"]]["windows"] if w["window_s"] == r["window_s"])
        for s in rolling.STATS:
            assert temporal[f"{r['sensor']}_{r['window_s']}s_{s}"] == pytest.approx(r[s], abs=1e-9)
            checked += 1
    assert checked > 500


def test_reset_and_late_rows(spark, tmp_path):
    schema = "machine_id string, recorded_at timestamp, seq long, readings map<string,double>, reset boolean"
    rows = [
        ("A", at(0), 0, {"t": 1.0}, False),
        ("A", at(10), 1, {"t": 3.0}, False),
        ("A", at(5), 2, {"t": 2.0}, False),  # late, in a later batch
        ("A", at(20), 3, {"t": 9.0}, True),
    ]
    source = write_cuts(spark, rows, schema, str(tmp_path / "in"), 4)
    jobs.use_rocksdb(spark)
    out = str(tmp_path / "out")
    processed = jobs.feature_rows(source, windows_s=[30], fft_sensors=[], as_of=F.lit(at(99)))
    drain(jobs.start(processed, lambda b, i: jobs.write_batch(b, out, i), str(tmp_path / "cp"), available_now=True))
    got = {r["seq"]: r["windows"][0]["temporal"] for r in jobs.assembled(jobs.read_batches(spark, out)).collect()}
    assert got[1]["t_30s_mean"] == 2.0
    assert got[2]["t_30s_mean"] == 1.5 and got[2]["t_cumulative_mean"] == 2.0
    assert "t_30s_mean" not in got[3] and got[3]["t_cumulative_mean"] == 9.0


def test_feature_job_tables(spark, tmp_path):
    texts = []
    for i in range(40):
        reading = {
            "machine_id": "A",
            "recorded_at": at(i).isoformat().replace("+00:00", "Z"),
            "readings": {"vibration_x": float(np.sin(i)), "vibration_y": float(np.cos(i)), "temp": 1.0 * i},
        }
        texts.append(json.dumps(reading))
    texts += ["not json", json.dumps({"machine_id": " ", "recorded_at": "2024-01-01T00:00:00Z", "readings": {"t": 1.0}})]
    rows = [(t, "in", 0, i) for i, t in enumerate(texts)]
    source = write_cuts(spark, rows, "value string, topic string, partition int, offset long", str(tmp_path / "in"), 2)
    out = str(tmp_path / "out")
    drain(jobs.feature_job(source, out, str(tmp_path / "cp"), windows_s=[60], available_now=True))
    assert jobs.read_batches(spark, f"{out}/readings").count() == 40
    last = jobs.read_batches(spark, f"{out}/features").orderBy(F.col("computed_at").desc()).first()
    assert last["spectral"]["vibration_x_spectral_energy"] > 0
    assert len([k for k in last["spectral"] if k.startswith("vibration_x_")]) == 11
    xs, ys = np.sin(np.arange(40)), np.cos(np.arange(40))
    assert last["correlation"]["vibration_x_x_vibration_y_pearson"] == pytest.approx(np.corrcoef(xs, ys)[0, 1])
    assert last["temporal"]["temp_60s_mean"] == pytest.approx(19.5)
    letter = json.loads(jobs.read_batches(spark, f"{out}/rejects").first()["value"])
    assert letter["reason"] == "quality_rejected" and "MISSING_ID" in letter["flags"]
    broken = json.loads(jobs.read_batches(spark, f"{out}/undecoded").first()["value"])
    assert broken["raw_payload"] == "not json" and broken["offset"] == 40


PRED = "machine_id string, predicted_at timestamp, seq long, rul_cycles double, health_label string, anomaly_score double"


@pytest.mark.parametrize("cuts", [1, 5])
def test_alerts_equal_batch(spark, tmp_path, cuts):
    rng = random.Random(6)
    rows = [
        (rng.choice("AB"), at(i * 600), i, rng.uniform(0, 80), rng.choice(["healthy", "critical"]), rng.random())
        for i in range(150)
    ]
    table = rules.default_rules(spark)
    df = spark.createDataFrame(rows, PRED)
    order = ["predicted_at", "seq"]
    batch = rules.apply_cooldown(rules.rule_hits(rules.with_context(df, order), table), order)
    want = sorted((r["seq"], r["rule_id"]) for r in batch.collect())
    source = write_cuts(spark, rows, PRED, str(tmp_path / "in"), cuts)
    out = str(tmp_path / "out")
    drain(jobs.alert_job(source, table, out, str(tmp_path / "cp"), available_now=True))
    fired = jobs.read_batches(spark, f"{out}/fired")
    assert sorted((r["seq"], r["rule_id"]) for r in fired.collect()) == want
    made = jobs.read_batches(spark, f"{out}/incidents")
    assert made.count() == len(want) and made.select("incident_id").distinct().count() == len(want)


@pytest.mark.parametrize("cuts", [1, 3])
def test_rollup_equals_batch(spark, tmp_path, cuts):
    from wearline.operators import rollups

    rows = [("A", at(i * 20), i, {"temperature": float(i)}, "") for i in range(30)]
    values = {"temperature": rollups.sensor_value("temperature")}
    source = write_cuts(spark, rows, READING, str(tmp_path / "in"), cuts)
    out = str(tmp_path / "out")
    drain(jobs.rollup_job(source, "1 minute", values, out, str(tmp_path / "cp"), available_now=True))
    want = rollups.bucket_rollup(spark.createDataFrame(rows, READING), "1 minute", values)
    columns = ["bucket", "machine_id", "avg_temperature", "reading_count"]
    got = jobs.rollup_view(spark, out).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_replayed_batch_replaces_itself(spark, tmp_path):
    df = spark.range(3)
    jobs.write_batch(df, str(tmp_path / "t"), 0)
    jobs.write_batch(df, str(tmp_path / "t"), 0)
    assert jobs.read_batches(spark, str(tmp_path / "t")).count() == 3


def test_scoring_follows_production(spark, tmp_path):
    rows = [(f"M{i % 5}", at(i), float(i), float(100 - i)) for i in range(100)]
    df = spark.createDataFrame(rows, "machine_id string, computed_at timestamp, a double, rul_cycles double")
    from wearline.operators.labels import assign_health

    labelled = assign_health(df)
    log = models.ModelLog(spark, str(tmp_path / "log"))
    for kind, model in (
        (retraining.RUL, training.train_rul_ensemble(labelled, ["a"], trees=4, depth=3)),
        (retraining.HEALTH, training.train_health(labelled, ["a"], trees=4, depth=3)),
    ):
        path = str(tmp_path / kind)
        model.write().save(path)
        log.promote(kind, log.register(kind, "run", path, at(0)), at(0))
    schema = "machine_id string, computed_at timestamp, a double"
    bad = [("", at(0), 1.0)]
    source = write_cuts(spark, [r[:3] for r in rows] + bad, schema, str(tmp_path / "in"), 2)
    out = str(tmp_path / "out")
    drain(jobs.scoring_job(source, log, ["a"], out, str(tmp_path / "cp"), available_now=True))
    scored = jobs.read_batches(spark, out)
    assert scored.count() == 100 and scored.where("rul_model_version = '1'").count() == 100


def test_statistics_helper():
    v = [3.0, 1.0, 9.0, 2.0]
    got = statistics(v)
    want = {
        "mean": np.mean(v), "std": np.std(v), "min": 1.0, "max": 9.0, "median": np.median(v),
        "rms": np.sqrt(np.mean(np.square(v))), "range": 8.0, "rate_of_change": np.abs(np.diff(v)).mean(),
    }
    assert got == pytest.approx(want)


def test_dedup_stream(spark, tmp_path):
    rows = [("A", at(i // 3), i, {}, "") for i in range(9)]
    source = write_cuts(spark, rows, READING, str(tmp_path / "in"), 3)
    once = jobs.dedup_stream(source, ["machine_id", "recorded_at"], "recorded_at", "1 hour")
    out = str(tmp_path / "out")
    drain(jobs.start(once, lambda b, i: jobs.write_batch(b, out, i), str(tmp_path / "cp"), available_now=True))
    assert jobs.read_batches(spark, out).count() == 3
