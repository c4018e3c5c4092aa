import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wearline.operators import assemble, columns, rollups
from wearline.sources import cmapss, messages, snapshots, tables


def text_file(folder, name, rows):
    path = folder / f"train_{name}.txt"
    path.write_text("".join("  ".join(str(x) for x in r) + "  \n" for r in rows))


def engine_rows(engine, cycles, base):
    return [[engine, c, 0.1, 0.2, 100.0] + [base + c * (s + 1) for s in range(20)] + [7.0] for c in range(1, cycles + 1)]


def test_cmapss(spark, tmp_path):
    text_file(tmp_path, "FD001", engine_rows(1, 4, 0.0) + engine_rows(2, 2, 0.0))
    text_file(tmp_path, "FD003", engine_rows(1, 3, 50.0))
    df = cmapss.load(spark, str(tmp_path), ["FD001", "FD003"])
    rows = {(r["dataset_id"], r["engine_id"], r["cycle"]): r for r in df.collect()}
    assert len(rows) == 9
    assert rows[("FD001", 1, 1)]["rul"] == 3 and rows[("FD001", 2, 2)]["rul"] == 0
    assert rows[("FD001", 1, 1)]["fan_inlet_temp"] == 0.0 and rows[("FD001", 1, 4)]["fan_inlet_temp"] == 1.0
    assert rows[("FD001", 1, 4)]["hpb_bleed_coolant"] == 0.0  # constant
    assert rows[("FD001", 1, 4)]["op_setting_3"] == 100.0
    reading = cmapss.readings(df).where("machine_id = 'CMAPSS-FD003-0001' AND cycle = 2").first()
    assert reading["recorded_at"].isoformat() == "2020-01-01T00:00:02"
    assert len(reading["readings"]) == 21 and reading["operational"]["op_setting_1"] == 0.1
    kept = cmapss.readings(df).select(assemble.drop_sensors("readings", cmapss.LOW_VARIANCE).alias("m")).first()
    assert len(kept["m"]) == 17


def test_cmapss_refusals(spark, tmp_path):
    with pytest.raises(ValueError):
        cmapss.scan_text(spark, str(tmp_path), ["FD009"])
    text_file(tmp_path, "FD002", [[1, 2, 3]])
    with pytest.raises(Exception, match="expected 26 columns"):
        cmapss.scan_text(spark, str(tmp_path), ["FD002"]).collect()


GOOD = {"machine_id": "M", "recorded_at": "2024-01-01T00:00:00Z", "readings": {"a": 1.0}}


def decoded(spark, *payloads, kind="reading"):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    raw = spark.createDataFrame([(t, "in", 0, i) for i, t in enumerate(texts)], "value string, topic string, partition int, offset long")
    return messages.decode(raw, kind)


def test_decode_readings(spark):
    df = decoded(
        spark,
        GOOD,
        "this is not valid json {{{@@@",
        {**GOOD, "machine_id": ""},
        {k: v for k, v in GOOD.items() if k != "readings"},
        {**GOOD, "readings": {"a": None}},
        '{"machine_id": "M", "recorded_at": "2024-01-01T00:00:00Z", "readings": {"a": NaN}}',
        {**GOOD, "recorded_at": "yesterday"},
        {**GOOD, "cycle": 7, "operational": {"o": 2.0}},
    )
    rows = sorted(df.collect(), key=lambda r: r["offset"])
    assert [r["parse_error"] for r in rows] == [False, True, True, True, True, False, True, False]
    assert rows[0]["operational"] == {} and rows[0]["cycle"] is None
    assert rows[7]["cycle"] == 7 and rows[7]["operational"] == {"o": 2.0}


def test_decode_features_and_predictions(spark):
    f = {"machine_id": "M", "computed_at": "2024-01-01T00:00:00Z", "window_s": 10}
    row = decoded(spark, f, kind="features").first()
    assert not row["parse_error"] and row["feature_version"] == "v1" and row["temporal"] == {}
    p = {
        "machine_id": "M", "predicted_at": "2024-01-01T00:00:00Z", "rul_cycles": 5.0, "rul_hours": 2.5,
        "rul_lower_bound": 1.0, "rul_upper_bound": 9.0, "health_label": "healthy", "anomaly_score": 0.1,
        "confidence": 0.9, "rul_model_version": "1", "health_model_version": "1",
    }
    good, bad = decoded(spark, p, {**p, "health_label": "fine"}, kind="prediction").orderBy("offset").collect()
    assert not good["parse_error"] and good["latency_ms"] == 0 and bad["parse_error"]


def test_round_trip_and_envelopes(spark):
    good, broken = messages.split_decoded(decoded(spark, GOOD, "{{{"))
    out = messages.encode(good.select("machine_id", "recorded_at", "readings"), times=["recorded_at"]).first()
    assert out["key"] == "M" and json.loads(out["value"]) == GOOD
    letter = json.loads(messages.decode_envelope(broken, "g").first()["value"])
    assert letter == {"source_topic": "in", "partition": 0, "offset": 1, "group_id": "g", "raw_payload": "{{{"}
    flags = F.array(F.lit("MISSING_ID"))
    stage = json.loads(messages.stage_envelope(good, "quality_rejected", flags, F.lit(at(0))).first()["value"])
    assert stage["flags"] == ["MISSING_ID"] and stage["dlq_at"] == "2024-01-01T00:00:00Z"
    assert json.loads(stage["original"]) == GOOD


def day_rows(spark, n=6):
    return spark.createDataFrame(
        [("M" if i % 2 else "N", at(i * 86400), i, float(i)) for i in range(n)],
        "machine_id string, recorded_at timestamp, cycle int, value double",
    )


def test_day_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_by_day(day_rows(spark), path, "recorded_at")
    out = tables.read_range(spark, path, "recorded_at", "2024-01-02", "2024-01-04")
    assert sorted(r["cycle"] for r in out.collect()) == [1, 2, 3]
    plan = out._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan
    only = tables.machine_cycles(spark, path, "2024-01-01", "2024-01-10", ["M"])
    assert sorted(r["cycle"] for r in only.collect()) == [1, 3, 5]
    assert tables.apply_retention(spark, path, "2024-01-06", 2) == 3
    assert sorted(r["cycle"] for r in tables.read_range(spark, path, "recorded_at").collect()) == [3, 4, 5]
    replaced = day_rows(spark).where("cycle = 5").withColumn("value", F.lit(50.0))
    tables.overwrite_days(replaced, path, "recorded_at")
    got = {r["cycle"]: r["value"] for r in tables.read_range(spark, path, "recorded_at").collect()}
    assert got == {3: 3.0, 4: 4.0, 5: 50.0}


def test_weekly_chunks(spark):
    df = spark.createDataFrame([(at(i * 86400),) for i in range(14)], "t timestamp")
    assert df.select(tables.day_of(F.col("t"), 7)).distinct().count() <= 3


def test_keyed_writes(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, v int")
    assert [tuple(r) for r in tables.insert_if_absent(old, new, ["k"]).collect()] == [("b", 3)]
    log = spark.createDataFrame([("a", 1, 1), ("a", 5, 2), ("b", 3, 1)], "k string, v int, no int")
    assert {r["k"]: r["v"] for r in tables.latest_by_key(log, ["k"], ["no"]).collect()} == {"a": 5, "b": 3}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("M", 1.0, None, 5, "healthy", "train"), ("N", 2.0, 3.0, 6, "critical", "test")]
    df = spark.createDataFrame(rows, "machine_id string, f double, g double, rul_cycles int, health_label string, split string")
    snapshots.save_snapshot(df, path, "v1", ["f", "g"], "2024-02-01 00:00:00")
    test = snapshots.load_snapshot(spark, path, "v1", "test").first()
    assert (test["f"], test["g"], test["health_label"]) == (2.0, 3.0, "critical")
    with pytest.raises(ValueError):
        snapshots.load_snapshot(spark, path, "v1", "validation")
    with pytest.raises(ValueError):
        snapshots.load_snapshot(spark, path, "v1", "other")
    with pytest.raises(Exception, match="invalid split"):
        snapshots.save_snapshot(df.withColumn("split", F.lit("x")), path, "v2", ["f"], "2024-02-01 00:00:00")
    assert columns.feature_columns(snapshots.load_snapshot(spark, path, "v1", "test")) == ["f", "g"]


def test_rollup_refresh(spark):
    from datetime import timedelta

    rows = [("M", at(s), {"temperature": float(s)}) for s in range(0, 600, 30)]
    df = spark.createDataFrame(rows, "machine_id string, recorded_at timestamp, readings map<string,double>")
    full = rollups.rollup_readings(df, "1 minute", extremes=["temperature"])
    first = {r["bucket"]: r for r in full.collect()}
    assert len(first) == 10
    one = first[min(first)]
    assert (one["avg_temperature"], one["avg_pressure"], one["max_temperature"], one["reading_count"]) == (15.0, None, 30.0, 2)
    start, end = rollups.refresh_range(at(600), timedelta(minutes=5, seconds=30), timedelta(minutes=1), timedelta(minutes=1))
    assert (start, end) == (at(300), at(540))
    stale = full.withColumn("avg_temperature", F.lit(-1.0))
    merged = rollups.refreshed_rollup(stale, full, start, end).where("avg_temperature <> -1").collect()
    assert len(merged) == 4


def test_selectors(spark):
    df = day_rows(spark)
    assert columns.numeric_columns(df) == ["cycle", "value"]
    with pytest.raises(ValueError, match=r"\['x', 'y'\]"):
        columns.require(df, ["y", "x", "value"])
    merged = spark.sql("SELECT map('a', 1D) AS temporal, map('a', 2D, 'b', 3D) AS spectral, CAST(NULL AS map<string,double>) AS correlation")
    assert merged.select(assemble.merge_maps().alias("m")).first()["m"] == {"a": 2.0, "b": 3.0}
    both = assemble.union_all([df.select("machine_id"), df.select("machine_id", "cycle")])
    assert both.count() == 12 and both.where("cycle IS NULL").count() == 6
