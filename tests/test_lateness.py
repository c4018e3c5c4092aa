import json
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import BASE, at
from wearline.operators import quality, rolling, rules
from wearline.streaming import jobs, processors

READING = "machine_id string, recorded_at timestamp, seq long, readings map<string,double>, value string"
PRED = "machine_id string, predicted_at timestamp, seq long, rul_cycles double, health_label string, anomaly_score double"
ORDER = ["recorded_at", "seq"]


def seconds(t):
    return (t - BASE).total_seconds()


def judged(cuts, delay):
    """Rows in time that the final watermark covers, and late rows: the watermark moves after each cut."""
    passed, top, in_time, late = None, None, [], []
    for rows in cuts:
        for row in rows:
            (late if row[1] is None or (passed is not None and seconds(row[1]) <= passed) else in_time).append(row)
        newest = [seconds(r[1]) for r in rows if r[1] is not None]
        top = max([*newest, *([] if top is None else [top])], default=None)
        passed = None if top is None else top - delay
    return [r for r in in_time if seconds(r[1]) <= passed], late


def replay(spark, cuts, schema, folder, run):
    """One availableNow run per cut, each from the checkpoint of the one before."""
    for rows in cuts:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(f"{folder}/in")
        query = run(jobs.file_stream(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema))
        query.awaitTermination()
        assert query.exception() is None


def shuffled(rows, jitter, cuts, seed):
    """Rows in the order of their time plus up to ``jitter`` seconds, cut into batches."""
    draw = random.Random(seed)
    arrival = sorted(rows, key=lambda r: (0 if r[1] is None else seconds(r[1])) + draw.uniform(0, jitter))
    size = -(-len(arrival) // cuts)
    return [arrival[i : i + size] for i in range(0, len(arrival), size)]


def readings(n, seed=4):
    draw, rows = random.Random(seed), []
    for i in range(n):
        values = {k: draw.uniform(0, 9) if draw.random() > 0.1 else float("nan") for k in ("a", "b", "c") if draw.random() < 0.8}
        rows.append((draw.choice(["hot", "hot", "x", "y", " "]), at(i), i, values or {"a": 1.0}, f"raw{i}"))
    rows.append(("x", None, n, {"a": 1.0}, "no time"))
    return rows


@pytest.mark.parametrize("spread", [False, True])
def test_out_of_order_readings_give_the_batch_answer(spark, tmp_path, spread):
    jobs.use_rocksdb(spark)
    limits, as_of = quality.QualityLimits(max_null_fraction=0.5, min_sensor_count=2), F.lit(at(10_000))
    cuts = shuffled(readings(240), 25, 4, 1)
    in_time, late = judged(cuts, 10)
    assert len(late) > 5 and len(in_time) > 150
    out, partitions = str(tmp_path / "out"), defaultdict(set)

    def sink(batch, batch_id):
        batch = batch.withColumn("part", F.spark_partition_id()).persist()
        for r in batch.select("machine_id", "part").distinct().collect():
            partitions[r["machine_id"]].add((batch_id, r["part"]))
        jobs.write_batch(jobs.assembled(batch), out, batch_id)
        batch.unpersist()

    def run(stream):
        parts = jobs.feature_rows(
            stream, windows_s=[10, 40], limits=limits, as_of=as_of, fft_sensors=["a"], delay="10 seconds", spread=spread
        )
        return jobs.start(parts, sink, str(tmp_path / "cp"), available_now=True)

    replay(spark, cuts, READING, str(tmp_path), run)
    rows = jobs.read_batches(spark, out)
    got = rows.collect()
    assert sorted(r["seq"] for r in got if r["late"]) == sorted(r[2] for r in late)
    assert sorted(r["seq"] for r in got if not r["late"]) == sorted(r[2] for r in in_time)
    assert sorted(r["seq"] for r in jobs.late_rows(rows).collect()) == sorted(r[2] for r in late)
    assert {r[0]: r[1] for r in jobs.late_counts(spark, out).collect()}.keys() == {r["batch_id"] for r in rows.select("batch_id").distinct().collect()}
    batch = quality.check_quality(spark.createDataFrame(in_time, READING), limits, as_of=as_of, order=ORDER).cache()
    want, stream = {r["seq"]: r for r in batch.collect()}, {r["seq"]: r for r in got if not r["late"]}
    for seq, row in want.items():
        one = stream[seq]
        assert (one["rejected"], one["flag_bits"], one["quality_flags"]) == (row["rejected"], row["flag_bits"], row["flag_names"])
        if not row["rejected"]:
            assert one["filled"] == pytest.approx(row["filled"])
    good = batch.where(~F.col("rejected")).select("machine_id", "recorded_at", "seq", F.explode("filled").alias("sensor", "value"))
    checked = 0
    for r in rolling.rolling_stats(good, [10, 40], order=ORDER).collect():
        window = next(w for w in stream[r["seq"]]["windows"] if w["window_s"] == r["window_s"])
        for s in rolling.STATS:
            assert window["temporal"][f"{r['sensor']}_{r['window_s']}s_{s}"] == pytest.approx(r[s], abs=1e-9)
            checked += 1
        if r["sensor"] == "a":
            assert len(window["samples"]["a"]) == r["n"]
    assert checked > 2000
    if spread:
        last = max(b for b, _ in partitions["hot"])
        assert max(len([p for b, p in partitions["hot"] if b == i]) for i in range(last + 1)) > 1


def test_out_of_order_predictions_give_the_batch_answer(spark, tmp_path):
    draw = random.Random(6)
    rows = [
        (draw.choice("AB"), at(i * 600), i, draw.uniform(0, 80), draw.choice(["healthy", "critical", None]), draw.random())
        for i in range(200)
    ]
    cuts = shuffled(rows, 15_000, 3, 2)
    in_time, late = judged(cuts, 6_000)
    assert len(late) >= 5
    table, order = rules.default_rules(spark), ["predicted_at", "seq"]
    # one more unreadable rule, one more disabled: neither fires, neither disturbs
    extra = [
        ("odd", "odd", "", "info", "rul_below", {"threshold": "low"}, 1, True),
        ("off", "off", "", "info", "rul_below", {"threshold": "99"}, 1, False),
    ]
    table = table.unionByName(spark.createDataFrame(extra, table.schema))
    out = str(tmp_path / "out")
    replay(
        spark, cuts, PRED, str(tmp_path),
        lambda s: jobs.alert_job(s, table, out, str(tmp_path / "cp"), delay="6000 seconds", available_now=True),
    )
    df = rules.with_context(spark.createDataFrame(in_time, PRED), order)
    want = rules.apply_cooldown(rules.rule_hits(df, table), order)
    fired = jobs.read_batches(spark, f"{out}/fired")
    assert sorted((r["seq"], r["rule_id"]) for r in fired.collect()) == sorted((r["seq"], r["rule_id"]) for r in want.collect())
    assert sorted(r["seq"] for r in jobs.read_batches(spark, f"{out}/late").collect()) == sorted(r[2] for r in late)
    details = jobs.read_batches(spark, f"{out}/incidents").select(F.from_json("details", "rul_cycles double, health_label string, thresholds map<string,string>").alias("d"))
    assert details.where("d.rul_cycles IS NULL OR d.thresholds IS NULL").count() == 0


@pytest.mark.parametrize("spread", [False, True])
def test_idle_sensors_are_forgotten(spark, tmp_path, spread):
    """State lives for two seconds of processing time: the second run starts afresh."""
    jobs.use_rocksdb(spark)
    out = str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame(rows, READING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        parts = jobs.feature_rows(stream, windows_s=[1000], fft_sensors=[], as_of=F.lit(at(99_999)), ttl_ms=2000, spread=spread)
        done = []

        def sink(batch, batch_id):
            shaped = jobs.assembled(batch)
            jobs.write_batch(shaped, out, batch_id)
            if spark.read.parquet(f"{out}/batch_id={batch_id}").where(F.col("seq") == rows[-1][2]).count():
                done.append(batch_id)

        # state that expires keeps a stream running, so it is stopped when the rows are there
        query = jobs.start(parts, sink, str(tmp_path / "cp"), trigger="0 seconds")
        limit = time.time() + 90
        while query.exception() is None and time.time() < limit:
            # a progress report comes once the batch is committed; stopped before, it would run again
            if done and query.lastProgress is not None and query.lastProgress["batchId"] >= done[0]:
                break
            time.sleep(0.2)
        query.stop()
        assert done

    run([("A", at(i), i, {"t": float(i)}, "") for i in range(3)])
    time.sleep(4)
    run([("A", at(3), 3, {"t": 9.0}, ""), ("A", at(4), 4, {"t": 5.0}, "")])
    got = {r["seq"]: r["windows"][0]["temporal"] for r in jobs.read_batches(spark, out).collect()}
    assert got[2]["t_1000s_mean"] == 1.0
    assert "t_1000s_mean" not in got[3] and got[3]["t_cumulative_mean"] == 9.0
    assert got[4]["t_1000s_mean"] == 7.0


def test_idle_machines_are_forgotten_by_event_time(spark, tmp_path):
    jobs.use_rocksdb(spark)
    out = str(tmp_path / "out")

    def run(stream):
        parts = jobs.feature_rows(stream, windows_s=[100_000], fft_sensors=[], as_of=F.lit(at(9_999_999)), delay="0 seconds", ttl_ms=60_000)
        return jobs.start(parts, lambda b, i: jobs.write_batch(jobs.assembled(b), out, i), str(tmp_path / "cp"), available_now=True)

    cuts = [[("A", at(0), 0, {"t": 1.0}, ""), ("B", at(0), 1, {"t": 1.0}, "")]]
    cuts += [[("B", at(50 * k), 10 + k, {"t": 1.0}, "")] for k in range(1, 6)]
    cuts += [[("A", at(300), 90, {"t": 5.0}, ""), ("B", at(300), 91, {"t": 4.0}, "")]]
    replay(spark, cuts, READING, str(tmp_path), run)
    got = {r["seq"]: r["windows"][0]["temporal"] for r in jobs.read_batches(spark, out).collect()}
    assert got[90]["t_cumulative_mean"] == 5.0 and got[91]["t_cumulative_mean"] == pytest.approx(10 / 7)


class Kept:
    """State in memory that counts its calls; a map, or a list under the key None."""

    def __init__(self):
        self.held, self.calls, self.timers = {}, 0, []

    def getMapState(self, *_):
        return self.part("map")

    def getListState(self, *_):
        return self.part("list")

    def part(self, name):
        self.__dict__[name] = Kept()
        return self.__dict__[name]

    def registerTimer(self, at):
        self.timers.append(at)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def exists(self):
        return bool(self.held.get(None))

    def get(self):
        return iter(self.held[None])

    def appendList(self, rows):
        self.calls += len(rows)
        self.held[None] = [*self.held.get(None, []), *rows]

    def put(self, rows):
        self.calls += len(rows)
        self.held[None] = list(rows)

    def clear(self):
        self.held = {}


class Clock:
    def __init__(self, watermark=0, now=0):
        self.getCurrentWatermarkInMs, self.getCurrentProcessingTimeInMs = (lambda: watermark), (lambda: now)


def body(second, **readings):
    return f'{second * 1_000_000} {second} 000 {{"readings":{json.dumps(readings)},"original":null}}'


def shown(rows):
    out = []
    for row in rows:
        at, _, _, _, content = row["body"].split(" ", 4)
        out.append((row["machine_id"], int(at) // 1_000_000, {k: x["mean"] for k, x in json.loads(content)["x"].items()}))
    return sorted(out)


def test_state_calls_grow_with_machines_not_with_sensors_or_rows():
    values = {f"s{i}": float(i) for i in range(20)}
    handle = Kept()
    order = processors.ReadingProcessor(True, None, processors.SensorState([10, 40], [], 0))
    order.init(handle)
    rows = [(0, m, body(t, **values)) for m in ("A", "B") for t in (9, 3, 1, 7, 30, 5)]
    assert list(order.handleInputRows(0, iter(rows), Clock())) == []
    assert handle.list.calls == 1 and handle.timers == [1000]  # 12 rows wait in one text
    first = list(order.handleExpiredTimer(0, Clock(watermark=6000), None))
    assert [(m, t) for m, t, _ in shown(first)] == [(m, t) for m in "AB" for t in (1, 3, 5)]
    assert handle.map.calls == 4 and handle.timers[-1] == 7000  # 2 machines, once read and once written
    assert list(order.handleExpiredTimer(0, Clock(watermark=6000), None)) == []
    then = list(order.handleExpiredTimer(0, Clock(watermark=30_000), None))
    assert shown(then) == [(m, t, values) for m in "AB" for t in (7, 9, 30)]
    assert handle.map.calls == 8 and not handle.list.exists()


def test_an_idle_sensor_of_a_busy_machine_is_forgotten():
    order = processors.ReadingProcessor(False, 2000, processors.SensorState([1000], [], 0))
    order.init(Kept())
    cuts = [(0, 1, {"a": 1.0, "b": 1.0}), (1500, 2, {"a": 3.0}), (2500, 3, {"a": 5.0, "b": 9.0})]
    got = [shown(order.handleInputRows(0, iter([(0, "A", body(t, **v))]), Clock(now=now))) for now, t, v in cuts]
    assert got == [[("A", 1, {"a": 1.0, "b": 1.0})], [("A", 2, {"a": 2.0})], [("A", 3, {"a": 3.0, "b": 9.0})]]


def test_windows_by_reading_equal_whole_windows():
    from wearline.functions.windowing import MICROS, statistics
    from wearline.streaming.windows import STATS, SensorWindows

    draw = random.Random(3)
    for trial in range(120):
        windows, when, seen = [3, 10], 0, []
        buffer = SensorWindows(windows, 14 * MICROS)
        for i in range(draw.randint(1, 100)):
            when += draw.choice([0, 0, 1, 1, 2, 5]) * MICROS
            own = max(0, when - (draw.randint(0, 4) * MICROS if trial % 2 and draw.random() < 0.3 else 0))
            value = draw.choice([1.0, 2.0, 7.0, draw.gauss(0, 1), 1e9 + draw.random()])
            if trial % 10 == 9 and draw.random() < 0.05:
                value = float("inf")
            if draw.random() < 0.1:
                buffer = SensorWindows(windows, 14 * MICROS, *buffer.packed())
            buffer.push(own, value)
            seen = sorted([*seen, (own, i, value)])
            for w, (n, found, _) in zip(windows, buffer.at(own)):
                inside = [v for t, _, v in seen if own - w * MICROS <= t <= own]
                assert n == len(inside) and (found is None) == (n < 2)
                if found is None:
                    continue
                with np.errstate(all="ignore"):
                    want = statistics(inside)
                for name, got in zip(STATS, found):
                    assert np.isnan(got) == np.isnan(want[name])
                    assert np.isnan(got) or got == want[name] or got == pytest.approx(want[name], rel=1e-9, abs=1e-7)
