"""Queries that run a stream over the given tables to its end and read the result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wearline import session
from wearline.operators import rollups
from wearline.plans import roles
from wearline.plans.catalog import E_LONG, ntz, query, rounded
from wearline.plans.queries_features import _bucket_sql
from wearline.plans.queries_fleet import _COOLED, stretched_rules
from wearline.plans.queries_stats import _MESSAGE_SQL, raw_messages
from wearline.plans.roles import DAY_S
from wearline.sources import daystore
from wearline.streaming import jobs

_WINDOWS = [DAY_S, 7 * DAY_S]
_STATS = {
    "mean": "avg(value) OVER w",
    "std": "stddev_pop(value) OVER w",
    "min": "min(value) OVER w",
    "max": "max(value) OVER w",
    "median": "median(value) OVER w",
    "rms": "sqrt(avg(value * value) OVER w)",
    "range": "max(value) OVER w - min(value) OVER w",
}


def _folder(spark, name):
    return f"{session.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, folder):
    """Events as a file stream; the schema comes from the stored table."""
    schema = roles.table(spark, folder, "events").schema
    return jobs.file_stream(spark, f"{folder}/events*.parquet", schema)


def _finish(query_handle):
    query_handle.awaitTermination()
    if query_handle.exception() is not None:
        raise query_handle.exception()


def _feature_sql(source: str) -> str:
    """Every feature of every reading of ``source``, by name."""
    parts = []
    for w in _WINDOWS:
        cols = ", ".join(f"{sql} AS {name}" for name, sql in _STATS.items())
        inner = (
            f"SELECT machine_id, recorded_at, sensor, count(*) OVER w AS n, list(value) OVER w AS vs, {cols} FROM {source} WINDOW w AS "
            f"(PARTITION BY machine_id, sensor ORDER BY recorded_at RANGE BETWEEN INTERVAL {w} SECOND "
            "PRECEDING AND CURRENT ROW)"
        )
        parts.append(
            f"SELECT machine_id, recorded_at, {w} AS window_s, sensor || '_{w}s_' || name AS name, "
            "round(value, 6) + 0.0 AS value FROM (SELECT * EXCLUDE (vs), list_avg([abs(vs[i] - vs[i - 1]) "
            f"for i in generate_series(2, len(vs))]) AS rate_of_change FROM ({inner}) WHERE n >= 2) "
            f"UNPIVOT (value FOR name IN ({', '.join(_STATS)}, rate_of_change))"
        )
        for name, total in (("mean", "avg"), ("max", "max")):
            parts.append(
                f"SELECT machine_id, recorded_at, {w}, sensor || '_cumulative_{name}', round({total}(value) OVER c, 6) + 0.0 "
                f"FROM {source} WINDOW c AS (PARTITION BY machine_id, sensor ORDER BY recorded_at, event_id "
                "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            )
    return " UNION ALL ".join(parts)


def _event_readings(events):
    """Every event a one-sensor reading."""
    return events.select(
        F.col("user_id").cast("string").alias("machine_id"),
        F.col("ts").alias("recorded_at"),
        F.col("event_id").alias("seq"),
        F.create_map("event_type", "value").alias("readings"),
    )


def _named(features):
    rows = features.select(
        "machine_id",
        F.col("computed_at").alias("recorded_at"),
        "window_s",
        F.explode("temporal").alias("name", "value"),
    )
    return rounded(ntz(rows, "recorded_at"), ["value"])


@query("stream_features", f"WITH {E_LONG} " + _feature_sql("e"))
def stream_features(spark, folder):
    """Every event a one-sensor reading; keyed state computes what the batch windows compute."""
    jobs.use_rocksdb(spark)
    processed = jobs.feature_rows(_event_readings(_events(spark, folder)), windows_s=_WINDOWS, fft_sensors=[])
    out = _folder(spark, "features")

    def sink(batch, batch_id):
        jobs.write_batch(jobs.computed_features(jobs.assembled(batch), fft_sensors=[]), out, batch_id)

    _finish(jobs.start(processed, sink, f"{out}-cp", available_now=True))
    return _named(jobs.read_batches(spark, out))


_CUTS, _DELAY_S = 4, 2 * DAY_S
_ARRIVAL_SQL = f"""{E_LONG}, a AS (SELECT *, epoch_us(recorded_at) + event_id * 7919 % 97 * 3600000000 AS arrival FROM e),
b AS (SELECT *, (arrival - min(arrival) OVER ()) * {_CUTS} // (max(arrival) OVER () - min(arrival) OVER () + 1) AS cut FROM a),
m AS (SELECT cut, max(max(epoch_ms(recorded_at))) OVER (ORDER BY cut) AS top FROM b GROUP BY cut),
x AS (SELECT b.*, coalesce((SELECT max(top) FROM m WHERE m.cut < b.cut) - {_DELAY_S} * 1000, 0) * 1000 AS passed FROM b),
t AS (SELECT * FROM x WHERE epoch_us(recorded_at) > passed
  AND epoch_us(recorded_at) <= ((SELECT max(top) FROM m) - {_DELAY_S} * 1000) * 1000)"""


def _arrivals(spark, folder):
    """Events with the cut in which they arrive: up to four days behind their time."""
    events = roles.table(spark, folder, "events")
    arrival = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") * 7919 % 97 * 3_600_000_000
    rows = events.withColumn("_arrival", arrival)
    low, high = rows.agg(F.min("_arrival"), F.max("_arrival")).first()
    place = (F.col("_arrival") - low) * _CUTS
    return rows.withColumn("_cut", F.floor(place / (high - low + 1))).drop("_arrival")


def _replayed(spark, rows, name, run):
    """Hands the cuts to a stream one after the other; ``run(stream)`` starts it, each time from its checkpoint."""
    source = _folder(spark, name)
    kept = rows.drop("_cut")
    for cut in range(_CUTS):
        rows.where(F.col("_cut") == cut).drop("_cut").write.mode("append").parquet(source)
        _finish(run(jobs.file_stream(spark, source, kept.schema)))


@query(
    "stream_late_features",
    f"""WITH {_ARRIVAL_SQL}, f AS ({_feature_sql("t")})
    SELECT 'feature' AS outcome, machine_id, recorded_at, window_s, name, value FROM f
    UNION ALL SELECT 'late', machine_id, recorded_at, NULL, sensor, round(value, 6) + 0.0 FROM x
      WHERE epoch_us(recorded_at) <= passed""",
)
def stream_late_features(spark, folder):
    """Readings out of order over four micro-batches: those in time give the batch's features, the others are listed."""
    jobs.use_rocksdb(spark)
    out = _folder(spark, "ordered")

    def sink(batch, batch_id):
        rows = jobs.assembled(batch).persist()
        jobs.write_batch(jobs.computed_features(rows, fft_sensors=[]), f"{out}/features", batch_id)
        jobs.write_batch(jobs.late_rows(rows), f"{out}/late", batch_id)
        rows.unpersist()

    def run(stream):
        parts = jobs.feature_rows(
            _event_readings(stream), windows_s=_WINDOWS, fft_sensors=[], delay=f"{_DELAY_S} seconds"
        )
        return jobs.start(parts, sink, f"{out}-cp", available_now=True)

    _replayed(spark, _arrivals(spark, folder), "arrivals", run)
    features = _named(jobs.read_batches(spark, f"{out}/features")).withColumn("outcome", F.lit("feature"))
    late = jobs.read_batches(spark, f"{out}/late").select(
        F.lit("late").alias("outcome"),
        "machine_id",
        F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"),
        F.lit(None).cast("int").alias("window_s"),
        F.explode("readings").alias("name", "value"),
    )
    return features.unionByName(rounded(late, ["value"]))


_SIGNAL_HZ = 100.0


def _signal_sql() -> str:
    """Two signals of 32 samples per vector; spectra of whole signals, correlations from ten samples on."""
    return f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    r AS (SELECT vec_id, j, v[j + 1] AS vibration_x, v[j + 33] AS vibration_y
      FROM (SELECT vec_id, v, unnest(generate_series(0, 31)) AS j FROM v)),
    s AS (SELECT vec_id, j, sensor, x - avg(x) OVER (PARTITION BY vec_id, sensor) AS x
      FROM r UNPIVOT (x FOR sensor IN (vibration_x, vibration_y))),
    f AS (SELECT vec_id, sensor, k, sum(x * cos(2 * pi() * k * j / 32)) AS re, sum(x * sin(2 * pi() * k * j / 32)) AS im
      FROM s, unnest(generate_series(0, 16)) AS t(k) GROUP BY ALL),
    p AS (SELECT *, re * re + im * im AS pw, k * {_SIGNAL_HZ}::DOUBLE / 32 AS hz FROM f),
    o AS (SELECT vec_id, j, covar_pop(vibration_x, vibration_y) OVER w
        / (stddev_pop(vibration_x) OVER w * stddev_pop(vibration_y) OVER w) AS rho FROM r
      WINDOW w AS (PARTITION BY vec_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT vec_id, 31 AS sample, sensor || '_spectral_energy' AS name, round(sum(pw), 5) + 0.0 AS value FROM p GROUP BY ALL
    UNION ALL SELECT vec_id, 31, sensor || '_dominant_freq_hz', round(arg_max(hz, pw), 5) + 0.0 FROM p GROUP BY ALL
    UNION ALL SELECT vec_id, 31, sensor || '_band_mid_energy', round(sum(CASE WHEN hz >= 5 AND hz < 15 THEN pw ELSE 0 END), 5) + 0.0
      FROM p GROUP BY ALL
    UNION ALL SELECT vec_id, 31, sensor || '_band_high_energy', round(sum(CASE WHEN hz >= 15 AND hz < 25 THEN pw ELSE 0 END), 5) + 0.0
      FROM p GROUP BY ALL
    UNION ALL SELECT vec_id, j, 'vibration_x_x_vibration_y_pearson', round(rho, 5) + 0.0 FROM o WHERE j >= 9"""


@query("stream_signals", _signal_sql())
def stream_signals(spark, folder):
    """Each vector a machine with two vibration sensors: the stream's spectral and correlation groups."""
    jobs.use_rocksdb(spark)
    vectors = jobs.file_stream(
        spark, f"{folder}/embeddings*.parquet", roles.table(spark, folder, "embeddings").schema
    )
    sensors = ["vibration_x", "vibration_y"]
    samples = vectors.select(
        F.col("vec_id").cast("string").alias("machine_id"),
        F.posexplode(F.slice("embedding", 1, 32)).alias("j", "x"),
        F.col("embedding"),
    )
    readings = samples.select(
        "machine_id",
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("j")).alias("recorded_at"),
        F.col("j").cast("long").alias("seq"),
        F.create_map(
            F.lit(sensors[0]), F.col("x").cast("double"), F.lit(sensors[1]), F.get("embedding", F.col("j") + 32).cast("double")
        ).alias("readings"),
    )
    parts = jobs.feature_rows(readings, windows_s=[60], fft_sensors=sensors)
    out = _folder(spark, "signals")

    def sink(batch, batch_id):
        rows = jobs.computed_features(jobs.assembled(batch), fft_sensors=sensors, rate_hz=_SIGNAL_HZ)
        jobs.write_batch(rows, out, batch_id)

    _finish(jobs.start(parts, sink, f"{out}-cp", available_now=True))
    wanted = ["spectral_energy", "dominant_freq_hz", "band_mid_energy", "band_high_energy"]
    names = [f"{s}_{f}" for s in sensors for f in wanted] + ["vibration_x_x_vibration_y_pearson"]
    found = jobs.read_batches(spark, out).select(
        F.col("machine_id").cast("long").alias("vec_id"),
        (F.unix_seconds("computed_at") - 1_700_000_000).cast("int").alias("sample"),
        F.explode(F.map_concat("spectral", "correlation")).alias("name", "value"),
    )
    return rounded(found.where(F.col("name").isin(names)), ["value"], 5)


@query("stream_rollup", _bucket_sql("day"))
def stream_rollup(spark, folder):
    events = _events(spark, folder).select(
        F.col("user_id").cast("string").alias("machine_id"),
        F.col("event_type").alias("sensor"),
        F.col("ts").alias("recorded_at"),
        "value",
    )
    values = {s: F.when(F.col("sensor") == s, F.col("value")) for s in ("click", "view", "error")}
    out = _folder(spark, "rollup")
    _finish(
        jobs.rollup_job(
            events, "1 day", values, out, f"{out}-cp", extremes=["view"], available_now=True
        )
    )
    view = ntz(jobs.rollup_view(spark, out), "bucket")
    return rounded(view, [c for c in view.columns if c[:4] in ("avg_", "min_", "max_")])


_ALL_EVENTS = ["click", "view", "signup", "purchase", "error"]
_REFRESH_SQL = (
    "SELECT date_trunc('hour', ts) AS bucket, CAST(user_id AS VARCHAR) AS machine_id, "
    + ", ".join(f"round(avg(value) FILTER (event_type = '{s}'), 6) + 0.0 AS avg_{s}" for s in _ALL_EVENTS)
    + ", round(min(value) FILTER (event_type = 'view'), 6) + 0.0 AS min_view, "
    "round(max(value) FILTER (event_type = 'view'), 6) + 0.0 AS max_view, "
    "count(*) AS reading_count FROM events GROUP BY ALL"
)


@query("rollup_refresh", _REFRESH_SQL)
def rollup_refresh(spark, folder):
    """Events arrive out of order in four batches; after each, their days are merged and only those rolled up again."""
    events = _arrivals(spark, folder).select(
        F.col("user_id").cast("string").alias("machine_id"),
        F.col("event_type").alias("sensor"),
        F.col("ts").alias("recorded_at"),
        "value",
        "_cut",
    )
    source = _folder(spark, "batches")
    base, rolled = (daystore.DayStore(spark, _folder(spark, n)) for n in ("readings", "hourly"))
    values = {s: F.when(F.col("sensor") == s, F.col("value")) for s in _ALL_EVENTS}
    for cut in range(_CUTS):
        jobs.write_batch(events.where(F.col("_cut") == cut).drop("_cut"), source, cut)
        base.absorb(source, "recorded_at")
        rolled.follow(base, lambda df: rollups.bucket_rollup(df, "1 hour", values, extremes=["view"]), "bucket")
    view = ntz(rolled.read(), "bucket")
    return rounded(view, [c for c in view.columns if c[:4] in ("avg_", "min_", "max_")])


@query(
    "stream_alerts",
    _COOLED
    + """ SELECT h.machine_id, h.rule_id, h.event_id, h.severity,
      '[' || upper(severity) || '] ' || h.machine_id || ': ' || rule_name AS title
    FROM chain c JOIN hits h USING (machine_id, rule_id, event_id) WHERE fired""",
)
def stream_alerts(spark, folder):
    number = F.get_json_object("props", "$.k").cast("double")
    predictions = _events(spark, folder).select(
        F.col("user_id").cast("string").alias("machine_id"),
        F.col("ts").alias("predicted_at"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("rul_cycles"),
        (number / 100).alias("anomaly_score"),
        roles.mapped(F.col("event_type"), roles.LABEL_OF_EVENT).alias("health_label"),
    )
    out = _folder(spark, "alerts")
    _finish(
        jobs.alert_job(predictions, stretched_rules(spark), out, f"{out}-cp", available_now=True)
    )
    fired = jobs.read_batches(spark, f"{out}/fired").select(
        "machine_id", "predicted_at", "rule_id", F.col("seq").alias("event_id"), "severity"
    )
    made = jobs.read_batches(spark, f"{out}/incidents").select(
        "machine_id", "rule_id", F.col("triggered_at").alias("predicted_at"), "title"
    )
    return fired.join(made, ["machine_id", "rule_id", "predicted_at"]).drop("predicted_at")


@query(
    "stream_decode",
    f"""WITH {_MESSAGE_SQL} SELECT 'undecoded' AS outcome, count(*) FILTER (broken) AS n FROM g
    UNION ALL SELECT 'rejects', count(*) FILTER (rejected) FROM g
    UNION ALL SELECT 'readings', count(*) FILTER (NOT broken AND NOT rejected) FROM g""",
)
def stream_decode(spark, folder):
    """JSON messages written from the events, streamed into readings and both dead-letter tables."""
    source, out = _folder(spark, "messages"), _folder(spark, "decoded")
    raw_messages(spark, folder).write.parquet(source)
    raw = jobs.file_stream(spark, source, spark.read.parquet(source).schema)
    _finish(
        jobs.feature_job(raw, out, f"{out}-cp", windows_s=[DAY_S], fft_sensors=[], available_now=True)
    )
    parts = [
        jobs.read_batches(spark, f"{out}/{name}").agg(F.count("*").alias("n")).select(
            F.lit(name).alias("outcome"), "n"
        )
        for name in ("undecoded", "rejects", "readings")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
