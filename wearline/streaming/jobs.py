"""Streaming jobs: features, roll-ups, alerts, scoring.

Sinks run in ``foreachBatch`` and overwrite one folder per batch id, so a
replayed batch replaces its own output. Sources should set a per-trigger limit;
it bounds what one key can bring into one micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wearline.functions.spectral import FEATURES, spectral_features
from wearline.operators import quality, rollups, rules
from wearline.operators.correlation import array_pearson, sensor_pairs
from wearline.operators.incidents import build_incidents
from wearline.schemas import DEFAULT_WINDOWS_S, RULE
from wearline.sources import messages, tables
from wearline.streaming.processors import (
    FIRED,
    NO_TIME,
    ORDERED,
    PARTS,
    CooldownProcessor,
    PredictionOrder,
    ReadingOrder,
    ReadingProcessor,
    SensorState,
    WindowProcessor,
)
from wearline.streaming.windows import STATS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH = "batch_id"
# Sensors with spectral features, their sampling rate and gates.
FFT_SENSORS = ["vibration_rms", "vibration_x", "vibration_y"]
FFT_RATE_HZ = 100.0
FFT_MIN_SAMPLES = 32
PEARSON_MIN_SAMPLES = 10
LATE_LABEL = "\x00late"
#: Groups of state. Each is one unit of work, so there are several for every task of a large cluster.
BUCKETS = 1024


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def dedup_stream(df: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row per key of a stream; keys are remembered for ``delay`` of event time."""
    timed = df.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch: writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def start(
    df: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    *,
    mode: str = "append",
    available_now: bool = False,
    trigger: str = "5 seconds",
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


# --- readings to features ------------------------------------------------------


def _ordered(df: DataFrame, time: str, delay: str | None) -> tuple[DataFrame, str]:
    """``df`` with its watermark set, and the time mode of the ordering step.

    The time goes on as a number: what the ordering step finds late is its own
    to report, so no row may be dropped before it.
    """
    timed = df.withColumn(time, F.col(time).cast("timestamp"))
    if delay is None:
        return timed, "none"
    return timed.withWatermark(time, delay), "eventTime"


def feature_rows(
    readings: DataFrame,
    *,
    windows_s: list[int] = DEFAULT_WINDOWS_S,
    limits: quality.QualityLimits = quality.QualityLimits(),
    as_of=None,
    fft_sensors: list[str] = FFT_SENSORS,
    delay: str | None = None,
    delay_s: int = 0,
    ttl_ms: int | None = None,
    spread: bool = False,
) -> DataFrame:
    """Decoded readings (with ``seq`` and ``value``) to processed rows, which ``assembled`` puts into shape.

    By machine, readings are put in order and take from the reading before what
    quality needs; the windows of a machine's sensors are kept in the same step.
    With ``spread`` they are kept in a second step by machine and sensor, for
    machines with more readings than a task can take. Rejection and outliers are
    expressions. Results do not depend on ``spread``.

    With ``delay`` a reading waits until the watermark, that far behind the
    newest time, has passed it; one that comes later than that is marked
    ``late`` and changes nothing. Without it readings are taken as they come, and
    one behind its time is put into windows that still reach it (``delay_s``
    keeps samples longer for such). A key without readings for ``ttl_ms`` is
    forgotten.
    """
    clock = F.current_timestamp() if as_of is None else as_of
    flags = quality.stateless_flags(limits, clock)
    reject = flags["MISSING_ID"] | flags["FUTURE_TIMESTAMP"] | flags["NULL_FRACTION_HIGH"]
    original = F.col("value") if "value" in readings.columns else F.lit(None)
    reset = F.col("reset") if "reset" in readings.columns else F.lit(False)
    timed, mode = _ordered(readings, "recorded_at", delay)
    marks = F.concat(*[_digit(m) for m in (reject, reset, F.col("_nulls") > 0)])
    content = F.struct("readings", original.cast("string").alias("original"))
    keyed = quality.null_counts(timed).select(_bucket("machine_id"), "machine_id", _text("recorded_at", marks, _json(content)).alias("body"))
    waits = delay is not None
    sensors = SensorState(windows_s, fft_sensors, delay_s)
    first = ReadingOrder(waits, ttl_ms) if spread else ReadingProcessor(waits, ttl_ms, sensors)
    ordered = keyed.groupBy("bucket").transformWithState(first, ORDERED, "append", mode if waits else _time_mode(ttl_ms))
    texts = F.split("body", " ", 5)
    found = F.from_json(texts[4], f"{_CONTENT}, x map<string,struct<{_SENSOR}>>")
    seen = ordered.select(
        "machine_id",
        _number(texts[0]).alias("at"),
        texts[1].cast("long").alias("seq"),
        texts[2].cast("long").alias("segment"),
        *[(F.substring(texts[3], i + 1, 1) == "1").alias(c) for i, c in enumerate(("late", "rejected", "duplicate"))],
        found["readings"].alias("readings"),
        F.coalesce(found["filled"], found["readings"]).alias("filled"),
        found["original"].alias("original"),
        found["x"].alias("sensors"),
    ).withColumn("recorded_at", F.timestamp_micros("at"))
    states = dict(quality.stateless_flags(limits, clock))
    states["DUPLICATE_TIMESTAMP"] = F.col("duplicate")
    states["OUTLIER_DETECTED"] = ~F.col("rejected") & quality.outlier_flag(F.col("filled"), limits)
    bits, names = quality.flag_columns({k: F.coalesce(v, F.lit(False)) for k, v in states.items()})
    flagged = quality.null_counts(seen).withColumn("flag_bits", bits).withColumn("quality_flags", names)
    if not spread:
        return flagged.select("machine_id", "at", "seq", *_PAYLOAD, "sensors")
    entry = "struct<sensor:string,body:string>"
    reading = F.array(F.struct(F.lit(None).cast("string"), _json(F.struct("at", "seq", *_PAYLOAD))).cast(entry))
    head = F.concat_ws(" ", "at", "seq", "segment")
    values = F.transform(
        F.map_entries("filled"), lambda e: F.struct(e["key"], F.concat_ws(" ", head, e["value"].cast("string"))).cast(entry)
    )
    used = ~F.col("late") & ~F.col("rejected")
    parts = flagged.select("machine_id", F.inline(F.when(used, F.concat(reading, values)).otherwise(reading)))
    spread = parts.select(_bucket("machine_id", "sensor"), "*")
    return spread.groupBy("bucket").transformWithState(
        WindowProcessor(sensors, ttl_ms), PARTS, "append", _time_mode(ttl_ms)
    )


_PAYLOAD = ["late", "rejected", "duplicate", "readings", "filled", "original", "flag_bits", "quality_flags"]
_CONTENT = "readings map<string,double>, filled map<string,double>, original string"
_WHOLE = f"at long, seq long, late boolean, rejected boolean, duplicate boolean, {_CONTENT}, flag_bits int, quality_flags array<string>"
_SENSOR = "mean: double, top: double, w: array<array<double>>, s: array<array<double>>"
_WINDOW = "array<struct<window_s:int,entries:array<struct<key:string,value:double>>,sample:struct<key:string,value:array<double>>>>"


def _bucket(*keys: str) -> Column:
    """The group whose state holds the keys' entries; the number of groups stays as long as the state does."""
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _json(content: Column) -> Column:
    return F.to_json(content, {"ignoreNullFields": "false"})


def _digit(flag: Column) -> Column:
    return F.when(flag, F.lit("1")).otherwise(F.lit("0"))


def _text(time: str, *rest: Column) -> Column:
    """What an ordering step reads: the row's time and number, and the rest."""
    at = F.coalesce(F.unix_micros(time).cast("string"), F.lit(NO_TIME))
    return F.concat_ws(" ", at, F.coalesce(F.col("seq").cast("string"), F.lit("0")), *rest)


def _number(text: Column, kind: str = "long") -> Column:
    return F.when(text != NO_TIME, text).cast(kind)


def _sensor_windows(sensor: Column, one: Column) -> Column:
    """A sensor's windows, each with its named features and its samples."""

    def entry(*name: Column, value: Column) -> Column:
        return F.struct(F.concat_ws("_", sensor, *name).alias("key"), value.alias("value"))

    running = F.array(entry(F.lit("cumulative_mean"), value=one["mean"]), entry(F.lit("cumulative_max"), value=one["top"]))

    def of_window(w: Column, i: Column) -> Column:
        length = F.concat(w[0].cast("int").cast("string"), F.lit("s"))
        rolling = F.array(*[entry(length, F.lit(s), value=F.get(w, F.lit(2 + k))) for k, s in enumerate(STATS)])
        samples = F.get(one["s"], i)
        return F.struct(
            w[0].cast("int").alias("window_s"),
            F.when(w[1] >= 2, F.concat(rolling, running)).otherwise(running).alias("entries"),
            F.when(samples.isNotNull(), F.struct(sensor.alias("key"), samples.alias("value"))).alias("sample"),
        )

    return F.transform(one["w"], of_window)


def assembled(parts: DataFrame) -> DataFrame:
    """One row per reading: its flags and values, and ``windows`` with feature and sample maps.

    Rows of a stream that was ``spread`` take one shuffle, by reading.
    """
    if "sensors" in parts.columns:
        of_sensors = F.transform(F.map_entries("sensors"), lambda e: _sensor_windows(e["key"], e["value"]))
        rows = parts.withColumn("_w", F.coalesce(F.flatten(of_sensors), F.array().cast(_WINDOW)))
    else:
        whole, one = F.from_json("body", _WHOLE), F.from_json("body", f"struct<at: long, seq: long, {_SENSOR}>")
        of_sensor = F.col("sensor").isNotNull()
        read = parts.select(
            "machine_id", "sensor", F.when(~of_sensor, whole).alias("_whole"), F.when(of_sensor, one).alias("_one")
        )
        rows = (
            read.withColumn("_w", F.when(of_sensor, _sensor_windows(F.col("sensor"), F.col("_one"))).otherwise(F.array().cast(_WINDOW)))
            .groupBy("machine_id", F.coalesce("_whole.at", "_one.at").alias("at"), F.coalesce("_whole.seq", "_one.seq").alias("seq"))
            .agg(F.first("_whole", ignorenulls=True).alias("_whole"), F.flatten(F.collect_list("_w")).alias("_w"))
            .select("machine_id", "at", "seq", "_w", *[F.col(f"_whole.{c}").alias(c) for c in _PAYLOAD])
        )
    lengths = F.array_sort(F.array_distinct(F.transform("_w", lambda x: x["window_s"])))

    def window(length: Column) -> Column:
        own = F.filter("_w", lambda x: x["window_s"] == length)
        return F.struct(
            length.alias("window_s"),
            F.map_from_entries(F.flatten(F.transform(own, lambda x: x["entries"]))).alias("temporal"),
            F.map_from_entries(F.array_compact(F.transform(own, lambda x: x["sample"]))).alias("samples"),
        )

    return rows.select(
        "machine_id", F.timestamp_micros("at").alias("recorded_at"), "seq", *_PAYLOAD, F.transform(lengths, window).alias("windows")
    )


def late_rows(rows: DataFrame) -> DataFrame:
    """Of ``assembled`` rows, the readings that came after the watermark had passed their time."""
    return rows.where("late").select("machine_id", "recorded_at", "seq", "readings", "original", "rejected")


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """How many late rows each micro-batch brought; ``path`` is a table of batches."""
    return read_batches(spark, path).groupBy(BATCH).agg(F.count("*").alias("late_rows"))


def computed_features(
    processed: DataFrame,
    *,
    fft_sensors: list[str] = FFT_SENSORS,
    rate_hz: float = FFT_RATE_HZ,
    fft_min: int = FFT_MIN_SAMPLES,
    pearson_min: int = PEARSON_MIN_SAMPLES,
) -> DataFrame:
    """One feature row per accepted reading in time and window, in three maps; of ``assembled`` rows."""
    rows = processed.where(~F.col("rejected") & ~F.col("late")).select(
        "machine_id", F.col("recorded_at").alias("computed_at"), F.explode("windows").alias("w")
    )
    samples = F.col("w.samples")
    spectral = []
    for sensor in fft_sensors:
        values = F.try_element_at(samples, F.lit(sensor))
        enough = F.when(F.size(values) >= fft_min, values)
        rows = rows.withColumn(f"_s_{sensor}", spectral_features(enough, F.lit(float(rate_hz))))
        spectral += [
            F.when(
                enough.isNotNull(),
                F.struct(F.lit(f"{sensor}_{f}").alias("k"), F.col(f"_s_{sensor}")[f].alias("v")),
            )
            for f in FEATURES
        ]
    correlation = []
    for a, b in sensor_pairs(fft_sensors):
        name = f"{a}_x_{b}_pearson"
        value = array_pearson(
            F.try_element_at(samples, F.lit(a)), F.try_element_at(samples, F.lit(b)), pearson_min
        )
        rows = rows.withColumn(f"_c_{name}", value)
        value = F.col(f"_c_{name}")
        correlation.append(
            F.when(value.isNotNull(), F.struct(F.lit(name).alias("k"), value.alias("v")))
        )

    def as_map(entries):
        if not entries:
            return F.create_map().cast("map<string,double>")
        return F.map_from_entries(F.array_compact(F.array(*entries)))

    return rows.select(
        "machine_id",
        "computed_at",
        F.col("w.window_s").alias("window_s"),
        F.col("w.temporal").alias("temporal"),
        as_map(spectral).alias("spectral"),
        as_map(correlation).alias("correlation"),
        F.lit("v1").alias("feature_version"),
    )


def feature_job(
    raw: DataFrame, out: str, checkpoint: str, *, group_id: str = "features", **options
) -> StreamingQuery:
    """Raw JSON messages to tables: readings, features, late readings, dead letters of both kinds."""
    use_rocksdb(raw.sparkSession)
    run = {k: options.pop(k) for k in ("available_now", "trigger") if k in options}
    decoded = messages.decode(raw, "reading").withColumn("seq", F.col("offset"))
    # Parse errors skip the state: they leave through their own query, off the same source.
    good, broken = messages.split_decoded(decoded)
    processed = feature_rows(good, **options)
    fft = {k: v for k, v in options.items() if k == "fft_sensors"}

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = assembled(batch).persist()
        in_time = rows.where(~F.col("late"))
        readings = in_time.where(~F.col("rejected")).select(
            "machine_id", "recorded_at", F.col("filled").alias("readings"), "quality_flags"
        )
        write_batch(readings, f"{out}/readings", batch_id)
        write_batch(computed_features(rows, **fft), f"{out}/features", batch_id)
        rejects = in_time.where("rejected").withColumn("value", F.col("original"))
        letters = messages.stage_envelope(rejects, "quality_rejected", F.col("quality_flags"))
        write_batch(letters, f"{out}/rejects", batch_id)
        write_batch(late_rows(rows), f"{out}/late", batch_id)
        rows.unpersist()

    def broken_sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(messages.decode_envelope(batch, group_id), f"{out}/undecoded", batch_id)

    start(broken, broken_sink, f"{checkpoint}/undecoded", **run).awaitTermination() if run.get(
        "available_now"
    ) else start(broken, broken_sink, f"{checkpoint}/undecoded", **run)
    return start(processed, sink, f"{checkpoint}/features", **run)


# --- roll-ups --------------------------------------------------------------------


def rollup_job(
    readings: DataFrame,
    bucket: str,
    values: dict,
    out: str,
    checkpoint: str,
    *,
    delay: str = "1 hour",
    extremes: list[str] = [],
    **run,
) -> StreamingQuery:
    """Keeps a roll-up current: each batch appends the buckets it changed.

    Read it with ``rollup_view``, which takes the last write per bucket. State
    of buckets older than the watermark is dropped.
    """
    timed = readings.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    rolled = rollups.bucket_rollup(
        timed.withWatermark("recorded_at", delay), bucket, values, extremes=extremes
    )
    return start(rolled, lambda b, i: write_batch(b, out, i), checkpoint, mode="update", **run)


def rollup_view(spark: SparkSession, out: str) -> DataFrame:
    return tables.latest_by_key(read_batches(spark, out), ["bucket", "machine_id"], [BATCH]).drop(BATCH)


# --- alerts ------------------------------------------------------------------------


def _time_mode(ttl_ms: int | None) -> str:
    """State that expires needs processing time."""
    return "none" if ttl_ms is None else "processingTime"


def alert_rows(
    predictions: DataFrame,
    rule_table: DataFrame,
    *,
    window_s: int = 300,
    delay: str | None = None,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Predictions (with ``seq``) to fired rules after cooldown, ready for ``build_incidents``; late predictions marked.

    Two keyed steps: by machine, predictions are put in order and get the one
    before (``delay`` as in ``feature_rows``); by machine and rule, hits pass the
    cooldown. Between them rules are looked up as in a batch (``rules.rule_hits``),
    so any number of rules costs no literals. Late predictions come out once,
    without a rule.
    """
    timed, mode = _ordered(predictions, "predicted_at", delay)
    rul = F.coalesce(F.col("rul_cycles").cast("string"), F.lit(NO_TIME))
    content = _json(F.struct("rul_cycles", "health_label", "anomaly_score"))
    keyed = timed.select(_bucket("machine_id"), "machine_id", _text("predicted_at", rul, content).alias("body"))
    waits = delay is not None
    ordered = keyed.groupBy("bucket").transformWithState(
        PredictionOrder(waits, ttl_ms), ORDERED, "append", mode if waits else _time_mode(ttl_ms)
    )
    texts = F.split("body", " ", 5)
    seen = ordered.select(
        "machine_id",
        _number(texts[0]).alias("at"),
        texts[1].cast("long").alias("seq"),
        (texts[2] == "1").alias("late"),
        _number(texts[3], "double").alias("previous_rul"),
        F.from_json(texts[4], "rul_cycles double, health_label string, anomaly_score double").alias("_was"),
    ).select("*", "_was.*")
    context = seen.withColumn("active_sensor_count", rules.anomalous_sensors(F.col("anomaly_score")))
    # A late row fires no rule but one made to carry it: a label that no prediction has.
    late, values = F.col("late"), ["rul_cycles", "health_label", "anomaly_score", "active_sensor_count"]
    shown = {c: F.when(~late, F.col(c)) for c in values}
    shown["health_label"] = F.when(late, F.lit(LATE_LABEL)).otherwise(F.col("health_label"))
    marked = context.withColumn("_was", F.struct(*values)).withColumns(shown)
    carrier = [(None, None, None, None, "health_label_is", {"label": LATE_LABEL}, 0, True)]
    table = rule_table.select(*RULE.names).unionByName(predictions.sparkSession.createDataFrame(carrier, RULE))
    details = F.struct("at", "seq", "late", "previous_rul", "_was.*", "rule_name", "severity", "condition_type", "thresholds")
    hits = rules.rule_hits(marked, table).select(
        _bucket("machine_id", "rule_id"), "machine_id", "rule_id", F.concat_ws(" ", F.coalesce("at", F.lit(0)), "seq", "cooldown_s", _json(details)).alias("body")
    )
    fired = hits.groupBy("bucket").transformWithState(
        CooldownProcessor(window_s, ttl_ms), FIRED, "append", _time_mode(ttl_ms)
    )
    return fired.withColumn("_d", F.from_json("body", _DETAILS)).select(
        "machine_id",
        F.timestamp_micros("_d.at").alias("predicted_at"),
        "rule_id",
        F.timestamp_micros("window_start").alias("window_start"),
        "notify",
        "_d.*",
    ).drop("at")


_DETAILS = (
    "at long, seq long, late boolean, previous_rul double, rul_cycles double, health_label string, anomaly_score double, "
    "active_sensor_count int, rule_name string, severity string, condition_type string, thresholds map<string,string>"
)


def alert_job(
    predictions: DataFrame,
    rule_table: DataFrame,
    out: str,
    checkpoint: str,
    window_s: int = 300,
    delay: str | None = None,
    ttl_ms: int | None = None,
    **run,
) -> StreamingQuery:
    """Writes fired rules, incident rows and late predictions; ``notify`` marks the opener of each window."""
    use_rocksdb(predictions.sparkSession)
    rows = alert_rows(predictions, rule_table, window_s=window_s, delay=delay, ttl_ms=ttl_ms)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        fired = batch.where(~F.col("late"))
        write_batch(fired, f"{out}/fired", batch_id)
        write_batch(build_incidents(fired), f"{out}/incidents", batch_id)
        if delay is not None:
            kept = ["machine_id", "predicted_at", "seq", "rul_cycles", "health_label", "anomaly_score"]
            write_batch(batch.where("late").select(*kept), f"{out}/late", batch_id)
        batch.unpersist()

    return start(rows, sink, checkpoint, **run)


# --- scoring -------------------------------------------------------------------------


def scoring_job(features: DataFrame, log, names: list[str], out: str, checkpoint: str, **run) -> StreamingQuery:
    """Scores feature rows with the models in production at the time of each micro-batch."""
    from wearline.plans.retraining import HEALTH, RUL
    from wearline.plans.training import score_features

    def sink(batch: DataFrame, batch_id: int) -> None:
        rul_version, rul = log.load_production(RUL)
        health_version, health = log.load_production(HEALTH)
        versions = (str(rul_version), str(health_version))
        write_batch(score_features(batch, rul, health, names, versions), out, batch_id)

    return start(features, sink, checkpoint, **run)
