"""JSON messages: typed decode, parse errors, dead-letter envelopes, Kafka adapters.

A raw frame has ``value`` (JSON text or bytes) and may carry Kafka's ``topic``,
``partition``, ``offset`` and ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearline.functions.times import iso_utc
from wearline.schemas import FEATURES, HEALTH_LABELS, PREDICTION, READING

REQUIRED = {
    "reading": ["machine_id", "recorded_at", "readings"],
    "features": ["machine_id", "computed_at", "window_s"],
    "prediction": [
        "machine_id",
        "predicted_at",
        "rul_cycles",
        "rul_hours",
        "rul_lower_bound",
        "rul_upper_bound",
        "health_label",
        "anomaly_score",
        "confidence",
        "rul_model_version",
        "health_model_version",
    ],
}
SCHEMAS = {"reading": READING, "features": FEATURES, "prediction": PREDICTION}
_CORRUPT = "_corrupt"


def _defaults(kind: str) -> dict[str, Column]:
    empty = F.create_map().cast("map<string,double>")
    if kind == "reading":
        return {"operational": empty}
    if kind == "features":
        return {
            **{g: empty for g in ("temporal", "spectral", "correlation")},
            "feature_version": F.lit("v1"),
        }
    return {"health_probabilities": empty, "latency_ms": F.lit(0)}


def decode(raw: DataFrame, kind: str) -> DataFrame:
    """Adds the typed columns of ``kind`` and ``parse_error``.

    JSON ``null`` inside a number map is a parse error, JSON ``NaN`` is a value.
    Works on batch and streaming frames.
    """
    schema = T.StructType(SCHEMAS[kind].fields + [T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "timeZone": "UTC"}
    parsed = raw.withColumn("_p", F.from_json(F.col("value").cast("string"), schema, options))
    p = F.col("_p")
    broken = p.isNull() | p[_CORRUPT].isNotNull()
    for name in REQUIRED[kind]:
        broken = broken | p[name].isNull()
    # A surrounding check: an id must have at least one character.
    broken = broken | (F.length(p["machine_id"]) < 1)
    for field in SCHEMAS[kind].fields:
        if isinstance(field.dataType, T.MapType):
            holes = F.exists(F.map_values(p[field.name]), lambda v: v.isNull())
            broken = broken | F.coalesce(holes, F.lit(False))
    if kind == "prediction":
        broken = broken | ~p["health_label"].isin(HEALTH_LABELS)
    defaults = _defaults(kind)
    typed = [
        (F.coalesce(p[f.name], defaults[f.name]) if f.name in defaults else p[f.name]).alias(f.name)
        for f in SCHEMAS[kind].fields
    ]
    return parsed.withColumn("parse_error", F.coalesce(broken, F.lit(True))).select(
        *raw.columns, "parse_error", *typed
    )


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    return decoded.where(~F.col("parse_error")).drop("parse_error"), decoded.where("parse_error")


def stage_envelope(
    rows: DataFrame, reason: str, flags: Column | None = None, at: Column | None = None
) -> DataFrame:
    """Dead-letter value of the feature stage: reason, flags, original text and time."""
    names = F.array().cast("array<string>") if flags is None else flags
    moment = F.current_timestamp() if at is None else at
    body = F.struct(
        F.lit(reason).alias("reason"),
        names.alias("flags"),
        F.col("value").cast("string").alias("original"),
        iso_utc(moment).alias("dlq_at"),
    )
    return rows.select(F.to_json(body).alias("value"))


def decode_envelope(rows: DataFrame, group_id: str) -> DataFrame:
    """Dead-letter value of the decode stage: provenance and the raw payload."""
    body = F.struct(
        F.col("topic").alias("source_topic"),
        F.col("partition"),
        F.col("offset"),
        F.lit(group_id).alias("group_id"),
        F.col("value").cast("string").alias("raw_payload"),
    )
    return rows.select(F.to_json(body).alias("value"))


def encode(df: DataFrame, key: str = "machine_id", times: list[str] = []) -> DataFrame:
    """Key and JSON value of each row; listed times become ISO-8601 UTC text."""
    columns = [iso_utc(F.col(c)).alias(c) if c in times else F.col(c) for c in df.columns]
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def kafka_source(spark: SparkSession, servers: str, topics: list[str], **options: str) -> DataFrame:
    """Streaming raw frame of the topics; needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "latest")
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def kafka_sink(encoded: DataFrame, servers: str, topic: str, checkpoint: str, trigger: str = "5 seconds"):
    """Starts a keyed sink; equal keys go to one topic partition and keep their order."""
    return (
        encoded.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=trigger)
        .start()
    )
