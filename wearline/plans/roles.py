"""The given tables in the roles of telemetry tables.

No given table holds sensor readings, so columns take over the roles: events
are long readings and predictions, line items are multi-sensor readings,
embeddings are signals, orders are incidents, customers are machines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline import session

DAY_S = 86_400
# Event gaps of one user are hours, so windows are hours to a week.
WINDOWS_S = [6 * 3600, DAY_S, 3 * DAY_S, 7 * DAY_S]

LABEL_OF_EVENT = {
    "click": "healthy",
    "view": "healthy",
    "signup": "degrading",
    "purchase": "critical",
    "error": "imminent_failure",
}
SEVERITY_OF_PRIORITY = {
    "1-URGENT": "critical",
    "2-HIGH": "critical",
    "3-MEDIUM": "warning",
    "4-NOT SPECIFIED": "info",
    "5-LOW": "info",
}
STATUS_OF_ORDER = {"O": "open", "P": "acknowledged", "F": "closed"}
SENSORS = ["quantity", "extendedprice", "discount", "tax"]
LINE_ORDER = ["recorded_at", "l_orderkey", "l_linenumber", "l_partkey"]
EVENT_ORDER = ["recorded_at", "event_id"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    session.prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mapped(column: Column, names: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in names.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def events_long(spark: SparkSession, folder: str) -> DataFrame:
    """Long readings: one sensor value per event."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("machine_id"),
        F.col("event_type").alias("sensor"),
        F.col("ts").alias("recorded_at"),
        "value",
        "event_id",
    )


def events_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("machine_id"),
        F.col("ts").alias("predicted_at"),
        "event_id",
        F.col("value").alias("rul_cycles"),
        (F.col("value") * 0.5).alias("rul_hours"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("anomaly_score"),
        mapped(F.col("event_type"), LABEL_OF_EVENT).alias("health_label"),
        F.get_json_object("props", "$.k").cast("int").alias("latency_ms"),
    )


def lines_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Four sensor columns per row."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("machine_id"),
        F.col("l_shipdate").alias("recorded_at"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("extendedprice"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def lines_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as maps with gaps: zero discount or tax is missing, line 7 lacks a sensor.

    Supplier 0 plays a machine without an id.
    """
    wide = lines_wide(spark, folder)
    nan = F.lit(float("nan"))
    gap = {c: F.when(F.col(c) == 0.0, nan).otherwise(F.col(c)) for c in ("discount", "tax")}
    entries = F.array(
        F.when(
            F.col("l_linenumber") != 7,
            F.struct(F.lit("quantity").alias("k"), F.col("quantity").alias("v")),
        ),
        F.struct(F.lit("extendedprice").alias("k"), F.col("extendedprice").alias("v")),
        F.struct(F.lit("discount").alias("k"), gap["discount"].alias("v")),
        F.struct(F.lit("tax").alias("k"), gap["tax"].alias("v")),
    )
    machine = F.when(F.col("machine_id") == "0", F.lit(" ")).otherwise(F.col("machine_id"))
    return wide.select(
        machine.alias("machine_id"),
        *LINE_ORDER,
        F.map_from_entries(F.array_compact(entries)).alias("readings"),
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id"), F.lit("embedding").alias("sensor"), F.col("embedding").alias("samples")
    )


def orders_incidents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        F.col("o_custkey").cast("string").alias("machine_id"),
        mapped(F.col("o_orderpriority"), SEVERITY_OF_PRIORITY).alias("severity"),
        mapped(F.col("o_orderstatus"), STATUS_OF_ORDER).alias("status"),
        F.col("o_orderdate").alias("triggered_at"),
        F.col("o_orderpriority").alias("title"),
    )


def customer_machines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("machine_id"),
        F.col("c_mktsegment").alias("machine_type"),
    )


def incident_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders open incidents, their line items acknowledge or close them."""
    opened = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("incident_id"),
        F.lit("open").alias("action"),
        F.col("o_orderdate").alias("event_at"),
        F.lit(0).cast("long").alias("event_no"),
        F.lit(None).cast("string").alias("actor"),
        F.lit(None).cast("string").alias("note"),
    )
    acted = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("incident_id"),
        mapped(F.col("l_returnflag"), {"A": "acknowledge", "R": "close"}).alias("action"),
        F.col("l_shipdate").alias("event_at"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("event_no"),
        F.col("l_suppkey").cast("string").alias("actor"),
        F.concat_ws("-", "l_returnflag", F.col("l_partkey").cast("string")).alias("note"),
    )
    return opened.unionByName(acted.where(F.col("action").isNotNull()))
