"""Named queries, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``; without ``sql`` it is checked by row count only."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


E_LONG = (
    "e AS (SELECT CAST(user_id AS VARCHAR) AS machine_id, event_type AS sensor, "
    "ts AS recorded_at, value, event_id FROM events)"
)
E_PRED = """p AS (
  SELECT CAST(user_id AS VARCHAR) AS machine_id, ts AS predicted_at, event_id,
    value AS rul_cycles, value * 0.5::DOUBLE AS rul_hours,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS anomaly_score,
    CASE event_type WHEN 'click' THEN 'healthy' WHEN 'view' THEN 'healthy'
      WHEN 'signup' THEN 'degrading' WHEN 'purchase' THEN 'critical'
      WHEN 'error' THEN 'imminent_failure' END AS health_label,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS latency_ms
  FROM events)"""
L_WIDE = """l AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS machine_id, l_shipdate AS recorded_at,
    l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity,
    l_extendedprice AS extendedprice, l_discount AS discount, l_tax AS tax
  FROM lineitem)"""
O_INC = """i AS (
  SELECT o_orderkey AS incident_id, CAST(o_custkey AS VARCHAR) AS machine_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'critical'
      WHEN '3-MEDIUM' THEN 'warning' ELSE 'info' END AS severity,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'acknowledged'
      WHEN 'F' THEN 'closed' END AS status,
    o_orderdate AS triggered_at, o_orderpriority AS title
  FROM orders)"""
CYCLES = (
    E_LONG + ", c AS (SELECT *, row_number() OVER "
    "(PARTITION BY machine_id ORDER BY recorded_at, event_id) AS cycle FROM e), "
    "u AS (SELECT *, least(max(cycle) OVER (PARTITION BY machine_id) - cycle, 125) AS rul_cycles FROM c)"
)
