"""Queries over views, incidents and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.functions import scoring
from wearline.operators import incidents, labels, rules, views
from wearline.operators.slices import AUTO, slice_length
from wearline.plans import roles
from wearline.plans.catalog import E_PRED, O_INC, longs, ntz, query, r, rounded
from wearline.plans.roles import DAY_S

PRED_ORDER = ["predicted_at", "event_id"]
_LATEST = E_PRED + (
    ", lp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY machine_id "
    "ORDER BY predicted_at DESC, event_id DESC) AS rn FROM p) WHERE rn = 1)"
)
_FLEET = f"""WITH {_LATEST}, f AS (SELECT CAST(c_custkey AS VARCHAR) AS machine_id,
  coalesce(c_mktsegment, 'unknown') AS machine_type, coalesce(health_label, 'healthy') AS health_label,
  coalesce(rul_cycles, 0.0) AS rul_cycles, coalesce(rul_hours, 0.0) AS rul_hours,
  coalesce(anomaly_score, 0.0) AS anomaly_score, predicted_at
FROM customer LEFT JOIN lp ON lp.machine_id = CAST(c_custkey AS VARCHAR))"""


@query(
    "latest_per_machine",
    f"WITH {_LATEST} SELECT machine_id, predicted_at, event_id, rul_cycles, health_label FROM lp",
)
def latest_per_machine(spark, folder):
    out = views.latest_per_machine(roles.events_predictions(spark, folder), PRED_ORDER)
    return out.select("machine_id", "predicted_at", "event_id", "rul_cycles", "health_label")


def _overview(spark, folder):
    return views.fleet_overview(
        roles.customer_machines(spark, folder), roles.events_predictions(spark, folder), PRED_ORDER
    )


@query("fleet_overview", _FLEET + " SELECT * FROM f")
def fleet_overview(spark, folder):
    return _overview(spark, folder)


@query(
    "fleet_summary",
    _FLEET
    + """ SELECT count(*) AS total, count(*) FILTER (health_label IN ('critical', 'imminent_failure')) AS critical,
      count(*) FILTER (health_label = 'degrading') AS degrading,
      count(*) FILTER (health_label = 'healthy') AS healthy FROM f""",
)
def fleet_summary(spark, folder):
    return views.fleet_summary(_overview(spark, folder))


@query(
    "health_distribution",
    f"WITH {_LATEST} SELECT health_label, count(*) AS machines FROM lp GROUP BY 1",
)
def health_distribution(spark, folder):
    return views.health_distribution(roles.events_predictions(spark, folder), PRED_ORDER)


@query(
    "rul_trend",
    f"""WITH {E_PRED} SELECT machine_id, predicted_at, rul_cycles FROM p
    WHERE predicted_at BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-25'""",
)
def rul_trend(spark, folder):
    as_of = F.lit("2024-01-25").cast("timestamp_ntz")
    return views.rul_trend(roles.events_predictions(spark, folder), as_of, 7 * 24)


@query(
    "recent_predictions",
    f"""WITH {E_PRED} SELECT machine_id, predicted_at, event_id, rul_cycles FROM p
    ORDER BY predicted_at DESC, event_id DESC LIMIT 100""",
)
def recent_predictions(spark, folder):
    """The fleet's last 100 predictions, the sample behind the panels."""
    base = roles.events_predictions(spark, folder)
    return views.newest(base, 100, PRED_ORDER).select("machine_id", "predicted_at", "event_id", "rul_cycles")


@query(
    "rul_histogram",
    f"""WITH {E_PRED}, b AS (SELECT min(rul_cycles) AS lo, (max(rul_cycles) - min(rul_cycles)) / 20 AS w FROM p),
    h AS (SELECT CAST(least(floor((rul_cycles - lo) / w), 19) AS BIGINT) AS bin, count(*) AS n FROM p, b GROUP BY 1)
    SELECT g.bin, round(lo + g.bin * w, 6) + 0.0 AS bin_start, coalesce(n, 0) AS n
    FROM (SELECT unnest(generate_series(0, 19)) AS bin) g CROSS JOIN b LEFT JOIN h ON h.bin = g.bin""",
)
def rul_histogram(spark, folder):
    out = views.equal_width_histogram(roles.events_predictions(spark, folder), "rul_cycles")
    return longs(rounded(out, ["bin_start"]), "bin")


@query(
    "latency_percentiles",
    f"""WITH {E_PRED} SELECT round(quantile_cont(latency_ms, 0.5), 6) + 0.0 AS p50,
      round(quantile_cont(latency_ms, 0.95), 6) + 0.0 AS p95,
      round(quantile_cont(latency_ms, 0.99), 6) + 0.0 AS p99 FROM p""",
)
def latency_percentiles(spark, folder):
    out = views.latency_percentiles(roles.events_predictions(spark, folder))
    return rounded(out, ["p50", "p95", "p99"])


@query(
    "latency_histogram",
    f"""WITH {E_PRED} SELECT CAST(b AS DOUBLE) AS upper_ms, count(*) FILTER (latency_ms <= b) AS n
    FROM p, (SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000]) AS b) GROUP BY b
    UNION ALL SELECT 1e9::DOUBLE, count(latency_ms) FROM p""",
)
def latency_histogram(spark, folder):
    out = views.latency_histogram(roles.events_predictions(spark, folder))
    finite = F.when(F.col("upper_ms") == float("inf"), 1e9).otherwise(F.col("upper_ms"))
    return out.withColumn("upper_ms", finite)


@query(
    "label_counts",
    f"WITH {E_PRED} SELECT coalesce(health_label, 'unknown') AS health_label, count(*) AS n FROM p GROUP BY 1",
)
def label_counts(spark, folder):
    return views.label_counts(roles.events_predictions(spark, folder))


@query(
    "incident_page",
    f"""WITH {O_INC}, k AS (SELECT * FROM i WHERE status = 'open' AND severity = 'critical')
    SELECT incident_id, machine_id, severity, status, triggered_at,
      (SELECT count(*) FROM k) AS total, 20 + 20 < (SELECT count(*) FROM k) AS has_more
    FROM k ORDER BY triggered_at DESC, incident_id DESC LIMIT 20 OFFSET 20""",
)
def incident_page(spark, folder):
    out = views.incident_page(
        roles.orders_incidents(spark, folder), 20, 20, status="open", severity="critical"
    )
    return out.drop("title")


@query(
    "active_incidents",
    f"WITH {O_INC} SELECT count(*) FILTER (status IN ('open', 'acknowledged')) AS active_incidents FROM i",
)
def active_incidents(spark, folder):
    return views.active_incident_count(roles.orders_incidents(spark, folder))


@query(
    "incident_severity_counts",
    f"""WITH {O_INC}, s AS (SELECT unnest(['info', 'warning', 'critical']) AS severity,
      unnest([1, 2, 3]) AS position)
    SELECT severity, CAST(position AS BIGINT) AS position, count(i.incident_id) AS n
    FROM s LEFT JOIN (SELECT * FROM i WHERE status = 'acknowledged') i USING (severity) GROUP BY ALL""",
)
def incident_severity_counts(spark, folder):
    acknowledged = views.incident_filter(roles.orders_incidents(spark, folder), status="acknowledged")
    return longs(views.severity_counts(acknowledged), "position")


@query(
    "last_incident",
    f"""WITH {O_INC} SELECT machine_id, incident_id, triggered_at, severity FROM (SELECT *, row_number() OVER
      (PARTITION BY machine_id ORDER BY triggered_at DESC, incident_id DESC) AS rn FROM i) WHERE rn = 1""",
)
def last_incident(spark, folder):
    out = views.last_incident(roles.orders_incidents(spark, folder))
    return out.select("machine_id", "incident_id", "triggered_at", "severity")


@query(
    "severity_group_summary",
    f"""WITH {O_INC}, k AS (SELECT *, CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS sr FROM i)
    SELECT machine_id, CASE max(sr) WHEN 1 THEN 'info' WHEN 2 THEN 'warning' ELSE 'critical' END AS severity,
      arg_min(title, (-sr, triggered_at, incident_id)) AS title, min(triggered_at) AS triggered_at,
      count(*) AS incident_count FROM k GROUP BY machine_id""",
)
def severity_group_summary(spark, folder):
    base = roles.orders_incidents(spark, folder).withColumnRenamed("incident_id", "rule_id")
    return incidents.group_summary(base, ["machine_id"])


@query(
    "orphan_audit",
    """SELECT l.l_orderkey AS o_orderkey, l.l_partkey, 'lines without order' AS relation FROM lineitem l
      ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = l.l_orderkey
    UNION ALL SELECT o_orderkey, NULL, 'orders without machine' FROM orders
      ANTI JOIN customer ON c_custkey = o_custkey""",
)
def orphan_audit(spark, folder):
    """Lines whose order is not settled, and orders whose customer is unknown."""
    orders = roles.table(spark, folder, "orders")
    settled = orders.where(F.col("o_orderstatus") != "P")
    lines = roles.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey"
    )
    first = views.orphan_audit(lines, settled, "o_orderkey", "lines without order")
    customers = roles.table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"))
    second = views.orphan_audit(orders, customers, "o_custkey", "orders without machine")
    second = second.select("o_orderkey", F.lit(None).cast("long").alias("l_partkey"), "relation")
    return first.unionByName(second)


@query(
    "priority_sensors",
    """SELECT DISTINCT event_type AS sensor, CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2
      ELSE 3 END AS BIGINT) AS rank FROM events ORDER BY rank, sensor LIMIT 4""",
)
def priority_sensors(spark, folder):
    out = views.priority_sensors(roles.events_long(spark, folder), ["error", "view"], 4)
    return longs(out, "rank")


@query(
    "machine_lookup",
    "SELECT CAST(c_custkey AS VARCHAR) AS machine_id, c_mktsegment AS machine_type FROM customer WHERE c_custkey = 7",
)
def machine_lookup(spark, folder):
    return views.machine_lookup(roles.customer_machines(spark, folder), "7")


# --- rules ---------------------------------------------------------------

_CONTEXT = E_PRED + """, x AS (SELECT *, lag(rul_cycles) OVER (PARTITION BY machine_id
    ORDER BY predicted_at, event_id) AS previous_rul,
  CASE WHEN anomaly_score >= 0.9 THEN 4 WHEN anomaly_score >= 0.7 THEN 3
    WHEN anomaly_score >= 0.5 THEN 2 ELSE 0 END AS sensors FROM p)"""
_RULE_TESTS = [
    ("rul_critical", "RUL Critical", "critical", "rul_cycles < 10", 3600),
    ("rul_warning", "RUL Warning", "warning", "rul_cycles < 30", 7200),
    ("rul_info", "RUL Informational", "info", "rul_cycles < 50", 14400),
    ("anomaly_critical", "Anomaly Critical", "critical", "anomaly_score > 0.9::DOUBLE", 1800),
    ("anomaly_warning", "Anomaly Warning", "warning", "anomaly_score > 0.7::DOUBLE", 3600),
    ("health_imminent", "Imminent Failure", "critical", "health_label = 'imminent_failure'", 1800),
    ("health_critical", "Critical Health", "warning", "health_label = 'critical'", 3600),
    ("rapid_degradation", "Rapid RUL Degradation", "critical", "previous_rul - rul_cycles > 5", 3600),
    ("multi_sensor_anomaly", "Multi-Sensor Anomaly", "critical", "sensors >= 3", 1800),
]
_STRETCH = 12  # events are hours apart, so cooldowns are stretched to reach them
_HITS = _CONTEXT + ", hits AS (" + " UNION ALL ".join(
    f"SELECT machine_id, predicted_at, event_id, '{rid}' AS rule_id, '{name}' AS rule_name, "
    f"'{sev}' AS severity, {cool * _STRETCH} AS cooldown_s FROM x WHERE {test}"
    for rid, name, sev, test, cool in _RULE_TESTS
) + ")"


def stretched_rules(spark):
    return rules.default_rules(spark).withColumn(
        "cooldown_s", (F.col("cooldown_s") * _STRETCH).cast("int")
    )


def prediction_slice(spark, folder):
    """Slices planned on the predictions also bound the hits of each (machine, rule)."""
    base = roles.events_predictions(spark, folder)
    return slice_length(base, ["machine_id"], "predicted_at")


def hits(spark, folder, inline_limit=rules.INLINE_LIMIT, length=AUTO):
    base = roles.events_predictions(spark, folder)
    context = rules.with_context(base, PRED_ORDER, slice_length=length)
    return rules.rule_hits(context, stretched_rules(spark), inline_limit)


_HIT_SQL = f"WITH {_HITS} SELECT machine_id, event_id, rule_id, severity FROM hits"


@query("rule_hits", _HIT_SQL)
def rule_hits(spark, folder):
    return hits(spark, folder).select("machine_id", "event_id", "rule_id", "severity")


@query("rule_hits_joined", _HIT_SQL)
def rule_hits_joined(spark, folder):
    """The index of large rule sets, forced by an inline limit of zero."""
    return hits(spark, folder, inline_limit=0).select("machine_id", "event_id", "rule_id", "severity")


@query(
    "rule_hits_many",
    f"""WITH {_CONTEXT}, r AS (SELECT 'o' || o_orderkey AS rule_id, o_orderkey AS k, floor(o_totalprice) AS price,
        CASE WHEN o_orderkey % 64 = 1 THEN 'anomaly_score_above' WHEN o_orderkey % 2000 = 3 THEN 'health_label_is'
          WHEN o_orderkey % 2 = 0 THEN 'rul_below' ELSE 'rul_drop_rate' END AS kind FROM orders)
    SELECT machine_id, event_id, rule_id, kind AS condition_type FROM x JOIN r
      ON kind = 'rul_below' AND rul_cycles < price / 10000000::DOUBLE
    UNION ALL SELECT machine_id, event_id, rule_id, kind FROM x JOIN r
      ON kind = 'rul_drop_rate' AND previous_rul - rul_cycles > 400 + price / 5000::DOUBLE
    UNION ALL SELECT machine_id, event_id, rule_id, kind FROM x JOIN r
      ON kind = 'anomaly_score_above' AND anomaly_score > 0.98::DOUBLE + price / 100000000::DOUBLE
    UNION ALL SELECT machine_id, event_id, rule_id, kind FROM x JOIN r
      ON kind = 'health_label_is' AND health_label = 'imminent_failure'""",
)
def rule_hits_many(spark, folder):
    """Every order a rule, with a threshold that few events pass."""
    price, key = F.floor("o_totalprice").cast("double"), F.col("o_orderkey")
    kind = (
        F.when(key % 64 == 1, "anomaly_score_above")
        .when(key % 2000 == 3, "health_label_is")
        .when(key % 2 == 0, "rul_below")
        .otherwise("rul_drop_rate")
    )
    bound = (
        F.when(kind == "rul_below", (price / 10_000_000.0).cast("string"))
        .when(kind == "rul_drop_rate", (400 + price / 5_000.0).cast("string"))
        .when(kind == "anomaly_score_above", (0.98 + price / 100_000_000.0).cast("string"))
        .otherwise("imminent_failure")
    )
    name = roles.mapped(kind, rules.THRESHOLD_NAME)
    table = roles.table(spark, folder, "orders").select(
        F.concat(F.lit("o"), key.cast("string")).alias("rule_id"),
        F.concat(F.lit("Order "), key.cast("string")).alias("rule_name"),
        F.lit("info").alias("severity"),
        kind.alias("condition_type"),
        F.create_map(name, bound).alias("thresholds"),
        F.lit(60).alias("cooldown_s"),
        F.lit(True).alias("enabled"),
    )
    context = rules.with_context(roles.events_predictions(spark, folder), PRED_ORDER)
    return rules.rule_hits(context, table).select("machine_id", "event_id", "rule_id", "condition_type")


def _chain_sql(held: str, source: str) -> str:
    """Recursive fold over numbered rows; ``held`` tests a row against the last opener."""
    return f""", num AS (SELECT *, row_number() OVER (PARTITION BY machine_id, rule_id
      ORDER BY predicted_at, event_id) AS rn FROM {source}),
    chain AS (SELECT machine_id, rule_id, rn, event_id, predicted_at AS opened, true AS fired
      FROM num WHERE rn = 1
    UNION ALL SELECT n.machine_id, n.rule_id, n.rn, n.event_id,
      CASE WHEN {held} THEN c.opened ELSE n.predicted_at END, NOT ({held})
      FROM chain c JOIN num n ON n.machine_id = c.machine_id AND n.rule_id = c.rule_id AND n.rn = c.rn + 1)"""


_COOLED = (
    f"WITH RECURSIVE {_HITS}"
    + _chain_sql("epoch_us(n.predicted_at) - epoch_us(c.opened) < n.cooldown_s::BIGINT * 1000000", "hits")
)


@query(
    "rule_cooldown",
    _COOLED
    + """ SELECT h.machine_id, h.rule_id, h.event_id, h.predicted_at,
      '[' || upper(severity) || '] ' || h.machine_id || ': ' || rule_name AS title
    FROM chain c JOIN hits h USING (machine_id, rule_id, event_id) WHERE fired""",
)
def rule_cooldown(spark, folder):
    length = prediction_slice(spark, folder)
    fired = rules.apply_cooldown(hits(spark, folder, length=length), PRED_ORDER, slice_length=length)
    return fired.select("machine_id", "rule_id", "event_id", "predicted_at", incidents.incident_title().alias("title"))


_GROUPS = (
    f"WITH RECURSIVE {_HITS}"
    + _chain_sql(f"epoch_us(n.predicted_at) - epoch_us(c.opened) <= {DAY_S}::BIGINT * 1000000", "hits")
    + """, grp AS (SELECT machine_id, rule_id, c.opened AS window_start, count(*) AS merged,
      max(severity) AS severity, max('[' || upper(severity) || '] ' || machine_id || ': ' || rule_name) AS title,
      max(h.predicted_at) AS triggered_at
    FROM chain c JOIN hits h USING (machine_id, rule_id, event_id) GROUP BY ALL)"""
)


def _grouped(spark, folder):
    length = prediction_slice(spark, folder)
    rows = hits(spark, folder, length=length).select(
        "machine_id",
        "rule_id",
        "severity",
        incidents.incident_title().alias("title"),
        F.col("predicted_at").alias("triggered_at"),
        F.col("event_id").alias("incident_id"),
    )
    return incidents.aggregate_incidents(rows, DAY_S, slice_length=length)


@query(
    "incident_groups",
    _GROUPS + " SELECT machine_id, rule_id, window_start, merged, severity, title, triggered_at FROM grp",
)
def incident_groups(spark, folder):
    return _grouped(spark, folder).drop("incident_id")


@query(
    "notifications",
    _GROUPS
    + f""", m AS (SELECT CAST(user_id AS VARCHAR) AS machine_id FROM (SELECT user_id,
        arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50, ts) AS enabled
      FROM events WHERE event_type = 'signup' GROUP BY 1) WHERE enabled),
    s AS (SELECT *, CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS sr,
      make_timestamp(CAST(floor(epoch(window_start) / {DAY_S}) AS BIGINT) * {DAY_S} * 1000000) AS flushed_at FROM grp),
    n AS (SELECT machine_id, flushed_at, arg_min(severity, (-sr, triggered_at, rule_id)) AS severity,
      arg_min(title, (-sr, triggered_at, rule_id)) AS title, min(triggered_at) AS triggered_at,
      count(*) AS incident_count FROM s GROUP BY ALL)
    SELECT n.* FROM n ANTI JOIN m USING (machine_id)
    WHERE severity = 'critical' OR NOT (hour(triggered_at) >= 22 OR hour(triggered_at) < 6)""",
)
def notifications(spark, folder):
    """Daily flush; a machine's latest signup with k at least 50 plays maintenance."""
    switches = roles.table(spark, folder, "events").where(F.col("event_type") == "signup").select(
        F.col("user_id").cast("string").alias("machine_id"),
        (F.get_json_object("props", "$.k").cast("int") >= 50).alias("enabled"),
        F.col("ts").alias("changed_at"),
    )
    groups = incidents.flush_groups(_grouped(spark, folder), DAY_S)
    out = incidents.notifications(groups, incidents.maintenance_state(switches), (22, 6))
    return longs(ntz(out.drop("payload"), "flushed_at"), "incident_count")


@query(
    "incident_state",
    """WITH log AS (SELECT o_orderkey AS id, 'open' AS action, o_orderdate AS t, 0::BIGINT AS no,
        NULL AS actor, NULL AS note FROM orders
      UNION ALL SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'acknowledge' ELSE 'close' END, l_shipdate,
        l_linenumber::BIGINT * 1000000000 + l_partkey, CAST(l_suppkey AS VARCHAR),
        l_returnflag || '-' || CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag IN ('A', 'R')),
    o AS (SELECT id, t, no FROM log WHERE action = 'open'),
    l AS (SELECT g.*, o.t AS opened, row_number() OVER (PARTITION BY g.id, g.action
        ORDER BY g.t, g.no, g.actor, g.note) AS k
      FROM log g JOIN o USING (id) WHERE g.action <> 'open' AND (g.t, g.no) > (o.t, o.no)),
    c AS (SELECT * FROM l WHERE action = 'close' AND k = 1),
    a AS (SELECT l.* FROM l LEFT JOIN c USING (id) WHERE l.action = 'acknowledge' AND l.k = 1
        AND (c.id IS NULL OR (l.t, l.no) < (c.t, c.no)))
    SELECT o.id AS incident_id, CASE WHEN c.id IS NOT NULL THEN 'closed' WHEN a.id IS NOT NULL
      THEN 'acknowledged' ELSE 'open' END AS status, o.t AS triggered_at, a.t AS acknowledged_at,
      a.actor AS acknowledged_by, c.t AS closed_at, c.note AS resolution_note
    FROM o LEFT JOIN a USING (id) LEFT JOIN c USING (id)""",
)
def incident_state(spark, folder):
    return incidents.current_incidents(roles.incident_actions(spark, folder))


# --- scoring fields ------------------------------------------------------


@query(
    "score_fields",
    f"""WITH {E_PRED}, b AS (SELECT *, greatest(rul_cycles * (1 - anomaly_score), 0) AS lo,
      rul_cycles * (1 + anomaly_score) AS hi, anomaly_score AS a FROM p),
    c AS (SELECT *, greatest(0.0, least(1.0, 1 - (hi - lo) / (greatest(rul_cycles, 1) * 2))) AS confidence,
      [a, 1 - a, a * a, 0.25::DOUBLE] AS pr FROM b),
    d AS (SELECT *, list_sum(pr) AS total, list_max(pr) AS top FROM c)
    SELECT event_id, round(confidence, 6) + 0.0 AS confidence,
      round(greatest(0.0, least(1.0, 1 - confidence)), 6) + 0.0 AS anomaly,
      round(rul_cycles * 0.5::DOUBLE, 6) + 0.0 AS hours,
      CASE WHEN rul_cycles <= 30 THEN 'imminent_failure' WHEN rul_cycles <= 90 THEN 'critical'
        WHEN rul_cycles <= 180 THEN 'degrading' ELSE 'healthy' END AS serving_label,
      round(pr[1] / total, 6) + 0.0 AS p_healthy,
      ['healthy', 'degrading', 'critical', 'imminent_failure'][list_position(pr, top)] AS top_label FROM d""",
)
def score_fields(spark, folder):
    a, rul = F.col("anomaly_score"), F.col("rul_cycles")
    lower, upper = F.greatest(rul * (1 - a), F.lit(0.0)), rul * (1 + a)
    sure = scoring.confidence(rul, lower, upper)
    shares = F.array(a, 1 - a, a * a, F.lit(0.25))
    return roles.events_predictions(spark, folder).select(
        "event_id",
        r(sure).alias("confidence"),
        r(scoring.anomaly_score(sure)).alias("anomaly"),
        r(scoring.rul_hours(rul)).alias("hours"),
        labels.serving_health_of(rul).alias("serving_label"),
        r(F.element_at(scoring.named_probabilities(shares), "healthy")).alias("p_healthy"),
        scoring.top_label(shares).alias("top_label"),
    )


@query(
    "evaluation_checks",
    f"""WITH {E_PRED} SELECT event_id, CASE WHEN length(machine_id) NOT BETWEEN 1 AND 64 THEN 'machine_id'
      WHEN rul_cycles - 10 < 0 THEN 'rul_cycles' WHEN anomaly_score + 0.1::DOUBLE NOT BETWEEN 0 AND 1 THEN 'anomaly_score'
      WHEN 1.2::DOUBLE - anomaly_score NOT BETWEEN 0 AND 1 THEN 'confidence' END AS error FROM p""",
)
def evaluation_checks(spark, folder):
    """Shifted values, so that every range check meets rows on both sides."""
    shifted = roles.events_predictions(spark, folder).select(
        "event_id",
        "machine_id",
        (F.col("rul_cycles") - 10).alias("rul_cycles"),
        (F.lit(1.2) - F.col("anomaly_score")).alias("confidence"),
        (F.col("anomaly_score") + 0.1).alias("anomaly_score"),
    )
    return shifted.select("event_id", scoring.evaluation_error().alias("error"))
