"""Queries over metrics, drift tests, model comparison and message decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import drift, incidents, metrics, quality, views
from wearline.plans import roles
from wearline.plans.catalog import longs, query, r, rounded
from wearline.sources import messages

_ERR = (
    "r AS (SELECT l_returnflag, l_quantity AS y, l_extendedprice / 1800.0::DOUBLE AS f, "
    "l_extendedprice / 2000.0::DOUBLE AS g FROM lineitem)"
)


def _lines(spark, folder):
    return roles.table(spark, folder, "lineitem").select(
        "l_returnflag",
        F.col("l_quantity").alias("y"),
        (F.col("l_extendedprice") / 1800.0).alias("f"),
        (F.col("l_extendedprice") / 2000.0).alias("g"),
    )


@query(
    "regression_metrics",
    f"""WITH {_ERR} SELECT l_returnflag, count(*) AS n, round(avg(abs(f - y)), 6) + 0.0 AS mae,
      round(sqrt(avg((f - y) * (f - y))), 6) + 0.0 AS rmse,
      round(1 - sum((f - y) * (f - y)) / (var_pop(y) * count(*)), 6) + 0.0 AS r2,
      round(avg(abs(f - y) / (abs(y) + 1e-8::DOUBLE)) * 100, 4) + 0.0 AS mape
    FROM r GROUP BY 1""",
)
def regression_metrics(spark, folder):
    out = metrics.regression_metrics(_lines(spark, folder), "y", "f", ["l_returnflag"]).drop("phm_score")
    return rounded(rounded(out, ["mae", "rmse", "r2"]), ["mape"], 4)


@query(
    "phm_score",
    f"""WITH {_ERR} SELECT l_returnflag, round(sum(CASE WHEN f - y < 0 THEN exp(-(f - y) / 13.0::DOUBLE) - 1
      ELSE exp((f - y) / 10.0::DOUBLE) - 1 END), 3) + 0.0 AS phm_score FROM r GROUP BY 1""",
)
def phm_score(spark, folder):
    out = metrics.regression_metrics(_lines(spark, folder), "y", "f", ["l_returnflag"])
    return rounded(out.select("l_returnflag", "phm_score"), ["phm_score"], 3)


@query(
    "interval_width",
    f"WITH {_ERR} SELECT round(avg(f - g), 6) + 0.0 AS mean_interval_width FROM r",
)
def interval_width(spark, folder):
    return rounded(metrics.interval_width(_lines(spark, folder), "g", "f"), ["mean_interval_width"])


_CLASS_CTE = """k AS (SELECT CASE WHEN quality = 1 THEN 'healthy' ELSE 'critical' END AS actual,
  CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 1 AND doc_id // 3 * 3 = doc_id THEN 'degrading'
    ELSE 'healthy' END AS predicted FROM labels),
lab AS (SELECT unnest(['healthy', 'degrading', 'critical', 'imminent_failure']) AS label),
rep AS (SELECT label, (SELECT count(*) FROM k WHERE actual = label) AS support,
    (SELECT count(*) FROM k WHERE predicted = label) AS named,
    (SELECT count(*) FROM k WHERE actual = label AND predicted = label) AS hit FROM lab),
sc AS (SELECT *, CASE WHEN named > 0 THEN hit / named::DOUBLE ELSE 0.0 END AS pr,
    CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0.0 END AS re FROM rep),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END AS f1 FROM sc)"""


def _classes(spark, folder):
    """Quality plays the truth, toxic the prediction; every third clean document a near miss."""
    base = roles.table(spark, folder, "labels")
    third = F.pmod("doc_id", F.lit(3)) == 0
    return base.select(
        F.when(F.col("quality") == 1, "healthy").otherwise("critical").alias("actual"),
        F.when(F.col("toxic") == 1, "critical")
        .when((F.col("quality") == 1) & third, "degrading")
        .otherwise("healthy")
        .alias("predicted"),
    )


@query(
    "confusion_matrix",
    f"""WITH {_CLASS_CTE} SELECT a.label AS actual, b.label AS predicted,
      (SELECT count(*) FROM k WHERE k.actual = a.label AND k.predicted = b.label) AS n
    FROM lab a, lab b""",
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(_classes(spark, folder), "actual", "predicted")


@query(
    "class_report",
    f"""WITH {_CLASS_CTE} SELECT label, round(pr, 6) + 0.0 AS precision, round(re, 6) + 0.0 AS recall,
      round(f1, 6) + 0.0 AS f1, support FROM f""",
)
def class_report(spark, folder):
    out = metrics.class_report(_classes(spark, folder), "actual", "predicted").drop("hit")
    return rounded(out, ["precision", "recall", "f1"])


@query(
    "class_metrics",
    f"""WITH {_CLASS_CTE} SELECT round(sum(hit) / sum(support)::DOUBLE, 6) + 0.0 AS accuracy,
      round(avg(f1), 6) + 0.0 AS macro_f1, round(sum(f1 * support) / sum(support), 6) + 0.0 AS weighted_f1,
      round(max(CASE WHEN label = 'critical' THEN re END), 6) + 0.0 AS watched_recall FROM f""",
)
def class_metrics(spark, folder):
    out = metrics.classification_metrics(
        _classes(spark, folder), "actual", "predicted", watch="critical"
    )
    return rounded(out, out.columns)


_KS_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_KS_CUT = "1998-07-01"
_KS_SQL = (
    "WITH v AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, l_shipdate < TIMESTAMP '{_KS_CUT}' AS old FROM lineitem"
        for c in _KS_FEATURES
    )
    + """), c AS (SELECT feature, value, count(*) FILTER (old) AS a, count(*) FILTER (NOT old) AS b
      FROM v GROUP BY ALL),
    t AS (SELECT feature, sum(a) AS n1, sum(b) AS n2 FROM c GROUP BY 1),
    d AS (SELECT c.feature, n1, n2, max(abs(sum_a / n1 - sum_b / n2)) AS ks FROM (SELECT feature, value,
        CAST(sum(a) OVER w AS DOUBLE) AS sum_a, CAST(sum(b) OVER w AS DOUBLE) AS sum_b FROM c
        WINDOW w AS (PARTITION BY feature ORDER BY value)) c JOIN t USING (feature) GROUP BY ALL),
    l AS (SELECT *, ks * sqrt(n1::DOUBLE * n2 / (n1 + n2)) AS x FROM d),
    p AS (SELECT feature, n1, n2, ks, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(
        [CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2 * k * k * x * x) for k in generate_series(1, 100)])))
      END AS pv FROM l)"""
)


def _ks(spark, folder):
    base = roles.table(spark, folder, "lineitem").select("l_shipdate", *_KS_FEATURES)
    old = F.col("l_shipdate") < F.lit(_KS_CUT).cast("timestamp_ntz")
    return drift.ks_test(base.where(old), base.where(~old), _KS_FEATURES)


@query(
    "ks_drift",
    _KS_SQL
    + """ SELECT feature, CAST(n1 AS BIGINT) AS n_reference, CAST(n2 AS BIGINT) AS n_current,
      round(ks, 6) + 0.0 AS ks_statistic, round(pv, 6) + 0.0 AS p_value, pv < 0.05 AS drifted FROM p""",
)
def ks_drift(spark, folder):
    out = longs(_ks(spark, folder), "n_reference", "n_current")
    return rounded(out, ["ks_statistic", "p_value"])


@query(
    "drift_report",
    _KS_SQL
    + """ SELECT count(*) FILTER (pv < 0.05) > 0 AS detected, round(max(ks), 6) + 0.0 AS ks_statistic,
      coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (pv < 0.05), '') AS affected,
      round(min(pv), 6) + 0.0 AS p_value, CASE WHEN count(*) FILTER (pv < 0.05) > 0 THEN 'retrain'
        WHEN count(*) FILTER (pv < 0.15) > 0 THEN 'monitor' ELSE 'ok' END AS recommendation FROM p""",
)
def drift_report(spark, folder):
    out = drift.data_drift_report(_ks(spark, folder))
    return rounded(out, ["ks_statistic", "p_value"]).select(
        "detected",
        "ks_statistic",
        F.array_join("affected_features", ",").alias("affected"),
        "p_value",
        "recommendation",
    )


@query(
    "concept_drift",
    """WITH x AS (SELECT value AS e, ts >= TIMESTAMP '2024-01-16' AS late FROM events),
    m AS (SELECT count(*) FILTER (NOT late) AS n_baseline, count(*) FILTER (late) AS n_recent,
      avg(e) FILTER (NOT late) AS a, avg(e) FILTER (late) AS b,
      var_samp(e) FILTER (NOT late) / count(*) FILTER (NOT late) AS va,
      var_samp(e) FILTER (late) / count(*) FILTER (late) AS vb FROM x)
    SELECT n_baseline, n_recent, round(a, 6) + 0.0 AS baseline_mae, round(b, 6) + 0.0 AS recent_mae,
      round((b - a) / a, 6) + 0.0 AS error_increase, round((b - a) / sqrt(va + vb), 6) + 0.0 AS t_statistic,
      round((va + vb) * (va + vb) / (va * va / (n_baseline - 1) + vb * vb / (n_recent - 1)), 3) + 0.0 AS freedom
    FROM m""",
)
def concept_drift(spark, folder):
    """Values play absolute errors of the earlier and the later half of the month."""
    base = roles.table(spark, folder, "events").select(
        F.col("value").alias("e"),
        (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).cast("int").alias("side"),
    )
    out = drift.welch_moments(base, "e", "side")
    out = rounded(out, ["baseline_mae", "recent_mae", "error_increase", "t_statistic"])
    return rounded(out, ["freedom"], 3)


@query(
    "model_compare",
    f"""WITH {_ERR}, d AS (SELECT abs(f - y) AS b, abs(g - y) AS c FROM r),
    m AS (SELECT count(*) AS n, avg(b) AS b, avg(c) AS c, avg(c - b) AS d, stddev_samp(c - b) / sqrt(count(*)) AS se FROM d)
    SELECT n, round(b, 6) + 0.0 AS baseline_mae, round(c, 6) + 0.0 AS challenger_mae,
      round(d, 6) + 0.0 AS delta_mae, round(d / se, 4) + 0.0 AS t_statistic,
      d / se < -1.7 AND d < 0 AS challenger_better,
      CASE WHEN d / se < -1.7 AND d < 0 THEN 'promote' WHEN d / se > -0.5 THEN 'inconclusive' ELSE 'discard' END
        AS recommendation FROM m""",
)
def model_compare(spark, folder):
    """The SQL bounds t instead of p: with many rows t below -1.7 is p below 0.05,
    t above -0.5 is p above 0.3, and the data lies far from both."""
    out = drift.compare_rul(_lines(spark, folder), "y", "f", "g").drop("p_value")
    return rounded(rounded(out, ["baseline_mae", "challenger_mae", "delta_mae"]), ["t_statistic"], 4)


_HEALTH_PROBS = """h AS (SELECT doc_id, 2 * quality + toxic AS y,
  [0.1 + (doc_id * 7 % 11) / 20.0::DOUBLE, 0.1 + (doc_id * 5 % 13) / 20.0::DOUBLE,
   0.1 + (doc_id * 3 % 17) / 20.0::DOUBLE, 0.1 + (doc_id % 19) / 20.0::DOUBLE] AS b FROM labels),
hc AS (SELECT *, [CASE WHEN i - 1 = y THEN b[i] + doc_id % 5 / 10.0::DOUBLE ELSE b[i] END for i in [1, 2, 3, 4]] AS c FROM h),
a AS (SELECT *, list_position(b, list_max(b)) - 1 AS bp, list_position(c, list_max(c)) - 1 AS cp,
  b[y + 1] AS bv, c[y + 1] AS cv FROM hc)"""


@query(
    "health_compare",
    f"""WITH {_HEALTH_PROBS}, cls AS (SELECT unnest([0, 1, 2, 3]) AS k),
    s AS (SELECT k, (SELECT count(*) FROM a WHERE y = k) AS sup, (SELECT count(*) FROM a WHERE bp = k) AS nb,
      (SELECT count(*) FROM a WHERE cp = k) AS nc, (SELECT count(*) FROM a WHERE bp = k AND y = k) AS hb,
      (SELECT count(*) FROM a WHERE cp = k AND y = k) AS hcc FROM cls),
    m AS (SELECT count(*) AS n, avg(cv - bv) AS d, stddev_samp(cv - bv) / sqrt(count(*)) AS se,
      avg(abs(cv - 1)) - avg(abs(bv - 1)) AS dm FROM a)
    SELECT n, round(dm, 6) + 0.0 AS delta_mae, round(d / se, 4) + 0.0 AS t_statistic,
      round((SELECT avg(CASE WHEN sup + nb > 0 THEN 2.0 * hb / (sup + nb) END) FROM s), 6) + 0.0 AS baseline_f1,
      round((SELECT avg(CASE WHEN sup + nc > 0 THEN 2.0 * hcc / (sup + nc) END) FROM s), 6) + 0.0 AS challenger_f1,
      round((SELECT hb / nullif(sup, 0)::DOUBLE FROM s WHERE k = 3), 6) + 0.0 AS baseline_recall,
      round((SELECT hcc / nullif(sup, 0)::DOUBLE FROM s WHERE k = 3), 6) + 0.0 AS challenger_recall
    FROM m""",
)
def health_compare(spark, folder):
    """Labels with made-up probabilities; the challenger favours the true class."""
    doc = F.col("doc_id")
    base = [
        F.lit(0.1) + F.pmod(doc * m, F.lit(k)) / F.lit(20.0)
        for m, k in ((7, 11), (5, 13), (3, 17), (1, 19))
    ]
    y = (2 * F.col("quality") + F.col("toxic")).cast("int")
    rows = roles.table(spark, folder, "labels").select(
        y.alias("y"),
        F.array(*base).alias("b"),
        F.array(*[F.when(y == i, p + F.pmod(doc, F.lit(5)) / F.lit(10.0)).otherwise(p) for i, p in enumerate(base)]).alias("c"),
    )
    out = drift.compare_health(rows, "y", "b", "c")
    out = out.select(
        "n", "delta_mae", "t_statistic", "baseline_f1", "challenger_f1", "baseline_recall", "challenger_recall"
    )
    out = rounded(out, ["delta_mae", "baseline_f1", "challenger_f1", "baseline_recall", "challenger_recall"])
    return rounded(out, ["t_statistic"], 4)


# --- messages --------------------------------------------------------------


def raw_messages(spark, folder):
    """Events as JSON messages: errors are broken text, signups hold a JSON null,
    users 0 to 9 write a blank id, purchases leave the readings out when k is below 20."""
    k = F.get_json_object("props", "$.k").cast("int")
    number = F.format_string("%.2f", F.col("value"))
    machine = F.when(F.length(F.col("user_id").cast("string")) == 1, F.lit(" ")).otherwise(
        F.col("user_id").cast("string")
    )
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    head = F.concat(F.lit('{"machine_id": "'), machine, F.lit('", "recorded_at": "'), time, F.lit('", "cycle": '), F.col("event_id"))
    second = (
        F.when(F.col("event_type") == "signup", F.lit("null"))
        .when(F.col("event_type") == "view", F.lit("NaN"))
        .otherwise(k.cast("string"))
    )
    body = F.concat(
        head, F.lit(', "readings": {"a": '), number, F.lit(', "b": '), second, F.lit(', "c": 1.5}}')
    )
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("not json {{{"), number))
        .when((F.col("event_type") == "purchase") & (k < 20), F.concat(head, F.lit("}")))
        .otherwise(body)
    )
    return roles.table(spark, folder, "events").select(
        "event_id",
        text.alias("value"),
        F.lit("sensors").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
    )


_MESSAGE_SQL = """k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  user_id < 10 AS blank FROM events),
d AS (SELECT *, event_type = 'error' OR event_type = 'signup' OR (event_type = 'purchase' AND k < 20) AS broken,
  CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS nulls FROM k),
g AS (SELECT *, NOT broken AND (blank OR nulls / 3.0 > 0.3) AS rejected FROM d)"""


@query(
    "decode_reject",
    f"""WITH {_MESSAGE_SQL} SELECT event_id, CASE WHEN broken THEN 'parse_error' WHEN rejected THEN 'quality_rejected'
      ELSE 'accepted' END AS outcome, CASE WHEN NOT broken THEN round(value, 2) + 0.0 END AS a FROM g""",
)
def decode_reject(spark, folder):
    decoded = quality.null_counts(messages.decode(raw_messages(spark, folder), "reading"))
    flags = quality.stateless_flags(quality.QualityLimits(), F.lit("2025-01-01").cast("timestamp"))
    rejected = flags["MISSING_ID"] | flags["FUTURE_TIMESTAMP"] | flags["NULL_FRACTION_HIGH"]
    outcome = (
        F.when(F.col("parse_error"), "parse_error").when(rejected, "quality_rejected").otherwise("accepted")
    )
    value = F.when(~F.col("parse_error"), F.try_element_at("readings", F.lit("a")))
    return decoded.select("event_id", outcome.alias("outcome"), r(value, 2).alias("a"))


@query(
    "dead_letters",
    f"""WITH {_MESSAGE_SQL} SELECT 'parse_error' AS reason, event_id AS "offset", '' AS flags FROM g WHERE broken
    UNION ALL SELECT 'quality_rejected', event_id, concat_ws(',', CASE WHEN blank THEN 'MISSING_ID' END,
      CASE WHEN nulls > 0 THEN 'NULL_FRACTION_HIGH' END, 'SENSOR_COUNT_LOW') FROM g WHERE rejected""",
)
def dead_letters(spark, folder):
    """Both dead-letter envelopes, read back from their JSON."""
    decoded = messages.decode(raw_messages(spark, folder), "reading")
    good, broken = messages.split_decoded(decoded)
    first = messages.decode_envelope(broken, "quality").select(
        F.lit("parse_error").alias("reason"),
        F.get_json_object("value", "$.offset").cast("long").alias("offset"),
        F.lit("").alias("flags"),
    )
    states = quality.stateless_flags(quality.QualityLimits(), F.lit("2025-01-01").cast("timestamp"))
    states["DUPLICATE_TIMESTAMP"] = F.lit(False)
    states["OUTLIER_DETECTED"] = F.lit(False)
    _, names = quality.flag_columns(states)
    reject = states["MISSING_ID"] | states["FUTURE_TIMESTAMP"] | states["NULL_FRACTION_HIGH"]
    rejects = quality.null_counts(good).where(reject).withColumn("_flags", names)
    envelopes = messages.stage_envelope(
        rejects, "quality_rejected", F.col("_flags"), F.lit("2025-01-01").cast("timestamp")
    )
    second = envelopes.select(
        F.from_json("value", "reason string, flags array<string>, original string, dlq_at string").alias("e")
    ).select(
        F.col("e.reason").alias("reason"),
        # The original text is kept whole, so the message's own number can be read back.
        F.regexp_extract("e.original", r'"cycle": (\d+)', 1).cast("long").alias("offset"),
        F.array_join("e.flags", ",").alias("flags"),
    )
    return first.unionByName(second)


@query(
    "message_counts",
    f"""WITH {_MESSAGE_SQL} SELECT unnest(CASE WHEN broken THEN ['dlq'] WHEN rejected THEN ['rejected', 'dlq']
      ELSE ['processed'] END) AS status, count(*) AS n FROM g GROUP BY 1""",
)
def message_counts(spark, folder):
    decoded = messages.decode(raw_messages(spark, folder), "reading")
    good, broken = messages.split_decoded(decoded)
    checked = quality.check_quality(
        good, as_of=F.lit("2025-01-01").cast("timestamp"), order=["recorded_at", "event_id"]
    )
    return views.message_counts(checked, broken)


@query(
    "quiet_hours",
    """SELECT event_id, hour(ts) >= 22 OR hour(ts) < 6 AS overnight, hour(ts) >= 8 AND hour(ts) < 18 AS daytime
    FROM events""",
)
def quiet_hours(spark, folder):
    base = roles.table(spark, folder, "events")
    return base.select(
        "event_id",
        incidents.in_quiet_hours(F.col("ts"), 22, 6).alias("overnight"),
        incidents.in_quiet_hours(F.col("ts"), 8, 18).alias("daytime"),
    )
