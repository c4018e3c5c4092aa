"""Queries over joins, labels, splits, folds, sequences and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wearline import session
from wearline.operators import labels, metrics, sequences, splits, views
from wearline.operators.asof import asof_backward
from wearline.operators.slices import with_cycle
from wearline.plans import roles
from wearline.plans.catalog import CYCLES, E_LONG, longs, ntz, query, rounded
from wearline.plans.roles import EVENT_ORDER
from wearline.sources import snapshots, tables


def cycles(spark, folder):
    return with_cycle(roles.events_long(spark, folder), ["machine_id"], EVENT_ORDER)


def labelled(spark, folder):
    return labels.assign_rul(cycles(spark, folder))


@query(
    "asof_cycle",
    f"""WITH {CYCLES}, v AS (SELECT * FROM c WHERE sensor = 'view'),
    x AS (SELECT machine_id, recorded_at, cycle FROM c WHERE sensor = 'error')
    SELECT v.machine_id, v.recorded_at, v.event_id, CAST(x.cycle AS BIGINT) AS cycle
    FROM v ASOF LEFT JOIN x ON v.machine_id = x.machine_id AND v.recorded_at >= x.recorded_at""",
)
def asof_cycle(spark, folder):
    """Features are the view events; cycles come from the error events."""
    numbered = cycles(spark, folder)
    features = numbered.where(F.col("sensor") == "view").select("machine_id", "recorded_at", "event_id")
    lookup = numbered.where(F.col("sensor") == "error").select(
        "machine_id", F.col("recorded_at").alias("cycle_at"), "event_id", "cycle"
    )
    return asof_backward(
        features,
        lookup,
        by=["machine_id"],
        left_on="recorded_at",
        right_on="cycle_at",
        take=["cycle"],
        right_ties=["event_id"],
        store=True,
    )


@query(
    "rul_label",
    f"WITH {CYCLES} SELECT machine_id, recorded_at, event_id, cycle, CAST(rul_cycles AS BIGINT) AS rul_cycles FROM u",
)
def rul_label(spark, folder):
    out = labelled(spark, folder).select("machine_id", *EVENT_ORDER, "cycle", "rul_cycles")
    return longs(out, "cycle", "rul_cycles")


@query(
    "rul_uncapped",
    f"""WITH {CYCLES} SELECT machine_id, event_id,
      max(cycle) OVER (PARTITION BY machine_id) - cycle AS rul_cycles FROM c""",
)
def rul_uncapped(spark, folder):
    out = labels.assign_rul(cycles(spark, folder), cap=None)
    return longs(out.select("machine_id", "event_id", "rul_cycles"), "rul_cycles")


@query(
    "rul_per_life",
    f"""WITH {E_LONG}, k AS (SELECT *, CAST(extract(hour FROM recorded_at) AS BIGINT) AS cycle FROM e),
    b AS (SELECT *, lag(cycle) OVER (PARTITION BY machine_id ORDER BY recorded_at, event_id) AS before FROM k),
    s AS (SELECT *, CAST(sum(CASE WHEN cycle < before THEN 1 ELSE 0 END) OVER (PARTITION BY machine_id
      ORDER BY recorded_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS life_id FROM b)
    SELECT machine_id, event_id, life_id,
      max(cycle) OVER (PARTITION BY machine_id, life_id) - cycle AS rul_cycles FROM s""",
)
def rul_per_life(spark, folder):
    """The hour of day plays a cycle counter that restarts; lives are told apart first."""
    base = roles.events_long(spark, folder).withColumn("cycle", F.hour("recorded_at").cast("long"))
    lives = labels.with_life(base, EVENT_ORDER)
    out = labels.assign_rul(lives, cap=None, keys=["machine_id", "life_id"])
    return longs(out.select("machine_id", "event_id", "life_id", "rul_cycles"), "life_id", "rul_cycles")


@query(
    "health_label",
    f"""WITH {CYCLES} SELECT machine_id, event_id, CASE WHEN rul_cycles >= 100 THEN 'healthy'
      WHEN rul_cycles >= 50 THEN 'degrading' WHEN rul_cycles >= 20 THEN 'critical'
      ELSE 'imminent_failure' END AS health_label FROM u""",
)
def health_label(spark, folder):
    return labels.assign_health(labelled(spark, folder)).select("machine_id", "event_id", "health_label")


_SPLIT_SQL = f"""WITH {E_LONG}, ids AS (SELECT DISTINCT machine_id FROM e),
n AS (SELECT *, row_number() OVER (ORDER BY machine_id) - 1 AS pos, count(*) OVER () AS n FROM ids),
"""


@query(
    "machine_split",
    _SPLIT_SQL
    + """z AS (SELECT machine_id, CASE
      WHEN pos < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train'
      WHEN pos < greatest(1, floor(n * 0.7::DOUBLE)) + greatest(1, floor(n * 0.15::DOUBLE)) THEN 'validation'
      ELSE 'test' END AS split FROM n)
    SELECT split, machine_id, count(*) AS rows FROM e JOIN z USING (machine_id) GROUP BY ALL""",
)
def machine_split(spark, folder):
    base = roles.events_long(spark, folder)
    joined = splits.with_split(base, splits.machine_split(base))
    return joined.groupBy("split", "machine_id").agg(F.count("*").alias("rows"))


@query(
    "tail_split",
    _SPLIT_SQL
    + """z AS (SELECT machine_id, CASE
      WHEN pos >= n - greatest(1, floor(n * 0.15::DOUBLE)) THEN 'test'
      WHEN pos >= n - greatest(1, floor(n * 0.15::DOUBLE)) - greatest(1, floor(n * 0.15::DOUBLE)) THEN 'validation'
      ELSE 'train' END AS split FROM n)
    SELECT e.machine_id, e.event_id FROM e JOIN z USING (machine_id) WHERE split = 'train'""",
)
def tail_split(spark, folder):
    """Rows left to train once test and validation ids are taken from the tail."""
    base = roles.events_long(spark, folder)
    parts = splits.tail_split(base)
    return splits.rows_of_split(base, parts, "train").select("machine_id", "event_id")


_FOLDS, _GAP = 4, 10


@query(
    "walk_forward_folds",
    f"""WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position,
      count(*) OVER () AS n FROM orders),
    f AS (SELECT *, n // {_FOLDS + 1} AS size, unnest(generate_series(0, {_FOLDS - 1})) AS fold_id FROM s),
    g AS (SELECT *, n - ({_FOLDS} - fold_id) * size AS train_end FROM f),
    h AS (SELECT *, CASE WHEN position < train_end THEN 'train' WHEN position >= train_end + {_GAP}
      AND position < least(train_end + {_GAP} + size, n) THEN 'test' END AS role FROM g)
    SELECT o_orderkey, CAST(position AS BIGINT) AS position, CAST(fold_id AS BIGINT) AS fold_id, role
    FROM h WHERE role IS NOT NULL""",
)
def walk_forward_folds(spark, folder):
    base = roles.table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    out = splits.walk_forward_folds(base, ["o_orderdate", "o_orderkey"], _FOLDS, _GAP)
    return longs(out.drop("o_orderdate"), "position", "fold_id")


_STEPS = 3


@query(
    "sequence_windows",
    f"""WITH t AS (SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS chars FROM conversations),
    w AS (SELECT conv_id, turn, list(turn) OVER s AS turns, list(chars) OVER s AS sizes,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM t
      WINDOW s AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {_STEPS - 1} PRECEDING AND CURRENT ROW))
    SELECT conv_id, turn, {", ".join(f"CAST(turns[{i + 1}] AS DOUBLE) AS turn_t{i}, sizes[{i + 1}] AS chars_t{i}" for i in range(_STEPS))},
      sizes[{_STEPS}] AS label
    FROM w WHERE rn >= {_STEPS}""",
)
def sequence_windows(spark, folder):
    base = roles.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.length("text").cast("double").alias("chars")
    )
    made = sequences.sliding_sequences(
        base, ["turn", "chars"], "chars", _STEPS, keys=["conv_id"], order=["turn"]
    )
    flat = sequences.flatten_sequence(
        made.select("conv_id", F.col("turn"), "sequence", "label"), ["turn", "chars"], _STEPS
    )
    return flat


_LONG = 8


@query(
    "padded_sequences",
    f"""WITH g AS (SELECT conv_id, list(CAST(length(text) AS DOUBLE) ORDER BY turn) AS v
      FROM conversations GROUP BY conv_id)
    SELECT conv_id, {", ".join(f"CASE WHEN len(v) >= {_LONG - i} THEN v[{i - _LONG}] ELSE 0.0 END AS chars_t{i}" for i in range(_LONG))},
      v[-1] AS label FROM g WHERE len(v) < {_LONG}""",
)
def padded_sequences(spark, folder):
    """Conversations shorter than eight turns, padded in front."""
    base = roles.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.length("text").cast("double").alias("chars")
    )
    made = sequences.short_sequences(
        base, ["chars"], "chars", _LONG, keys=["conv_id"], order=["turn"]
    )
    return sequences.flatten_sequence(made, ["chars"], _LONG)


@query(
    "quartile_classes",
    f"""WITH {CYCLES}, q AS (SELECT quantile_cont(rul_cycles, 0.75) AS a, quantile_cont(rul_cycles, 0.5) AS b,
      quantile_cont(rul_cycles, 0.25) AS c FROM u)
    SELECT machine_id, event_id, CAST(CASE WHEN rul_cycles >= a THEN 0 WHEN rul_cycles >= b THEN 1
      WHEN rul_cycles >= q.c THEN 2 ELSE 3 END AS BIGINT) AS rul_class FROM u, q""",
)
def quartile_classes(spark, folder):
    out = labels.quartile_classes(labelled(spark, folder))
    return longs(out.select("machine_id", "event_id", "rul_class"), "rul_class")


_HEALTH_CTE = """, h AS (SELECT *, CASE WHEN rul_cycles >= 100 THEN 'healthy'
  WHEN rul_cycles >= 50 THEN 'degrading' WHEN rul_cycles >= 20 THEN 'critical'
  ELSE 'imminent_failure' END AS health_label FROM u)"""


@query(
    "class_weights",
    f"""WITH {CYCLES}{_HEALTH_CTE}, k AS (SELECT health_label, count(*) AS support FROM h GROUP BY 1)
    SELECT health_label, support, round((SELECT sum(support) FROM k)::DOUBLE /
      ((SELECT count(*) FROM k) * support), 6) + 0.0 AS weight FROM k""",
)
def class_weights(spark, folder):
    return rounded(labels.class_weights(labels.assign_health(labelled(spark, folder))), ["weight"])


@query(
    "label_summary",
    f"""WITH {CYCLES} SELECT CAST(min(rul_cycles) AS BIGINT) AS min_rul, CAST(max(rul_cycles) AS BIGINT) AS max_rul,
      round(avg(rul_cycles), 6) + 0.0 AS mean_rul FROM u""",
)
def label_summary(spark, folder):
    out = views.label_summary(labelled(spark, folder))
    return longs(rounded(out, ["mean_rul"]), "min_rul", "max_rul")


@query(
    "extraction_summary",
    """SELECT count(*) AS rows, count(DISTINCT l_suppkey) AS machines, CAST(4 AS BIGINT) AS features
    FROM lineitem""",
)
def extraction_summary(spark, folder):
    return views.extraction_summary(roles.lines_wide(spark, folder), roles.SENSORS)


@query(
    "training_join",
    f"""WITH {CYCLES} SELECT e.machine_id, e.recorded_at, e.sensor, e.value, CAST(u.rul_cycles AS BIGINT) AS rul_cycles
    FROM e JOIN u ON e.machine_id = u.machine_id AND e.recorded_at = u.recorded_at""",
)
def training_join(spark, folder):
    features = roles.events_long(spark, folder).select("machine_id", "recorded_at", "sensor", "value")
    rul = labelled(spark, folder).select("machine_id", "recorded_at", "rul_cycles")
    joined = features.join(rul, ["machine_id", "recorded_at"], "inner")
    return longs(joined, "rul_cycles")


@query(
    "drift_windows",
    f"""WITH {E_LONG} SELECT CASE WHEN recorded_at < TIMESTAMP '2024-01-21' THEN 'reference' ELSE 'current' END AS side,
      event_id, recorded_at, value FROM e""",
)
def drift_windows(spark, folder):
    """All rows before and from the 21st, the samples drift is tested on."""
    base = roles.events_long(spark, folder).select("event_id", "recorded_at", "value")
    early = F.col("recorded_at") < F.lit("2024-01-21").cast("timestamp_ntz")
    return base.withColumn("side", F.when(early, "reference").otherwise("current"))


@query(
    "error_windows",
    """SELECT CASE WHEN ts < TIMESTAMP '2024-01-24' THEN 'baseline' ELSE 'recent' END AS side, event_id,
      round(abs(value - 25.0::DOUBLE), 6) + 0.0 AS abs_error FROM events""",
)
def error_windows(spark, folder):
    """All errors on either side of a week ago, 25 playing the truth."""
    early = F.col("ts") < F.lit("2024-01-24").cast("timestamp_ntz")
    rows = roles.table(spark, folder, "events").select(
        F.when(early, "baseline").otherwise("recent").alias("side"), "event_id", F.abs(F.col("value") - 25.0).alias("abs_error")
    )
    return rounded(rows, ["abs_error"])


@query(
    "range_scan",
    f"""WITH {E_LONG} SELECT machine_id, recorded_at, event_id, value FROM e
    WHERE recorded_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
def range_scan(spark, folder):
    """Written by day, read back through the range reader that prunes days."""
    path = f"{session.shared_dir(spark)}/range-{uuid.uuid4().hex}"
    base = roles.events_long(spark, folder).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    tables.write_by_day(base, path, "recorded_at")
    out = tables.read_range(spark, path, "recorded_at", "2024-01-05", "2024-01-20 12:00:00")
    return ntz(out.select("machine_id", "recorded_at", "event_id", "value"), "recorded_at")


@query(
    "snapshot_roundtrip",
    f"""WITH {CYCLES}, ids AS (SELECT DISTINCT machine_id FROM e),
    n AS (SELECT *, row_number() OVER (ORDER BY machine_id) - 1 AS pos, count(*) OVER () AS n FROM ids)
    {_HEALTH_CTE}
    SELECT h.machine_id, h.event_id, CAST(h.rul_cycles AS BIGINT) AS rul_cycles, h.health_label,
      round(h.value, 6) + 0.0 AS temporal__value, CAST(h.cycle AS DOUBLE) AS temporal__cycle
    FROM h JOIN n USING (machine_id) WHERE pos < greatest(1, floor(n * 0.7::DOUBLE))""",
)
def snapshot_roundtrip(spark, folder):
    """Labelled rows saved under a version and split, then the train split loaded again."""
    path = f"{session.shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    data = labels.assign_health(labelled(spark, folder))
    parts = splits.machine_split(data.select("machine_id"))
    wide = splits.with_split(data, parts).select(
        "machine_id",
        "event_id",
        "rul_cycles",
        "health_label",
        "split",
        F.col("value").alias("temporal__value"),
        F.col("cycle").cast("double").alias("temporal__cycle"),
    )
    features = ["temporal__value", "temporal__cycle"]
    snapshots.save_snapshot(wide, path, "v1", features, snapshot_at="2024-02-01 00:00:00", keep=["event_id"])
    out = snapshots.load_snapshot(spark, path, "v1", "train", keep=["event_id"])
    out = out.select("machine_id", "event_id", "rul_cycles", "health_label", *features)
    return longs(rounded(out, ["temporal__value"]), "rul_cycles")


@query(
    "retention_cut",
    f"""WITH {E_LONG} SELECT machine_id, event_id, recorded_at FROM e
    WHERE recorded_at >= TIMESTAMP '2024-01-21'""",
)
def retention_cut(spark, folder):
    """Ten days kept as of 2024-01-31."""
    path = f"{session.shared_dir(spark)}/retention-{uuid.uuid4().hex}"
    base = roles.events_long(spark, folder).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    tables.write_by_day(base, path, "recorded_at")
    tables.apply_retention(spark, path, "2024-01-31", 10)
    out = tables.read_range(spark, path, "recorded_at")
    return ntz(out.select("machine_id", "event_id", "recorded_at"), "recorded_at")


@query(
    "dedup_insert",
    """WITH o AS (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem WHERE l_returnflag = 'A'),
    x AS (SELECT DISTINCT l_suppkey, l_shipdate FROM lineitem WHERE l_returnflag <> 'A')
    SELECT x.* FROM x ANTI JOIN o USING (l_suppkey, l_shipdate)""",
)
def dedup_insert(spark, folder):
    """Keys of returned lines are stored already; the others are inserted if absent."""
    keys = ["l_suppkey", "l_shipdate"]
    lines = roles.table(spark, folder, "lineitem")
    stored = lines.where(F.col("l_returnflag") == "A").select(*keys)
    incoming = lines.where(F.col("l_returnflag") != "A").select(*keys)
    return tables.insert_if_absent(stored, incoming, keys)


@query(
    "catalog_current",
    """SELECT p_brand AS model_type, CASE WHEN p_size <= 15 THEN 'staging' WHEN p_size <= 35 THEN 'production'
      ELSE 'archived' END AS stage, max(p_partkey) AS version, arg_max(p_name, p_partkey) AS run_id
    FROM part GROUP BY ALL""",
)
def catalog_current(spark, folder):
    """Parts as catalog events: brand is the model type, size the stage, key the version."""
    size = F.col("p_size")
    log = roles.table(spark, folder, "part").select(
        F.col("p_brand").alias("model_type"),
        F.when(size <= 15, "staging").when(size <= 35, "production").otherwise("archived").alias("stage"),
        F.col("p_partkey").alias("version"),
        F.col("p_name").alias("run_id"),
    )
    return tables.latest_by_key(log, ["model_type", "stage"], ["version"])


@query(
    "unknown_labels",
    """SELECT DISTINCT event_type AS label FROM events WHERE event_type NOT IN ('click', 'view')""",
)
def unknown_labels(spark, folder):
    base = roles.table(spark, folder, "events").select(F.col("event_type").alias("label"))
    return metrics.unknown_labels(base, "label", ["click", "view"])


@query(
    "holdout_share",
    """SELECT count(*) AS rows, true AS share_ok FROM events""",
)
def holdout_share(spark, folder):
    """A hash hold-out keeps every row and marks about a fifth of them."""
    marked = splits.holdout(roles.table(spark, folder, "events"), F.col("event_id"))
    share = F.count_if("is_holdout") / F.count("*")
    return marked.agg(F.count("*").alias("rows"), share.between(0.15, 0.25).alias("share_ok"))


@query(
    "impute_defaults",
    """SELECT c_custkey AS machine_id, coalesce(max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0.0) AS pending,
      coalesce(arg_max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END, o_orderkey), 'healthy') AS health_label
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""",
)
def impute_defaults(spark, folder):
    """Machines without a pending incident get feature 0 and label healthy."""
    from wearline.operators.assemble import impute

    pending = (
        roles.table(spark, folder, "orders")
        .where(F.col("o_orderstatus") == "P")
        .groupBy(F.col("o_custkey").alias("machine_id"))
        .agg(
            F.max("o_totalprice").alias("pending"),
            F.max_by("o_orderpriority", "o_orderkey").alias("health_label"),
        )
    )
    machines = roles.table(spark, folder, "customer").select(F.col("c_custkey").alias("machine_id"))
    return impute(machines.join(pending, "machine_id", "left"), ["pending"])


@query(
    "iso_times",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
      ELSE '.' || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS text,
      date_trunc('second', ts) AS parsed FROM events""",
)
def iso_times(spark, folder):
    """Times rendered as ISO-8601 UTC, and whole-second renderings parsed back."""
    from wearline.functions.times import iso_utc, parse_bound

    base = roles.table(spark, folder, "events")
    whole = iso_utc(F.date_trunc("second", "ts"))
    out = base.select("event_id", iso_utc(F.col("ts")).alias("text"), parse_bound(whole).alias("parsed"))
    return ntz(out, "parsed")
