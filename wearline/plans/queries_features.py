"""Queries over rolling, spectral, correlation and quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.functions.spectral import with_spectral
from wearline.operators import assemble, correlation, quality, rolling, rollups
from wearline.plans import roles
from wearline.plans.catalog import E_LONG, L_WIDE, longs, ntz, query, r, rounded
from wearline.plans.roles import DAY_S, EVENT_ORDER, LINE_ORDER, SENSORS, WINDOWS_S

_RANGE = (
    "PARTITION BY machine_id, sensor ORDER BY recorded_at "
    "RANGE BETWEEN INTERVAL {w} SECOND PRECEDING AND CURRENT ROW"
)


def _per_window(select: str, extra: str = "", windows=WINDOWS_S) -> str:
    parts = [
        f"SELECT machine_id, sensor, recorded_at, {w} AS window_s, CAST(n AS BIGINT) AS n, {select} "
        f"FROM (SELECT *, count(*) OVER w AS n{extra} FROM e WINDOW w AS ({_RANGE.format(w=w)})) "
        "WHERE n >= 2"
        for w in windows
    ]
    return f"WITH {E_LONG} " + " UNION ALL ".join(parts)


def _rolled(spark, folder, stats):
    base = roles.events_long(spark, folder)
    out = rolling.rolling_stats(base, WINDOWS_S, order=EVENT_ORDER, stats=stats)
    out = out.select("machine_id", "sensor", "recorded_at", "window_s", "n", *stats)
    return longs(rounded(out, stats), "n")


@query(
    "rolling_stats",
    _per_window(
        "round(a, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS std, round(lo, 6) + 0.0 AS min, "
        "round(hi, 6) + 0.0 AS max, round(sqrt(q), 6) + 0.0 AS rms, round(hi - lo, 6) + 0.0 AS range",
        ", avg(value) OVER w AS a, stddev_pop(value) OVER w AS s, min(value) OVER w AS lo, "
        "max(value) OVER w AS hi, avg(value * value) OVER w AS q",
    ),
)
def rolling_stats(spark, folder):
    return _rolled(spark, folder, ["mean", "std", "min", "max", "rms", "range"])


@query(
    "rolling_median",
    _per_window("round(m, 6) + 0.0 AS median", ", median(value) OVER w AS m"),
)
def rolling_median(spark, folder):
    return _rolled(spark, folder, ["median"])


@query(
    "rolling_rate_of_change",
    _per_window(
        "round(list_avg([abs(vs[i] - vs[i - 1]) for i in generate_series(2, len(vs))]), 6) + 0.0 "
        "AS rate_of_change",
        ", list(value) OVER w AS vs",
    ),
)
def rolling_rate_of_change(spark, folder):
    return _rolled(spark, folder, ["rate_of_change"])


_WEEK = 7 * DAY_S
_CAP_RATE = 5.5 / (2 * _WEEK)  # five samples per window


@query(
    "rolling_row_cap",
    f"""WITH {E_LONG}, f AS (SELECT *, list(value) OVER w AS vs FROM e
      WINDOW w AS ({_RANGE.format(w=_WEEK)})),
    g AS (SELECT *, vs[-5:] AS kept FROM f)
    SELECT machine_id, sensor, recorded_at, CAST(len(kept) AS BIGINT) AS n,
      round(list_avg(kept), 6) + 0.0 AS mean, round(list_max(kept), 6) + 0.0 AS max FROM g""",
)
def rolling_row_cap(spark, folder):
    out = rolling.rolling_capped(
        roles.events_long(spark, folder), _WEEK, _CAP_RATE, order=EVENT_ORDER
    )
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x)
    return out.select(
        "machine_id",
        "sensor",
        "recorded_at",
        F.size("samples").cast("long").alias("n"),
        r(total / F.size("samples")).alias("mean"),
        r(F.array_max("samples")).alias("max"),
    )


@query(
    "window_samples",
    f"""WITH {E_LONG}, f AS (SELECT *, list(value) OVER w AS vs FROM e
      WINDOW w AS ({_RANGE.format(w=_WEEK)}))
    SELECT machine_id, sensor, recorded_at, CAST(len(vs) AS BIGINT) AS n,
      round(vs[1], 6) + 0.0 AS oldest, round(vs[-1], 6) + 0.0 AS newest,
      round(list_sum([vs[i] * i for i in generate_series(1, len(vs))]), 4) + 0.0 AS weighted
    FROM f WHERE len(vs) >= 2""",
)
def window_samples(spark, folder):
    out = rolling.window_samples(roles.events_long(spark, folder), _WEEK, order=EVENT_ORDER)
    terms = F.transform("samples", lambda v, i: v * (i + 1))
    return out.select(
        "machine_id",
        "sensor",
        "recorded_at",
        F.size("samples").cast("long").alias("n"),
        r(F.col("samples")[0]).alias("oldest"),
        r(F.element_at("samples", -1)).alias("newest"),
        r(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x), 4).alias("weighted"),
    )


@query(
    "cumulative_stats",
    f"""WITH {E_LONG} SELECT machine_id, sensor, recorded_at,
      round(avg(value) OVER w, 6) + 0.0 AS cumulative_mean,
      round(max(value) OVER w, 6) + 0.0 AS cumulative_max
    FROM e WINDOW w AS (PARTITION BY machine_id, sensor ORDER BY recorded_at, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def cumulative_stats(spark, folder):
    out = rolling.cumulative_stats(roles.events_long(spark, folder), order=EVENT_ORDER)
    names = ["cumulative_mean", "cumulative_max"]
    return rounded(out.select("machine_id", "sensor", "recorded_at", *names), names)


@query(
    "segment_reset",
    f"""WITH {E_LONG}, s AS (SELECT *, CAST(sum(CASE WHEN sensor = 'error' THEN 1 ELSE 0 END) OVER
      (PARTITION BY machine_id ORDER BY recorded_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING
       AND CURRENT ROW) AS BIGINT) AS segment_id FROM e)
    SELECT machine_id, sensor, recorded_at, segment_id,
      round(avg(value) OVER w, 6) + 0.0 AS cumulative_mean,
      round(max(value) OVER w, 6) + 0.0 AS cumulative_max
    FROM s WINDOW w AS (PARTITION BY machine_id, sensor, segment_id
      ORDER BY recorded_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def segment_reset(spark, folder):
    cut = rolling.with_segment(
        roles.events_long(spark, folder), F.col("sensor") == "error", order=EVENT_ORDER
    )
    out = rolling.cumulative_stats(
        cut, keys=["machine_id", "sensor", "segment_id"], order=EVENT_ORDER, store=True
    )
    names = ["cumulative_mean", "cumulative_max"]
    return rounded(out.select("machine_id", "sensor", "recorded_at", "segment_id", *names), names)


@query(
    "feature_map",
    f"""WITH {E_LONG}, f AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS a,
      max(value) OVER w AS hi FROM e WINDOW w AS ({_RANGE.format(w=DAY_S)}))
    SELECT machine_id, recorded_at, sensor || '_{DAY_S}s_mean' AS name,
      round(a, 6) + 0.0 AS feature FROM f WHERE n >= 2
    UNION ALL SELECT machine_id, recorded_at, sensor || '_{DAY_S}s_max',
      round(hi, 6) + 0.0 FROM f WHERE n >= 2""",
)
def feature_map(spark, folder):
    stats = ["mean", "max"]
    rolled = rolling.rolling_stats(
        roles.events_long(spark, folder), [DAY_S], order=EVENT_ORDER, stats=stats
    )
    named = rolling.named_features(rolled, stats)
    maps = rolling.feature_map(named, ["machine_id", "recorded_at", "window_s"])
    merged = maps.select(
        "machine_id", "recorded_at", F.explode(assemble.merge_maps(["temporal"])).alias("name", "feature")
    )
    return rounded(merged, ["feature"])


def _bucket_sql(size: str) -> str:
    return f"""SELECT date_trunc('{size}', ts) AS bucket, CAST(user_id AS VARCHAR) AS machine_id,
      round(avg(CASE WHEN event_type = 'click' THEN value END), 6) + 0.0 AS avg_click,
      round(avg(CASE WHEN event_type = 'view' THEN value END), 6) + 0.0 AS avg_view,
      round(avg(CASE WHEN event_type = 'error' THEN value END), 6) + 0.0 AS avg_error,
      round(min(CASE WHEN event_type = 'view' THEN value END), 6) + 0.0 AS min_view,
      round(max(CASE WHEN event_type = 'view' THEN value END), 6) + 0.0 AS max_view,
      count(*) AS reading_count
    FROM events GROUP BY ALL"""


def _buckets(spark, folder, size):
    values = {
        s: F.when(F.col("sensor") == s, F.col("value")) for s in ("click", "view", "error")
    }
    out = rollups.bucket_rollup(roles.events_long(spark, folder), size, values, extremes=["view"])
    out = ntz(out, "bucket")
    return rounded(out, [c for c in out.columns if c[:4] in ("avg_", "min_", "max_")])


@query("bucket_1m", _bucket_sql("minute"))
def bucket_1m(spark, folder):
    return _buckets(spark, folder, "1 minute")


@query("bucket_1h", _bucket_sql("hour"))
def bucket_1h(spark, folder):
    return _buckets(spark, folder, "1 hour")


@query("bucket_1d", _bucket_sql("day"))
def bucket_1d(spark, folder):
    return _buckets(spark, folder, "1 day")


_RATE_HZ = 100.0
_SPECTRAL_SQL = f"""
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT vec_id, v, list_avg(v) AS mean, len(v) AS n FROM x),
j AS (SELECT vec_id, n, unnest(generate_series(0, n - 1)) AS j, unnest(v) - mean AS xj FROM m),
k AS (SELECT vec_id, n, j.j, xj, k FROM j, unnest(generate_series(0, n // 2)) AS t(k)),
s AS (SELECT vec_id, k, max(n) AS n, sum(xj * cos(2 * pi() * k * j / n)) AS re,
        sum(xj * sin(2 * pi() * k * j / n)) AS im FROM k GROUP BY vec_id, k),
p AS (SELECT vec_id, k, n, re * re + im * im AS pw, k * {_RATE_HZ}::DOUBLE / n AS hz FROM s),
t AS (SELECT *, sum(pw) OVER (PARTITION BY vec_id) AS total FROM p),
g AS (SELECT *, {_RATE_HZ}::DOUBLE / 2 AS nyq, ln(sqrt(pw) + 1e-12::DOUBLE) AS lm,
        CASE WHEN k = 0 OR 2 * k = n THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM t),
a AS (SELECT vec_id, arg_max(hz, pw) AS dominant_freq_hz, sum(pw) AS spectral_energy,
        -sum(pw / total * ln(pw / total + 1e-12::DOUBLE)) AS spectral_entropy,
        sum(CASE WHEN hz < 0.1::DOUBLE * nyq THEN pw ELSE 0 END) AS band_low_energy,
        sum(CASE WHEN hz >= 0.1::DOUBLE * nyq AND hz < 0.3::DOUBLE * nyq THEN pw ELSE 0 END) AS band_mid_energy,
        sum(CASE WHEN hz >= 0.3::DOUBLE * nyq AND hz < 0.5::DOUBLE * nyq THEN pw ELSE 0 END) AS band_high_energy,
        sum(w * lm * cos(0.0::DOUBLE)) / max(n) AS c0, sum(w * lm * cos(2 * pi() * k / n)) / max(n) AS c1,
        sum(w * lm * cos(4 * pi() * k / n)) / max(n) AS c2, sum(w * lm * cos(6 * pi() * k / n)) / max(n) AS c3,
        sum(w * lm * cos(8 * pi() * k / n)) / max(n) AS c4
      FROM g GROUP BY vec_id)
SELECT vec_id, round(dominant_freq_hz, 6) + 0.0 AS dominant_freq_hz,
  round(spectral_energy, 6) + 0.0 AS spectral_energy, round(spectral_entropy, 4) + 0.0 AS spectral_entropy,
  round(band_low_energy, 6) + 0.0 AS band_low_energy, round(band_mid_energy, 6) + 0.0 AS band_mid_energy,
  round(band_high_energy, 6) + 0.0 AS band_high_energy,
  round(c1 - c0, 4) + 0.0 AS cepstral_step_1, round(c2 - c1, 4) + 0.0 AS cepstral_step_2,
  round(c3 - c2, 4) + 0.0 AS cepstral_step_3, round(c4 - c3, 4) + 0.0 AS cepstral_step_4
FROM a"""


@query("spectral_features", _SPECTRAL_SQL)
def spectral_features(spark, folder):
    """Coefficient steps instead of coefficients: the constant bin is rounding noise
    after mean removal, shifts all coefficients alike, and cancels in the steps."""
    out = with_spectral(roles.signals(spark, folder), _RATE_HZ)
    plain = ["dominant_freq_hz", "spectral_energy", "band_low_energy", "band_mid_energy", "band_high_energy"]
    steps = [
        r(F.col(f"cepstral_{i}") - F.col(f"cepstral_{i - 1}"), 4).alias(f"cepstral_step_{i}")
        for i in range(1, 5)
    ]
    return out.select(
        "vec_id", *[r(c).alias(c) for c in plain], r("spectral_entropy", 4).alias("spectral_entropy"), *steps
    )


_QUARTER = 90 * DAY_S


def _pair_sql() -> str:
    cols = []
    for a, b in correlation.sensor_pairs(SENSORS):
        cols.append(
            f"CASE WHEN count(*) OVER w >= 10 AND stddev_pop({a}) OVER w >= 1e-12 AND "
            f"stddev_pop({b}) OVER w >= 1e-12 THEN round(covar_pop({a}, {b}) OVER w / "
            f"(stddev_pop({a}) OVER w * stddev_pop({b}) OVER w), 6) + 0.0 END AS {a}_x_{b}_pearson"
        )
    return (
        f"WITH {L_WIDE} SELECT machine_id, recorded_at, l_orderkey, l_linenumber, l_partkey, "
        + ", ".join(cols)
        + f" FROM l WINDOW w AS (PARTITION BY machine_id ORDER BY recorded_at RANGE BETWEEN "
        f"INTERVAL {_QUARTER} SECOND PRECEDING AND CURRENT ROW)"
    )


@query("pair_correlation", _pair_sql())
def pair_correlation(spark, folder):
    out = correlation.rolling_pearson(
        roles.lines_wide(spark, folder), SENSORS, _QUARTER, aligned=True
    )
    return rounded(out.drop(*SENSORS), [c for c in out.columns if c.endswith("_pearson")])


@query(
    "sensor_pairs",
    f"""WITH {E_LONG}, d AS (SELECT machine_id, date_trunc('day', recorded_at) AS day, sensor,
      avg(value) AS v FROM e GROUP BY ALL)
    SELECT a.machine_id, a.day, a.sensor AS sensor_a, b.sensor AS sensor_b,
      round(a.v, 6) + 0.0 AS value_a, round(b.v, 6) + 0.0 AS value_b
    FROM d a JOIN d b ON a.machine_id = b.machine_id AND a.day = b.day AND a.sensor < b.sensor""",
)
def sensor_pairs(spark, folder):
    daily = (
        roles.events_long(spark, folder)
        .groupBy("machine_id", F.date_trunc("day", "recorded_at").cast("timestamp_ntz").alias("day"), "sensor")
        .agg(F.avg("value").alias("value"))
    )
    out = correlation.pair_rows(daily, ["machine_id", "day"])
    return rounded(out, ["value_a", "value_b"])


_AS_OF = "2001-06-01 00:00:00"
_LIMITS = quality.QualityLimits(min_sensor_count=4)
_READ_SQL = """
q AS (SELECT CASE WHEN l_suppkey = 0 THEN ' ' ELSE CAST(l_suppkey AS VARCHAR) END AS machine_id,
    l_shipdate AS recorded_at, l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_linenumber <> 7 THEN l_quantity END AS quantity, l_linenumber <> 7 AS has_quantity,
    l_extendedprice AS extendedprice, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax
  FROM lineitem),
c AS (SELECT *, (CASE WHEN has_quantity THEN 4 ELSE 3 END) AS size,
    (CASE WHEN discount IS NULL THEN 1 ELSE 0 END) + (CASE WHEN tax IS NULL THEN 1 ELSE 0 END) AS nulls
  FROM q),
f AS (SELECT *, trim(machine_id) = '' AS missing_id,
    recorded_at > TIMESTAMP '2001-06-01 00:00:00' + INTERVAL 300 SECOND AS future,
    nulls > 0 AND nulls::DOUBLE / size > 0.3::DOUBLE AS high,
    nulls > 0 AND nulls::DOUBLE / size <= 0.3::DOUBLE AS low FROM c),
g AS (SELECT *, missing_id OR future OR high AS rejected FROM f)"""
_LINE_KEYS = "machine_id, recorded_at, l_orderkey, l_linenumber, l_partkey"
_FILL_SQL = f"""WITH {_READ_SQL},
acc AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY recorded_at, l_orderkey,
    l_linenumber, l_partkey) AS rn FROM g WHERE NOT rejected),
long AS (SELECT {_LINE_KEYS}, rn, 'quantity' AS sensor, quantity AS v FROM acc WHERE has_quantity
  UNION ALL SELECT {_LINE_KEYS}, rn, 'extendedprice', extendedprice FROM acc
  UNION ALL SELECT {_LINE_KEYS}, rn, 'discount', discount FROM acc
  UNION ALL SELECT {_LINE_KEYS}, rn, 'tax', tax FROM acc),
isl AS (SELECT *, rn - row_number() OVER (PARTITION BY machine_id, sensor ORDER BY rn) AS island FROM long),
filled AS (SELECT *, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY machine_id, sensor, island
    ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS filled FROM isl)"""


@query(
    "forward_fill",
    _FILL_SQL + f" SELECT {_LINE_KEYS}, sensor, round(filled, 6) + 0.0 AS filled FROM filled",
)
def forward_fill(spark, folder):
    checked = _checked(spark, folder)
    good = checked.where(~F.col("rejected"))
    return rounded(good.select("machine_id", *LINE_ORDER, F.explode("filled").alias("sensor", "filled")), ["filled"])


def _checked(spark, folder):
    return quality.check_quality(
        roles.lines_readings(spark, folder),
        _LIMITS,
        as_of=F.lit(_AS_OF).cast("timestamp_ntz"),
        order=LINE_ORDER,
        sensors=SENSORS,
    )


@query(
    "quality_flags",
    _FILL_SQL
    + f""",
vals AS (SELECT machine_id, rn, list(filled) AS vs FROM filled GROUP BY ALL),
fence AS (SELECT *, list_aggregate(vs, 'quantile_cont', 0.25) AS q1,
    list_aggregate(vs, 'quantile_cont', 0.75) AS q3 FROM vals),
outl AS (SELECT machine_id, rn, len(vs) >= 4 AND (list_min(vs) < q1 - 1.5::DOUBLE * (q3 - q1)
    OR list_max(vs) > q3 + 1.5::DOUBLE * (q3 - q1)) AS outlier FROM fence),
h AS (SELECT *, last_value(CASE WHEN NOT rejected THEN recorded_at END IGNORE NULLS) OVER
    (PARTITION BY machine_id ORDER BY recorded_at, l_orderkey, l_linenumber, l_partkey
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_at FROM g),
z AS (SELECT h.*, coalesce(h.recorded_at = h.prev_at, false) AS dup, h.size < 4 AS few,
    coalesce(o.outlier, false) AS outlier
  FROM h LEFT JOIN acc a USING ({_LINE_KEYS}) LEFT JOIN outl o ON o.machine_id = a.machine_id AND o.rn = a.rn)
SELECT {_LINE_KEYS}, rejected,
  CAST(missing_id::INT + 2 * high::INT + 4 * low::INT + 8 * future::INT + 16 * dup::INT
    + 32 * outlier::INT + 64 * few::INT AS BIGINT) AS flag_bits,
  concat_ws(',', CASE WHEN missing_id THEN 'MISSING_ID' END, CASE WHEN high THEN 'NULL_FRACTION_HIGH' END,
    CASE WHEN low THEN 'NULL_FRACTION_LOW' END, CASE WHEN future THEN 'FUTURE_TIMESTAMP' END,
    CASE WHEN dup THEN 'DUPLICATE_TIMESTAMP' END, CASE WHEN outlier THEN 'OUTLIER_DETECTED' END,
    CASE WHEN few THEN 'SENSOR_COUNT_LOW' END) AS flags
FROM z""",
)
def quality_flags(spark, folder):
    return _checked(spark, folder).select(
        "machine_id",
        *LINE_ORDER,
        "rejected",
        F.col("flag_bits").cast("long").alias("flag_bits"),
        F.array_join("flag_names", ",").alias("flags"),
    )


@query(
    "flatten_features",
    f"""WITH {L_WIDE} SELECT machine_id, recorded_at, l_orderkey, l_linenumber, l_partkey,
      CASE WHEN l_linenumber <> 7 THEN quantity END AS temporal__quantity,
      extendedprice AS temporal__extendedprice, nullif(discount, 0) AS spectral__discount,
      tax AS correlation__tax FROM l""",
)
def flatten_features(spark, folder):
    wide = roles.lines_wide(spark, folder)

    def one(name, value):
        return F.struct(F.lit(name).alias("k"), value.alias("v"))

    def as_map(*entries):
        return F.map_from_entries(F.array_compact(F.array(*entries)))

    rows = wide.select(
        "machine_id",
        *LINE_ORDER,
        as_map(
            F.when(F.col("l_linenumber") != 7, one("quantity", F.col("quantity"))),
            one("extendedprice", F.col("extendedprice")),
        ).alias("temporal"),
        as_map(F.when(F.col("discount") != 0, one("discount", F.col("discount")))).alias("spectral"),
        as_map(one("tax", F.col("tax"))).alias("correlation"),
    )
    return assemble.flatten_features(rows)


@query(
    "minmax_scale",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,"""
    + ", ".join(
        f"round(CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / "
        f"(max({c}) OVER w - min({c}) OVER w) ELSE 0.0 END, 6) + 0.0 AS {c}"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
    + " FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)",
)
def minmax_scale(spark, folder):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    base = roles.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *columns
    )
    return rounded(assemble.minmax_scale(base, columns, ["l_returnflag"]), columns)


@query(
    "zscore_scale",
    """WITH b AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem
      WHERE l_shipdate < TIMESTAMP '1999-01-01')
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round((l_quantity - m) / (s + 1e-8::DOUBLE), 5) + 0.0 AS l_quantity FROM lineitem, b""",
)
def zscore_scale(spark, folder):
    """Fitted on the rows before 1999, applied to all."""
    base = roles.table(spark, folder, "lineitem")
    fitted = assemble.zscore_fit(
        base.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")), ["l_quantity"]
    )
    kept = base.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return rounded(assemble.zscore_apply(kept, fitted), ["l_quantity"], 5)
