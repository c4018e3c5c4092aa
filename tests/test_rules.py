import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wearline.operators import chains, incidents, rules
from wearline.schemas import RULE

PRED = (
    "machine_id string, predicted_at timestamp, seq long, rul_cycles double, "
    "health_label string, anomaly_score double"
)
ORDER = ["predicted_at", "seq"]


def predictions(spark, *rows):
    return spark.createDataFrame([("M1", at(t), i, rul, label, score) for i, (t, rul, label, score) in enumerate(rows)], PRED)


def fired(spark, df, table=None, limit=rules.INLINE_LIMIT):
    table = rules.default_rules(spark) if table is None else table
    out = rules.rule_hits(rules.with_context(df, ORDER), table, limit)
    return sorted((r["seq"], r["rule_id"]) for r in out.collect())


@pytest.mark.parametrize("limit", [rules.INLINE_LIMIT, 0])
def test_conditions(spark, limit):
    def names(*rows):
        return {n for _, n in fired(spark, predictions(spark, *rows), limit=limit)}

    assert "rul_critical" in names((0, 5.0, "healthy", 0.0))
    warn = names((0, 20.0, "healthy", 0.0))
    assert "rul_warning" in warn and "rul_critical" not in warn
    assert "anomaly_critical" in names((0, 200.0, "healthy", 0.95))
    assert "anomaly_critical" not in names((0, 200.0, "healthy", 0.85))
    assert "rapid_degradation" in names((0, 90.0, "healthy", 0.0), (10, 80.0, "healthy", 0.0))
    assert "rapid_degradation" not in names((0, 80.0, "healthy", 0.0))
    assert "multi_sensor_anomaly" in names((0, 200.0, "healthy", 0.7))
    assert "health_imminent" in names((0, 200.0, "imminent_failure", 0.0))
    assert names((0, 200.0, "healthy", 0.05)) == set()


@pytest.mark.parametrize("limit", [rules.INLINE_LIMIT, 0])
def test_disabled_and_broken_rules(spark, limit):
    rows = [
        ("off", "Off", "", "critical", "rul_below", {"threshold": "1000"}, 60, False),
        ("bad", "Bad", "", "critical", "rul_below", {"threshold": "ten"}, 60, True),
        ("gone", "Gone", "", "critical", "rul_below", {}, 60, True),
        ("own", "Own", "", "info", "rul_below", {"threshold": "1000"}, 60, True),
    ]
    table = spark.createDataFrame(rows, RULE)
    assert fired(spark, predictions(spark, (0, 5.0, "healthy", 0.0)), table, limit) == [(0, "own")]


def test_no_rules_at_all(spark):
    table = rules.default_rules(spark).where("false")
    assert fired(spark, predictions(spark, (0, 5.0, "healthy", 0.0)), table) == []


def test_rule_listing(spark):
    table = rules.default_rules(spark)
    first = rules.sorted_rules(table).first()
    assert (first["severity"], first["rule_id"]) == ("critical", "anomaly_critical")
    assert rules.rule_by_id(table, "rul_info").first()["cooldown_s"] == 14400
    assert table.count() == 9


def test_cooldown_suppresses_then_allows(spark):
    df = predictions(spark, *[(t, 20.0, "healthy", 0.0) for t in (0, 7199, 7200)])
    table = rules.default_rules(spark).where("rule_id = 'rul_warning'")
    hits = rules.rule_hits(rules.with_context(df, ORDER), table)
    kept = rules.apply_cooldown(hits, ORDER).select("seq").collect()
    assert sorted(r[0] for r in kept) == [0, 2]


def greedy(times, hold, closed):
    opened, out = None, []
    for t in times:
        held = opened is not None and (t - opened <= hold if closed else t - opened < hold)
        if not held:
            opened = t
        out.append((not held, opened))
    return out


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("length", [None, 40_000_000, 7_000_000])
def test_chain_matches_plain_loop(spark, closed, length):
    """Ties, hold-length gaps, holds longer than a slice, and one hot key."""
    rng = random.Random(11)
    rows, want = [], {}
    for key, n, hold in (("hot", 400, 9), ("cold", 20, 9), ("long", 60, 70)):
        times = sorted(rng.randrange(0, 300) for _ in range(n))
        for i, (t, mark) in enumerate(zip(times, greedy(times, hold, closed))):
            rows.append((key, at(t), i, hold))
            want[(key, i)] = (mark[0], at(mark[1]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t timestamp, seq long, hold int")
    out = chains.mark_openers(df, ["k"], "t", ["seq"], "hold", closed=closed, slice_length=length)
    micros = F.unix_micros("opened_at").alias("us")
    got = {(r["k"], r["seq"]): (r["is_opener"], r["us"]) for r in out.select("*", micros).collect()}
    assert got == {k: (f, round(o.timestamp() * 1_000_000)) for k, (f, o) in want.items()}


INC = "machine_id string, rule_id string, severity string, title string, triggered_at timestamp, incident_id long"


def incident(i, severity, t=0, rule="r", machine="M"):
    return (machine, rule, severity, f"{severity}-{i}", at(t), i)


def grouped(spark, *rows, window=300):
    return incidents.aggregate_incidents(spark.createDataFrame(list(rows), INC), window).collect()


def test_aggregation_keeps_the_most_severe(spark):
    assert len(grouped(spark, *[incident(i, "info", i) for i in range(5)])) == 1
    (up,) = grouped(spark, incident(0, "info", 0), incident(1, "critical", 1))
    assert up["severity"] == "critical"
    (down,) = grouped(spark, incident(0, "critical", 0), incident(1, "info", 1))
    assert down["severity"] == "critical"
    (tie,) = grouped(spark, incident(0, "info", 0), incident(1, "info", 1))
    assert tie["title"] == "info-1"
    assert grouped(spark, *[incident(i, "info", t) for i, t in enumerate((0, 300, 301))]).__len__() == 2


def test_flush_order_and_notification(spark):
    rows = [incident(i, s, i, rule=f"r{i}") for i, s in enumerate(("info", "critical", "warning"))]
    rows.append(incident(9, "info", 5, machine="quiet"))
    rows.append(incident(10, "critical", 5, machine="down"))
    groups = incidents.flush_groups(incidents.aggregate_incidents(spark.createDataFrame(rows, INC)))
    order = {r["machine_id"]: [i["severity"] for i in r["incidents"]] for r in groups.collect()}
    assert order["M"] == ["critical", "warning", "info"]
    switches = spark.createDataFrame(
        [("down", True, at(0)), ("M", True, at(0)), ("M", False, at(1))],
        "machine_id string, enabled boolean, changed_at timestamp",
    )
    out = incidents.notifications(groups, incidents.maintenance_state(switches), (22, 6)).collect()
    # The base time is midnight: quiet hours silence the informational group.
    assert [(r["machine_id"], r["severity"], r["incident_count"]) for r in out] == [("M", "critical", 3)]
    assert '"machine_id":"M"' in out[0]["payload"]


def test_empty_input(spark):
    empty = spark.createDataFrame([], INC)
    assert incidents.flush_groups(incidents.aggregate_incidents(empty)).count() == 0


def test_incident_rows(spark):
    df = predictions(spark, (0, 5.0, "healthy", 0.0))
    hits = rules.rule_hits(rules.with_context(df, ORDER), rules.default_rules(spark))
    made = incidents.build_incidents(hits.where("rule_id = 'rul_critical'")).collect()
    assert made[0]["title"] == "[CRITICAL] M1: RUL Critical" and made[0]["status"] == "open"
    assert '"rul_cycles":5.0' in made[0]["details"]
    again = incidents.build_incidents(hits.where("rule_id = 'rul_critical'")).first()
    assert again["incident_id"] == made[0]["incident_id"]


def test_life_cycle(spark):
    log = [
        ("a", "open", 0), ("a", "acknowledge", 1), ("a", "close", 2), ("a", "acknowledge", 3), ("a", "close", 4),
        ("b", "close", 0), ("b", "open", 1), ("b", "acknowledge", 2),
        ("c", "open", 0), ("c", "close", 1), ("c", "acknowledge", 2),
        ("d", "acknowledge", 1),
    ]
    df = spark.createDataFrame(
        [(i, a, at(t), n, f"u{n}", f"n{n}") for n, (i, a, t) in enumerate(log)],
        "incident_id string, action string, event_at timestamp, event_no long, actor string, note string",
    )
    got = {
        r["incident_id"]: (r["status"], r["acknowledged_by"], r["resolution_note"])
        for r in incidents.current_incidents(df).collect()
    }
    assert got == {"a": ("closed", "u1", "n2"), "b": ("acknowledged", "u7", None), "c": ("closed", None, "n9")}
