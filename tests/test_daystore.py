import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wearline.operators import rollups
from wearline.sources.daystore import Conflict, DayStore
from wearline.streaming import jobs

DAY_S = 86_400
SCHEMA = "machine_id string, recorded_at timestamp, value double"


def batch(spark, seed, days, n=40, empty_time=False):
    draw = random.Random(seed)
    rows = [(draw.choice("AB"), at(draw.choice(days) * DAY_S + draw.randrange(DAY_S)), draw.random()) for _ in range(n)]
    return spark.createDataFrame(rows + ([("A", None, 1.0)] if empty_time else []), SCHEMA)


def hourly(df):
    return rollups.bucket_rollup(df, "1 hour", {"value": F.col("value")}, extremes=["value"])


def rows(df):
    plain = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()]
    return sorted(plain, key=str)


def test_refresh_equals_full_rollup_and_touches_dirty_days_only(spark, tmp_path):
    base, rolled = DayStore(spark, str(tmp_path / "base")), DayStore(spark, str(tmp_path / "hourly"))
    folder, whole, before = str(tmp_path / "in"), None, {}
    # late rows reach back to a day that was rolled up long before
    for i, days in enumerate([[0, 1], [1, 2], [3], [0, 3]]):
        part = batch(spark, i, days)
        jobs.write_batch(part, folder, i)
        whole = part if whole is None else whole.unionByName(part)
        touched = base.absorb(folder, "recorded_at")
        assert touched == [f"2024-01-0{d + 1}" for d in days]
        assert rolled.follow(base, hourly, "bucket") == touched
        assert rows(base.read()) == rows(whole)
        assert rows(rolled.read()) == rows(hourly(whole))
        now = rolled.manifest()["days"]
        assert {d for d in now if before.get(d) != now[d]} == set(touched)
        before = now
    assert base.absorb(folder, "recorded_at") == [] and rolled.follow(base, hourly, "bucket") == []
    # one folder per day is open, whatever the number of batches
    opened = {f.rsplit("/", 1)[0] for f in rolled.read().inputFiles()}
    assert len(opened) == 4
    jobs.write_batch(batch(spark, 9, [0]), folder, 1)  # a replay after it was absorbed
    assert base.absorb(folder, "recorded_at") == []


def test_of_two_writers_one_wins(spark, tmp_path):
    store = DayStore(spark, str(tmp_path / "t"))
    first = store.manifest()
    store.commit(store.rewritten(first, batch(spark, 1, [0]), "recorded_at", []))
    with pytest.raises(Conflict):
        store.commit(store.rewritten(first, batch(spark, 2, [0]), "recorded_at", []))
    assert store.versions() == [1] and rows(store.read()) == rows(batch(spark, 1, [0]))


def test_readers_of_a_version_and_vacuum(spark, tmp_path):
    store, folder = DayStore(spark, str(tmp_path / "t")), str(tmp_path / "in")
    for i in range(4):
        jobs.write_batch(batch(spark, i, [i % 2], empty_time=i == 3), folder, i)
        store.absorb(folder, "recorded_at")
    assert store.read(version=2).count() == 80 and store.read().count() == 161
    assert store.read().where("recorded_at IS NULL").count() == 1
    assert store.vacuum(keep=1) > 0 and store.versions() == [4]
    assert store.read().count() == 161
    assert store.between(at(0).date(), at(0).date()).count() == 80


def test_a_day_that_empties_leaves(spark, tmp_path):
    base, rolled = DayStore(spark, str(tmp_path / "b")), DayStore(spark, str(tmp_path / "r"))
    base.commit(base.rewritten(base.manifest(), batch(spark, 1, [0, 1]), "recorded_at", []))
    rolled.follow(base, hourly, "bucket")
    manifest = base.manifest()
    del manifest["days"]["2024-01-01"]
    base.commit(manifest)
    assert rolled.follow(base, hourly, "bucket") == ["2024-01-01"]
    assert list(rolled.manifest()["days"]) == ["2024-01-02"]
    with pytest.raises(ValueError):
        DayStore(spark, str(tmp_path / "none")).read()
