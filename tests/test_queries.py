"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, bag
from wearline.plans import suite

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
OWN = sorted(set(ORACLES) & set(suite.QUERIES))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(df.collect(), df.columns) == bag(result.fetchall(), names)


def test_registry():
    assert set(ORACLES) <= set(contract.queries())
    assert set(suite.QUERIES) - set(ORACLES) == {
        "rf_health",
        "rf_health_metrics",
        "feature_importance",
        "gbt_rul",
        "rul_intervals",
        "batch_scoring",
        "walk_forward_scores",
    }


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[:4] == ["machine_id", "sensor", "recorded_at", "window_s"] and df.count() > 0
