"""Every registered job and telemetry query against its SQL, and its plan against the rules."""

import datetime
import re

import duckdb
import pytest

import __spark_entry__
from tracelens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "events", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql_and_plan_is_sound(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plan = df._jdf.queryExecution().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "LocalCheckpoint"):
        assert not re.search(bad, plan), bad
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())


def test_entry_and_registration(spark):
    assert __spark_entry__.entry(spark).columns == ["hour", "jobs", "gpus", "cpus", "mean_duration"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
