"""The step from jobs to their hours: what it broadcasts, where rows become hours, and its counts by hand."""

import re
from datetime import datetime, timedelta

import pytest

from tests.test_operators import JOB
from tracelens.operators import capacity
from tracelens.plans import catalog

SF = "/root/testdata/sf0.001"
TEL = "server string, metric string, ts timestamp_ntz, value double"
T0 = datetime(2024, 1, 1, 22, 30)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def job(i, hosts):
    return (i, "u", None, None, None, None, hosts, 0, 4 * i, 1, None, 0, T0, T0, T0 + timedelta(hours=4))


@pytest.mark.parametrize("name", ["ag_linear_fit", "ag_user_telemetry", "tel_corr_hour", "tel_efficiency", "ag_app_efficiency", "ag_daily_coverage", "tel_job_hours", "jn_job_host_hour"])
def test_neither_jobs_nor_their_hours_are_broadcast(spark, name):
    keys = re.findall(r"BroadcastHashJoin \[(.*?)\]", plan(catalog.QUERIES[name](spark, SF)))
    assert {re.sub(r"#\d+L?", "", k) for k in keys} <= {"server", "subcluster, hour"}


def test_rows_become_hours_after_the_last_shuffle(spark):
    lines = plan(catalog.QUERIES["tel_job_hours"](spark, SF)).splitlines()
    first = lambda what: next(i for i, line in enumerate(lines) if what in line)
    assert first("Generate explode(hours") < first("Exchange")


def test_jobs_of_an_hour_count_once_over_hosts_and_midnight(spark):
    jobs = spark.createDataFrame([job(i, "cpu1-1,cpu1-2,gpu1-1") for i in (1, 2)], JOB)
    tel = spark.createDataFrame([(s, "cpu_total", T0 + timedelta(hours=h), v) for v, s in ((10.0, "cpu1-1"), (40.0, "cpu1-2"), (70.0, "gpu1-1")) for h in (0, 2, 9)], TEL)
    got = sorted((r["subcluster"], r["hour"].day, r["hour"].hour, r["jobs"], r["cpu"]) for r in capacity.hourly(jobs, tel).collect())
    assert got == [("CPU1", 1, 22, 2, 25.0), ("CPU1", 2, 0, 2, 25.0), ("GPU1", 1, 22, 2, 70.0), ("GPU1", 2, 0, 2, 70.0)]
    assert [(r["jobs"], r["cpu"], r["cpus_asked"]) for r in capacity.by_user(jobs, tel).collect()] == [(2, 40.0, 6.0)]
    assert sorted((r["hour_of_day"], r["use"], r["asked"]) for r in capacity.efficiency(jobs, tel).collect()) == [(0, 0.4, 6.0), (22, 0.4, 6.0)]


def test_hosts_count_only_with_readings_or_unknown(spark):
    jobs = spark.createDataFrame([job(1, "cpu1-1,cpu1-2"), job(2, "cpu1-1,new-1"), job(3, "cpu1-2")], JOB)
    tel = spark.createDataFrame([("cpu1-1", "cpu_total", T0, 10.0), ("cpu1-2", "cpu_total", T0 + timedelta(hours=9), 1.0)], TEL)
    got = sorted((r["job_id"], r["server"], r["hour"].hour, r["servers"], r["spread"], r["all_null"]) for r in capacity.labelled_hours(jobs, tel).collect())
    assert got == [(1, "cpu1-1", 22, 1, "single", False), (2, "cpu1-1", 22, 2, "multi", False), *[(2, "new-1", h, 2, "multi", True) for h in (0, 1, 2, 22, 23)]]
