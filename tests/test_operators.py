"""Exact helpers against their plain forms, and hand-made edge frames."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import cleaning, exact, inference, sampling, telemetry, traces, users

JOB = "job_id long, user_id string, job_name string, command string, queue string, cluster_name string, exec_hosts string, gpu_num long, cpu_num long, node_num long, job_status_str string, exit_status int, submit_time timestamp_ntz, start_time timestamp_ntz, end_time timestamp_ntz"


def job(i, user="u", sub=None, start=None, end=None, hosts=None, gpus=0, status="DONE"):
    t = lambda x: None if x is None else datetime.fromisoformat(x)
    return (i, user, f"j_{i}", "run", "q", "main", hosts, gpus, 1, 1, status, 0, t(sub), t(start), t(end))


def test_quantiles_equal_numpy(spark):
    draw = random.Random(1)
    rows = [(g, draw.choice([draw.randrange(50), draw.gauss(0, 1000)])) for g in "ab" for _ in range(draw.randrange(1, 300))] + [("c", 5.0), ("d", None)]
    got = exact.quantiles(spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double"), ["g"], "v", [0, 0.25, 0.5, 0.99, 1]).collect()
    for r in got:
        assert np.isclose(r["q"], np.quantile([float(v) for g, v in rows if g == r["g"] and v is not None], r["p"]))
    assert {r["g"] for r in got} == {"a", "b", "c"}


def test_prefix_sums_equal_a_window(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(i, draw.randrange(100)) for i in range(500)], "id long, v long")
    got = exact.prefix_sums(df, F.floor(F.col("v") / 7), [F.col("v"), F.col("id")], {"run": F.col("v")})
    want = df.withColumn("run", F.sum("v").over(Window.partitionBy(F.lit(1)).orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(got.collect()) == sorted(want.collect())


def test_quotas_are_exact_with_one_heavy_user(spark):
    rows = [job(i, "heavy" if i % 3 == 0 else f"u{i % 50}") for i in range(3000)] + [job(9999, "once"), job(9998, None)]
    got = sampling.stratified(spark.createDataFrame(rows, JOB), "user_id", 0.05).groupBy("user_id").count().collect()
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + 1
    assert {r["user_id"]: r["count"] for r in got} == {u: max(1, int(n * 0.05)) for u, n in sizes.items()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, None), ("", []), ("cpu1-1", ["cpu1-1"]), ("cpu1-[7-9]", ["cpu1-7", "cpu1-8", "cpu1-9"]), ("cpu1-[13,15]", ["cpu1-13", "cpu1-15"]), ("cpu1-[15,96-97]", ["cpu1-15", "cpu1-96", "cpu1-97"]),
        ("cpu1-1+cpu1-[2,3]", ["cpu1-1", "cpu1-2", "cpu1-3"]), ("cpu1-[1-2],cpu2-3", ["cpu1-1", "cpu1-2", "cpu2-3"]), ("cpu1-1 cpu1-1", ["cpu1-1"]), ("GPU1-1", ["gpu1-1"]), ('{"nodes":["cpu3-1","bigmem-1"]}', ["cpu3-1", "bigmem-1"]), ("cpu1-[9-7]", ["cpu1-9-7"]),
    ],
)
def test_hosts(spark, text, want):
    assert spark.createDataFrame([(text,)], "h string").select(C.hosts("h")).first()[0] == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("node[001-003]", ["node001", "node002", "node003"]), ("node[098-100]", ["node098", "node099", "node100"]), ("p[8-11]", ["p8", "p9", "p10", "p11"]), ("cpu1-103-104", ["cpu1-103", "cpu1-104"]), ("cpu1-9-7", ["cpu1-9-7"]),
        ("p[1-3", ["p1", "p2", "p3"]), ("p[1,3-4", ["p1", "p3", "p4"]), ("p[1-2+q-[3,4]", ["p1", "p2", "q-3", "q-4"]), ("p[1-2,q-7", ["p1", "p2", "q-7"]), ("p[1, 3-4]", ["p1", "p3", "p4"]), ("p[x]", ["px"]), ("p[99999999999999999999-1]", ["p99999999999999999999-1"]),
    ],
)
def test_host_ranges(spark, text, want):
    assert spark.createDataFrame([(text,)], "h string").select(C.hosts("h")).first()[0] == want


def test_long_job_keeps_all_its_hours(spark):
    jobs = spark.createDataFrame([job(1, sub="2022-01-01", start="2022-01-01", end="2024-01-01", hosts="new-1"), job(2, start="2024-01-01T05:30:00", end="2024-01-01T07:00:00", hosts="cpu1-1"), job(3, start="2024-01-01", end="2024-01-01", hosts="cpu1-1")], JOB)
    tel = spark.createDataFrame([("cpu1-1", "cpu_total", datetime(2024, 1, 1, 6, 10), 5.0)], "server string, metric string, ts timestamp_ntz, value double")
    got = telemetry.job_hours(jobs, tel)
    assert got.where("job_id = 1").count() == 730 * 24 and got.where("job_id = 1 and not all_null").count() == 0
    assert [r["hour"].hour for r in got.where("job_id = 2").collect()] == [6] and got.where("job_id = 3").count() == 0


def test_next_reading_is_carried_over_empty_days(spark):
    jobs = spark.createDataFrame([job(i, start=s, end=s, hosts="cpu1-1") for i, s in enumerate(["2024-01-01T00:00:00", "2024-01-01T10:00:00", "2024-01-01T10:00:01", "2024-01-03T00:00:00", "2024-01-09T01:00:00"])], JOB)
    tel = spark.createDataFrame([("cpu1-1", "cpu_total", datetime(2024, 1, d, 10), float(d)) for d in (1, 6)], "server string, metric string, ts timestamp_ntz, value double")
    assert {r["job_id"]: r["value"] for r in telemetry.next_readings(jobs, tel).collect()} == {0: 1.0, 1: 1.0, 2: 6.0, 3: 6.0}


def test_concurrency_equals_counting(spark):
    draw = random.Random(3)
    rows = []
    for i in range(200):
        a = draw.randrange(100 * 3600)
        b = a + draw.choice([1, 60, 3600, draw.randrange(1, 90000)])
        at = lambda s: datetime.fromtimestamp(1704067200 + s, tz=None).isoformat()
        rows.append(job(i, sub=at(a), start=at(a), end=at(b), gpus=i % 3))
    log = traces.log(spark.createDataFrame(rows, JOB))
    whole = log.collect()
    for r in traces.concurrency(log).collect():
        running = [x for x in whole if x["start_time"] <= r["hour"] <= x["end_time"]]
        assert (r["jobs"], r["gpu_jobs"], r["gpus"]) == (len(running), sum(x["gpu_num"] > 0 for x in running), sum(x["gpu_num"] for x in running))


def test_islands_split_only_above_the_gap(spark):
    at = [datetime(2024, 1, 1, 0), datetime(2024, 1, 1, 12), datetime(2024, 1, 2, 0, 0, 1), datetime(2024, 1, 2, 5)]
    tel = spark.createDataFrame([("s", "m", t, 99.0) for t in at], "server string, metric string, ts timestamp_ntz, value double")
    assert sorted((r["first"].day, r["n"]) for r in telemetry.islands(tel).collect()) == [(1, 2), (2, 2)]


def test_states_and_bins(spark):
    rows = [("DONE", 1), ("EXIT", 0), ("PEND", 0), (None, 0), (None, 3), (None, 130), ("odd", 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, e int").select(C.state("s", "e")).collect()]
    assert got == ["COMPLETED", "FAILED", "CANCELLED", "COMPLETED", "FAILED", "CANCELLED", "FAILED"]
    bins = [r[0] for r in spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.5, 4.0, -1.0, 99.0, float("inf"))], "v double").select(C.right_closed(F.col("v"), [0, 1, 4], ["a", "b"])).collect()]
    assert bins == [None, "a", "b", "b", None, None, None]


def test_empty_log(spark):
    log = traces.log(spark.createDataFrame([], JOB))
    for f in (traces.sequence, traces.concurrency, users.pareto, users.ecdf, users.per_user):
        assert f(log).collect() == []


def test_repair_uses_the_users_mean_interval(spark):
    rows = [job(i, "a", sub=f"2024-01-01T{i:02d}:00:00") for i in range(12)] + [job(50, "a"), job(51, "b", start="2024-01-05T00:00:00"), job(52, None)]
    got = {r["job_id"]: (r["submit_time"], r["how"]) for r in cleaning.repair(spark.createDataFrame(rows, JOB)).collect()}
    assert got[50] == (datetime(2024, 1, 1, 12), "user") and got[51] == (datetime(2024, 1, 4, 23, 55), "start") and got[52] == (None, "none")


def test_density_clusters_by_hand(spark):
    rows = [job(i, None, sub=f"2024-01-0{1 + i % 7}T{i % 24:02d}:00:00", gpus=i % 3) for i in range(40)] + [job(100 + i, None, sub="2024-01-01T03:00:00") for i in range(3)] + [job(999, None, sub="2024-01-01T23:00:00", gpus=50), job(5000, "known")]
    got = {r["job_id"]: r["cluster"] for r in inference.clusters(spark.createDataFrame(rows, JOB)).collect()}
    assert got[100] == got[101] == got[102] is not None and got[999] is None and 5000 not in got
    assert inference.clusters(spark.createDataFrame([], JOB)).collect() == []


def test_clusters_keep_commands_and_names_apart(spark):
    same = job(0, None, sub="2024-01-01T03:00:00")
    kinds = [("python train.py", "a_1"), ("python serve.py", "a_2"), ("python train.py", "b_3"), (None, None)]
    rows = [(10 * k + i, None, name, command, *same[4:]) for k, (command, name) in enumerate(kinds) for i in range(3)]
    got = {r["job_id"]: r["cluster"] for r in inference.clusters(spark.createDataFrame(rows, JOB)).collect()}
    assert got == {10 * k + i: 10 * k for k in range(4) for i in range(3)}
