"""Radix selection, order-independent sums, as-of and anchored groups against plain versions, with heavy keys."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelens.operators import classify, exact, telemetry
from tests.test_operators import JOB, job

START = datetime(2024, 1, 1)


def test_key_keeps_the_order_of_doubles(spark):
    values = [float("-inf"), -1e300, -2.5, -5e-324, 0.0, 5e-324, 1e-300, 0.1, 2.5, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(exact.order_key(F.col("v"), T.DoubleType()).alias("k"))
    keys = [r["k"] for r in df.collect()]
    assert keys == sorted(set(keys))
    same = spark.createDataFrame([(0.0,), (-0.0,)], "v double").select(exact.order_key(F.col("v"), T.DoubleType()).alias("k"))
    assert len({r["k"] for r in same.collect()}) == 1


@pytest.mark.parametrize("spread", [5.0, 1e-9, 1e250])
def test_quantiles_of_many_floats(spark, spread):
    """A million different values within one width of the old buckets, of one sign and of both."""
    n, probs = 1_000_000, [0.0, 0.25, 0.5, 0.999, 1.0]
    df = spark.range(n).select((F.xxhash64("id") / float(1 << 63) * spread).alias("v"), F.lit("g").alias("g"))
    v = np.sort(df.select("v").toPandas()["v"].to_numpy())
    got = {r["p"]: r["q"] for r in exact.quantiles(df, ["g"], "v", probs).collect()}
    assert len(np.unique(v)) > 990_000 and all(np.isclose(got[p], np.quantile(v, p), rtol=1e-12) for p in probs)


def test_quantiles_of_whole_numbers_and_times(spark):
    df = spark.range(50_000).select((F.col("id") * F.col("id") - 10**6).alias("v"), (F.col("id") % 3).alias("g"))
    got = {(r["g"], r["p"]): r["q"] for r in exact.quantiles(df, ["g"], "v", [0.1, 0.5]).collect()}
    for g in range(3):
        v = [float(i * i - 10**6) for i in range(g, 50_000, 3)]
        assert all(np.isclose(got[g, p], np.quantile(v, p)) for p in (0.1, 0.5))
    assert exact.quantiles(df.where("v is null"), ["g"], "v", [0.5]).collect() == []


def test_no_window_ranks_more_than_its_bound(spark):
    """What reaches the last window is at most RANKED distinct values a rank."""
    df = spark.range(200_000).select((F.xxhash64("id") / float(1 << 60)).alias("v"), F.lit("g").alias("g"))
    plan = exact.quantiles(df, ["g"], "v", [0.5])
    values = exact.cut(df.groupBy("g", exact.order_key(F.col("v"), T.DoubleType()).alias("_k")).agg(F.count("*").alias("_n")))
    shift, above = 64 - exact.ROUND_BITS, None
    ranks = spark.createDataFrame([("g", 0.5, 0.0, 99_999, None, 0, 200_000)], "g string, p double, _at double, _rank long, _part long, _low long, _distinct long")
    while ranks.first()["_distinct"] > exact.RANKED:
        ranks = exact.cut(exact._narrowed(values, ranks, ["g"], above, shift))
        above, shift = shift, shift - exact.ROUND_BITS
    assert exact._inside(values, ranks, ["g"], above).count() == ranks.first()["_distinct"] <= exact.RANKED
    assert plan.count() == 1


def test_sums_do_not_depend_on_the_order(spark):
    draw = random.Random(7)
    rows = [("a", float(round(draw.uniform(0, 1e6), 2)), draw.randrange(9)) for _ in range(5000)]
    found = set()
    for parts in (1, 3, 7):
        draw.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, y double, x long").repartition(parts)
        mean = df.groupBy("g").agg(exact.exact_mean(F.col("y"), 12).alias("m")).first()["m"]
        found.add((mean, tuple(exact.co_moments(df, ["g"], "x", ["y"], 12).first())))
    (mean, line) = found.pop()
    assert not found
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    slope, intercept = np.polyfit(x, y, 1)
    assert np.isclose(mean, y.mean()) and np.allclose(line[1:], [5000, slope, intercept, np.corrcoef(x, y)[0, 1]])


def test_lines_without_spread_are_null(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 1, 2.0), ("b", 2, 2.0), ("c", 1, None)], "g string, x long, y double")
    got = {r["g"]: tuple(r)[1:] for r in exact.co_moments(df, ["g"], "x", ["y"]).collect()}
    assert got == {"a": (2, None, None, None), "b": (2, 0.0, 2.0, None), "c": (0, None, None, None)}


def heavy_times(n, seed, seconds):
    draw = random.Random(seed)
    return [START + timedelta(seconds=draw.randrange(seconds)) for _ in range(n)]


def test_as_of_with_a_heavy_server(spark):
    starts, seen = heavy_times(400, 1, 50_000), heavy_times(300, 2, 60_000)
    rows = [(*job(i, start=t.isoformat(), hosts="cpu1-1" if i % 9 else "cpu1-2"),) for i, t in enumerate(starts)]
    by_time = {t: float(i) for i, t in enumerate(seen)}
    tel = [("cpu1-1", "cpu_total", t, v) for t, v in by_time.items()] + [("cpu1-1", "power", START, 1.0)]
    got = {r["job_id"]: (r["ts"], r["value"]) for r in telemetry.next_readings(spark.createDataFrame(rows, JOB), spark.createDataFrame(tel, "server string, metric string, ts timestamp_ntz, value double")).collect()}
    want = {i: min((s, v) for s, v in by_time.items() if s >= t) for i, t in enumerate(starts) if i % 9 and t <= max(seen)}
    assert got == want


def test_as_of_joins_no_start_with_readings(spark):
    jobs, tel = spark.createDataFrame([job(1)], JOB), spark.createDataFrame([], "server string, metric string, ts timestamp_ntz, value double")
    plan = telemetry.next_readings(jobs, tel)._jdf.queryExecution().analyzed().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert joins and all("_b#" in x or "_up" in x or "_k#" in x for x in joins), joins


def brute_groups(times, gap):
    out, first = [], None
    for i, t in sorted(enumerate(times), key=lambda x: (x[1], x[0])):
        if first is None or (t - first).total_seconds() > gap:
            first = t
            out.append([])
        out[-1].append(i)
    return sorted(sorted(x) for x in out)


@pytest.mark.parametrize(("n", "seconds"), [(300, 9000), (200, 100), (3, 10**6)])
def test_groups_start_at_their_first_job(spark, n, seconds):
    times = heavy_times(n, n, seconds)
    rows = [(*job(i, sub=t.isoformat(), hosts=f"cpu1-[{i % 5}-{i % 5 + 1}]", gpus=i % 3)[:2], "same_1", *job(i, sub=t.isoformat(), hosts=f"cpu1-[{i % 5}-{i % 5 + 1}]", gpus=i % 3)[3:]) for i, t in enumerate(times)]
    got = classify.groups(spark.createDataFrame(rows, JOB), 300).collect()
    assert sorted([int(x) for x in r["ids"].split(",")] for r in got) == brute_groups(times, 300)
    for r in got:
        ids = [int(x) for x in r["ids"].split(",")]
        assert r["jobs"] == len(ids) and r["gpus"] == max(i % 3 for i in ids) and r["first"] == min(times[i] for i in ids)
        assert set(r["hosts"].split(",")) == {f"cpu1-{i % 5 + d}" for i in ids for d in (0, 1)}


def test_groups_of_nothing(spark):
    assert classify.groups(spark.createDataFrame([], JOB)).collect() == []
