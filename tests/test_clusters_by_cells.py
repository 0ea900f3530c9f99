"""Density clusters against a plain version, over jobs that lie thick enough for whole cells and thin enough for borders."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tests.test_operators import JOB
from tracelens.operators import inference


def plain(spark_jobs, eps=0.3, least=3):
    rows = inference.fingerprints(spark_jobs.where("user_id is null")).collect()
    z = np.array([[float(r[c]) for c in inference.NUMBERS] for r in rows])
    z = (z - z.mean(0)) / np.where(z.std(0) > 0, z.std(0), 1.0)
    kind = np.array([hash(tuple(r[c] for c in inference.CATEGORIES)) for r in rows])
    near = (((z[:, None] - z[None]) ** 2).sum(2) <= eps * eps) & (kind[:, None] == kind[None])
    core, ids = near.sum(1) >= least, [r["job_id"] for r in rows]
    name = [i if c else None for i, c in zip(ids, core, strict=True)]
    links = [np.flatnonzero(near[i] & core) for i in range(len(ids))]
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero(core):
            low = min(name[j] for j in links[i])
            changed, name[i] = changed or low < name[i], low
    return {ids[i]: name[i] if core[i] else min((name[j] for j in links[i]), default=None) for i in range(len(ids))}


def thick(seed, n):
    draw, t0, out = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at = t0 + timedelta(days=draw.randrange(3), hours=draw.choice([3, 4, 5, 9, 10, 16]))
        run = draw.choice([300 + draw.gauss(0, 60), 2000 + draw.gauss(0, 400), draw.uniform(0, 9000)])
        gpus = draw.choice([0, 0, 0, 1, 2, 3])
        out.append((i, None, "a", "x" if i % 3 else "y", "q", None, None, gpus, 4, 1, None, i % 2, at, at, at + timedelta(seconds=int(abs(run)))))
    return out


def test_clusters_equal_plain_ones(spark):
    for seed, n in ((1, 900), (2, 250)):
        jobs = spark.createDataFrame(thick(seed, n), JOB)
        got = {r["job_id"]: r["cluster"] for r in inference.clusters(jobs).collect()}
        assert got == plain(jobs)
        assert len({c for c in got.values() if c is not None}) > 3 and None in got.values()


def test_pairs_follow_the_cells_and_not_the_jobs(spark):
    """Four times the jobs in the same range: many more cells that are one unit, not many times the pairs."""
    seconds = lambda n: [(i, None, "a", "x", "q", None, None, 0, 4, 1, None, 0, datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 1) + timedelta(seconds=600 + i * 4000 // n)) for i in range(n)]
    sizes = []
    for n in (500, 2000):
        x = inference.fingerprints(spark.createDataFrame(seconds(n), JOB))
        side, s = 0.3 / 7**0.5, x.agg(F.avg("duration"), F.stddev_pop("duration")).first()
        z = {f"z_{c}": (F.col(c) - s[0]) / s[1] if c == "duration" else F.lit(0.0) for c in inference.NUMBERS}
        nodes = x.withColumn("w", F.lit(1).cast("long")).withColumnRenamed("job_id", "node").withColumns(z)
        nodes = nodes.withColumns({f"g_{c}": F.floor(F.col(f"z_{c}") / side) for c in inference.NUMBERS})
        sizes.append(inference._near(inference._units(nodes, 3), *inference._spread(nodes), 0.3).count())
    assert sizes[1] <= 1.5 * sizes[0]
