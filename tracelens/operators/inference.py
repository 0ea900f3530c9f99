"""Users of jobs without one: fingerprints, density clustering within equal categories, and how sure a cluster is."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import scan
from tracelens.operators.graph import components, cut
from tracelens.operators.rules import number_of, text_of

CATEGORIES = ("command", "base", "origin", "queue")
# The numbers of a fingerprint and what stands for a missing one.
NUMBERS = {"cpus": 0, "mem": 0, "gpus": 0, "hour": 12, "weekday": 1, "duration": 300, "success": 0}
# Levels of confidence: least jobs, least consistency, form of the id.
LEVELS = [("high", 10, 0.8, "inferred_high_%03d"), ("medium", 5, 0.6, "inferred_medium_%03d"), ("low", 2, 0.0, "inferred_low_%03d"), ("singleton", 0, 0.0, "singleton_%03d")]
#: Sides of a cell (a seventh of eps squared, so 2.65 sides are eps) that near vectors differ by at most, and how many numbers the neighbour search goes by.
REACH, NEAR_BY = 3, 3


def fingerprints(jobs: DataFrame) -> DataFrame:
    """Hashes of the whole command, the base name, the host of origin and the queue, and seven numbers, of every job."""
    short = lambda c: F.substring(F.md5(c.cast("binary")), 1, 8)
    known = {
        "cpus": number_of(jobs, "cpu_num"), "mem": number_of(jobs, "mem_gb"), "gpus": number_of(jobs, "gpu_num"), "hour": F.hour("submit_time"), "weekday": F.weekday("submit_time"),
        "duration": C.seconds("start_time", "end_time"), "success": (F.col("exit_status") == 0).cast("int"),
    }
    numbers = [F.coalesce(c.cast("double"), F.lit(float(NUMBERS[k]))).alias(k) for k, c in known.items()]
    whole = {"command": text_of(jobs, "command"), "base": F.coalesce(C.base_name("job_name"), F.lit("")), "origin": text_of(jobs, "from_host"), "queue": text_of(jobs, "queue")}
    return jobs.select("job_id", "user_id", *[short(c).alias(k) for k, c in whole.items()], *numbers)


def _spread(nodes: DataFrame) -> tuple[list[str], list[str]]:
    """Numbers whose cells lie so far apart that near vectors agree in them, and the ``NEAR_BY`` others with the most cells. Seven pairs of numbers reach the driver."""
    values = nodes.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"g_{c}").alias("g")) for c in NUMBERS])).alias("x")).select("x.*").distinct()
    # One row a cell's side of a number's range, of at most the square root of the jobs' number.
    gaps = values.withColumn("gap", F.col("g") - F.lag("g").over(Window.partitionBy("c").orderBy("g")))
    found = {r["c"]: (r["gap"], r["n"]) for r in gaps.groupBy("c").agg(F.min("gap").alias("gap"), F.count("*").alias("n")).collect()}
    equal = [c for c in NUMBERS if c in found and (found[c][0] is None or found[c][0] > REACH)]
    return equal, sorted((c for c in found if c not in equal), key=lambda c: (-found[c][1], c))[:NEAR_BY]


def _units(nodes: DataFrame, least: int) -> DataFrame:
    """Cells that weigh ``least`` or more, and each node of the others: (unit, dense, weight, bounds of its numbers)."""
    cell = [*CATEGORIES, *[f"g_{c}" for c in NUMBERS]]
    bounds = [f(f"z_{c}").alias(f"{n}_{c}") for c in NUMBERS for n, f in (("lo", F.min), ("hi", F.max))]
    cells = nodes.groupBy(*cell).agg(F.min("node").alias("unit"), F.sum("w").alias("w"), *bounds)
    dense = cells.where(F.col("w") >= least)
    sparse = nodes.join(cells.where(F.col("w") < least).select(*cell), cell, "left_semi")
    points = sparse.select(*cell, F.col("node").alias("unit"), "w", *[F.col(f"z_{c}").alias(f"{n}_{c}") for c in NUMBERS for n in ("lo", "hi")])
    return dense.withColumn("dense", F.lit(True)).unionByName(points.withColumn("dense", F.lit(False)))


def _near(units: DataFrame, equal: list[str], by: list[str], eps: float) -> DataFrame:
    """Pairs (a, b) of units that may hold near vectors, from one side only; ``sure`` if all their vectors are near."""
    exact = [*CATEGORIES, *[f"g_{c}" for c in equal]]
    keyed = units.withColumns({f"k_{c}": F.floor(F.col(f"g_{c}") / REACH) for c in by})
    keys = [f"k_{c}" for c in by]
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(by)) if s >= (0,) * len(by)]
    facts = ["unit", "w", "dense", *[f"{n}_{c}" for c in NUMBERS for n in ("lo", "hi")]]
    offer = F.explode(F.array(*[F.struct(*[(F.col(k) + d).alias(k) for k, d in zip(keys, step, strict=True)], F.lit(any(step)).alias("other")) for step in steps]))
    one = keyed.withColumn("at", offer).select(*exact, *[F.col(f"at.{k}").alias(k) for k in keys], "at.other", *[F.col(c).alias(f"a_{c}") for c in facts])
    met = one.join(keyed.select(*exact, *keys, *[F.col(c).alias(f"b_{c}") for c in facts]).hint("merge"), [*exact, *keys])
    squares = lambda of: sum((of(c) * of(c) for c in NUMBERS), F.lit(0.0))
    between = squares(lambda c: F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}")))
    across = squares(lambda c: F.greatest(F.col(f"a_hi_{c}") - F.col(f"b_lo_{c}"), F.col(f"b_hi_{c}") - F.col(f"a_lo_{c}")))
    # Bounds of two nodes are their distance itself, summed as ``_apart`` does.
    tried = met.where("other or a_unit < b_unit").select("a_unit", "a_w", "a_dense", "b_unit", "b_w", "b_dense", between.alias("between"), across.alias("across"))
    slack = F.when(F.col("a_dense") | F.col("b_dense"), F.lit(1e-9)).otherwise(F.lit(0.0))
    return tried.where(F.col("between") <= eps * eps * (1 + slack)).select(
        F.struct(F.col("a_unit").alias("unit"), F.col("a_w").alias("w"), F.col("a_dense").alias("dense")).alias("a"), F.struct(F.col("b_unit").alias("unit"), F.col("b_w").alias("w"), F.col("b_dense").alias("dense")).alias("b"), (F.col("across") <= eps * eps * (1 - slack)).alias("sure")
    )


def _apart(one: str, other: str) -> Column:
    """Squared distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(one, other, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, d: s + d)


def clusters(jobs: DataFrame, eps: float = 0.3, least: int = 3) -> DataFrame:
    """Rows (job_id, cluster) of jobs without a user; a cluster is named by its smallest job, jobs outside all have null.

    Density clustering of standardised numbers inside equal categories (a difference in a category alone exceeds ``eps``). Equal vectors are one node with
    a weight. A node whose neighbourhood weighs ``least`` or more is core; core nodes within ``eps`` are linked; other nodes near a core take the smallest cluster.

    Vectors lie in cells whose diagonal is ``eps``: in a cell that weighs ``least`` or more all are core and in one cluster, so such a cell
    is one unit, and each node of another cell is one. Bounds of two units' numbers mostly decide whether all or none of their vectors are near. The vectors
    themselves are compared only for units of single nodes whose weight or cluster still depends on a dense cell, and for units that
    may link two components. The number of dense cells follows the range of the numbers, not the number of jobs.
    """
    x = cut(fingerprints(jobs.where("user_id is null")).drop("user_id"))
    stats = x.agg(*[f(c).alias(f"{n}_{c}") for c in NUMBERS for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()  # two numbers a column
    z = {f"z_{c}": (F.col(c) - F.lit(stats[f"m_{c}"] or 0.0)) / F.lit((stats[f"s_{c}"] or 0.0) or 1.0) for c in NUMBERS}
    key = [*CATEGORIES, *NUMBERS]
    side = eps / math.sqrt(len(NUMBERS)) * (1 - 1e-9)
    nodes = x.groupBy(*key).agg(F.min("job_id").alias("node"), F.count("*").alias("w")).withColumns(z)
    nodes = cut(nodes.withColumns({f"g_{c}": F.floor(F.col(f"z_{c}") / side) for c in NUMBERS}))
    units = cut(_units(nodes, least))
    pairs = cut(_near(units, *_spread(nodes), eps))

    # Nodes of dense cells, for the comparisons that bounds leave open.
    cell = [*CATEGORIES, *[f"g_{c}" for c in NUMBERS]]
    inside = nodes.join(units.where("dense").select(*cell, "unit"), cell).select("unit", F.col("node"), "w", F.array(*z).alias("z"))
    alone = units.where("not dense").select("unit", F.col("unit").alias("node"), "w", F.array(*[f"lo_{c}" for c in NUMBERS]).alias("z"))
    vectors = inside.unionByName(alone)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sure"))

    def compared(open_pairs: DataFrame) -> DataFrame:
        """(a, b, w) of open pairs: the weight of b's vectors that are near one of a's."""
        one = open_pairs.join(vectors.select(F.col("unit").alias("a"), F.col("z").alias("y")).hint("merge"), "a")
        met = one.join(vectors.select(F.col("unit").alias("b"), "node", "w", "z").hint("merge"), "b").where(_apart("y", "z") <= eps * eps)
        return met.groupBy("a", "b").agg(F.sum("w").alias("w"))

    # Weight around each single node: what is surely near, then, where that is too little, near vectors of dense cells.
    single = both.where("not a.dense")
    surely = units.where("not dense").select("unit", "w").unionByName(single.where("sure").select(F.col("a.unit").alias("unit"), F.col("b.w").alias("w"))).groupBy("unit").agg(F.sum("w").alias("w"))
    few = cut(surely.where(F.col("w") < least))
    rest = cut(compared(single.where("not sure and b.dense").select(F.col("a.unit").alias("a"), F.col("b.unit").alias("b")).join(few.select(F.col("unit").alias("a")), "a", "left_semi")))
    more = few.unionByName(rest.select(F.col("a").alias("unit"), "w")).groupBy("unit").agg(F.sum("w").alias("w")).where(F.col("w") >= least)
    core = cut(units.where("dense").select("unit").unionByName(surely.where(F.col("w") >= least).select("unit")).unionByName(more.select("unit")))

    cores = pairs.select(F.col("a.unit").alias("a"), F.col("b.unit").alias("b"), "sure")
    for c in ("a", "b"):
        cores = cores.join(core.withColumnRenamed("unit", c).hint("merge"), c, "left_semi")
    links = cores.where("sure").select("a", "b")
    named = cut(core.join(components(links).withColumnRenamed("node", "unit"), "unit", "left").select("unit", F.coalesce("root", "unit").alias("cluster")))
    name = lambda c: named.select(F.col("unit").alias(c), F.col("cluster").alias(f"c_{c}"))
    apart = cores.where("not sure").join(name("a"), "a").join(name("b"), "b").where("c_a <> c_b")
    found = compared(cut(apart.select("a", "b"))).join(name("a"), "a").join(name("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    named = cut(named.join(components(found).withColumnRenamed("node", "cluster"), "cluster", "left").select("unit", F.coalesce("root", "cluster").alias("cluster")))

    # Nodes that are not core: the smallest cluster of a core within reach. Few of them are left, and what is near them weighs less than ``least``.
    lone = few.select("unit").join(core, "unit", "left_anti")
    close = single.where("sure").select(F.col("a.unit").alias("unit"), F.col("b.unit").alias("b")).unionByName(rest.select(F.col("a").alias("unit"), "b"))
    edge = close.join(lone, "unit", "left_semi").join(named.withColumnRenamed("unit", "b"), "b").groupBy("unit").agg(F.min("cluster").alias("cluster"))
    of_unit = named.unionByName(edge)
    label = vectors.select("unit", "node").join(of_unit, "unit", "left").select("node", "cluster")
    return x.join(nodes.select(*key, "node").join(label, "node").hint("merge"), key).select("job_id", "cluster")


def confidence(jobs: DataFrame) -> DataFrame:
    """Per cluster its size, consistency, level and the id that its jobs get.

    Consistency is the mean of 1 / names, 1 / (1 + deviation of the cores) and 1 / (1 + deviation of the hour / 24). Ids are numbered in the order
    of the clusters; the numbers come from a tree over the clusters' names, not from one window.
    """
    found = clusters(jobs).where("cluster is not null")
    facts = found.join(jobs.select("job_id", "job_name", F.coalesce(number_of(jobs, "cpu_num"), F.lit(0.0)).alias("cpus"), F.coalesce(F.hour("submit_time"), F.lit(12)).alias("hour")), "job_id")
    got = facts.groupBy("cluster").agg(F.count("*").alias("n"), F.count_distinct("job_name").alias("names"), *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"s_{c}") for c in ("cpus", "hour")])
    steady = (1 / F.greatest(F.lit(1), F.col("names")) + 1 / (1 + F.col("s_cpus")) + 1 / (1 + F.col("s_hour") / 24)) / 3
    got = cut(got.withColumn("consistency", F.round(steady, 6)))
    numbered = scan.running_sums(got, [], F.floor(F.col("cluster") / 1000), ["cluster"], {"number": F.lit(1).cast("long")})
    level, form = F.lit(LEVELS[-1][0]), F.lit(LEVELS[-1][3])
    for name, size, share, text in reversed(LEVELS[:-1]):
        fits = (F.col("n") >= size) & (F.col("consistency") >= share)
        level, form = F.when(fits, name).otherwise(level), F.when(fits, text).otherwise(form)
    ids = F.lit(None).cast("string")
    for name, _, _, text in LEVELS:
        ids = F.when(level == name, F.format_string(text, F.col("number"))).otherwise(ids)
    return numbered.select("cluster", "n", "names", "consistency", level.alias("level"), ids.alias("inferred_user_id"))


def inferred(jobs: DataFrame) -> DataFrame:
    """Every job's user: its own, that of its cluster, or null, and how sure that is (``existing`` for known ones)."""
    ids = clusters(jobs).join(confidence(jobs).select("cluster", "level", "inferred_user_id"), "cluster")
    return jobs.select("job_id", "user_id").join(ids, "job_id", "left").select(
        "job_id", F.coalesce("user_id", "inferred_user_id").alias("user_id"), F.when(F.col("user_id").isNotNull(), "existing").otherwise(F.col("level")).alias("confidence")
    )
