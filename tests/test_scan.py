"""Ordered scans against plain windows, and the size of the windows they plan."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelens.operators import scan


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    data = [(draw.choice(["heavy", "heavy", "a", None]), t, i, draw.choice([None, draw.randrange(100)])) for i, t in enumerate(draw.randrange(-10**5, 10**5) for _ in range(1500))]
    return spark.createDataFrame(data, "g string, t long, id long, v long")


def bucket():
    return F.floor(F.col("t") / 50)


def whole():
    return Window.partitionBy("g").orderBy("t", "id")


def same(got, want):
    assert sorted(map(repr, got.select(*sorted(got.columns)).collect())) == sorted(map(repr, want.select(*sorted(want.columns)).collect()))


@pytest.mark.parametrize("bits", [4, 10])
@pytest.mark.parametrize("backward", [False, True])
def test_tree_scan(spark, rows, bits, backward):
    per = rows.groupBy("g", bucket().alias("b")).agg(F.sum("v").alias("s"), F.max(F.struct("t", "v")).alias("m"))
    w = Window.partitionBy("g").orderBy(F.desc("b") if backward else F.asc("b")).rowsBetween(Window.unboundedPreceding, -1)
    got = scan.tree_scan(per, ["g"], "b", {"x": (F.col("s"), "sum"), "y": (F.col("m"), "max")}, backward=backward, bits=bits)
    same(got, per.withColumn("x", F.sum("s").over(w)).withColumn("y", F.max("m").over(w)))


def test_tree_scan_without_groups_and_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7 - 9000).alias("k"))
    w = Window.partitionBy(F.lit(1)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    same(scan.tree_scan(df, [], "k", {"n": (F.lit(1).cast("long"), "sum")}), df.withColumn("n", F.sum(F.lit(1).cast("long")).over(w)))
    assert scan.tree_scan(df.where("k is null"), [], "k", {"n": (F.lit(1).cast("long"), "sum")}).collect() == []


def test_depth_follows_the_range():
    assert [scan.tree_depth(a, b) for a, b in ((None, None), (0, 0), (0, 1023), (0, 1024), (0, 1 << 20), (-1, 1), (-(1 << 63), (1 << 63) - 1))] == [1, 1, 1, 2, 3, 1, 7]


def test_running_sums(rows):
    got = scan.running_sums(rows, ["g"], bucket(), ["t", "id"], {"n": F.lit(1).cast("long"), "s": F.coalesce("v", F.lit(0))})
    w = whole().rowsBetween(Window.unboundedPreceding, 0)
    same(got, rows.withColumn("n", F.sum(F.lit(1).cast("long")).over(w)).withColumn("s", F.sum(F.coalesce("v", F.lit(0))).over(w)))


def test_beside(rows):
    same(scan.beside(rows, ["g"], bucket(), ["t", "id"], {"p": F.col("v")}), rows.withColumn("p", F.lag("v").over(whole())))
    same(scan.beside(rows, ["g"], bucket(), ["t", "id"], {"p": F.col("v")}, after=True), rows.withColumn("p", F.lead("v").over(whole())))


def test_known(rows):
    there = F.col("v") > 50
    last, first = whole().rowsBetween(Window.unboundedPreceding, 0), whole().rowsBetween(0, Window.unboundedFollowing)
    same(scan.known(rows, ["g"], bucket(), ["t", "id"], {"p": F.col("v")}, there), rows.withColumn("p", F.last(F.when(there, F.col("v")), True).over(last)))
    same(scan.known(rows, ["g"], bucket(), ["t", "id"], {"p": F.col("v")}, there, after=True), rows.withColumn("p", F.first(F.when(there, F.col("v")), True).over(first)))


def test_no_window_holds_a_group(rows):
    """Every window is partitioned by the bucket (rows) or by the parent node (buckets)."""
    plan = scan.beside(rows, ["g"], bucket(), ["t", "id"], {"p": F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    # The upmost level of the tree, of 2**bits nodes at most, is the only one that is not cut further.
    assert windows and sum(x.count("_b#") + x.count("_w") == 0 for x in windows) <= 1, windows
