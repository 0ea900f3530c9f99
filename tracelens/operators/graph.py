"""Connected components, and tables cut from their lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, it is a temporary one in local mode, and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tracelens-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder by ``checkpoint()``: computed once, its lineage cut, safe against lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): rows (node, root) with the smallest node of each component as root.

    Alternating large-star and small-star steps, each one aggregation and one join keyed by node, until the edges stay the same;
    every step is written to the shared folder. Only two numbers a step reach the driver.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == seen or sign[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        e = cut(pairs.select("a", F.col("m").alias("b")).union(pairs.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a != b").distinct())
