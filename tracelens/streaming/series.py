"""Series that read the same from a stream and from a closed table.

Each function takes a DataFrame. On a stream the event time gets a watermark and results come out in append mode once it has passed; on
a table the watermark has no effect and all results come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(jobs: DataFrame, late: str = "2 hours") -> DataFrame:
    """Submissions and GPUs of each hour that has any."""
    x = jobs.where("submit_time is not null").select(F.col("submit_time").cast("timestamp").alias("at"), "gpu_num").withWatermark("at", late)
    return x.groupBy(F.window("at", "1 hour").alias("w")).agg(F.count("*").alias("jobs"), F.sum("gpu_num").alias("gpus")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "jobs", "gpus")


def bursts(jobs: DataFrame, more_than: int = 2, late: str = "10 minutes") -> DataFrame:
    """Minutes with more submissions than ``more_than``."""
    x = jobs.where("submit_time is not null").select(F.col("submit_time").cast("timestamp").alias("at")).withWatermark("at", late)
    return x.groupBy(F.window("at", "1 minute").alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > more_than).select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "n")


def high_sessions(t: DataFrame, threshold: float = 60.0, gap: str = "12 hours", least_seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """Periods of readings above the threshold per server, no two neighbours more than ``gap`` apart."""
    x = t.where(F.col("value") > threshold).select("server", F.col("ts").cast("timestamp").alias("at"), "value").withWatermark("at", late)
    s = x.groupBy("server", F.session_window("at", gap).alias("w")).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"), F.max("value").alias("most"))
    return s.where(F.timestamp_diff("SECOND", F.col("first"), F.col("last")) >= least_seconds).select("server", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n", "most")


def once(t: DataFrame, late: str = "1 hour") -> DataFrame:
    """One reading for each server, metric and time."""
    x = t.select("server", "metric", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    return x.dropDuplicates(["server", "metric", "at"]).select("server", "metric", F.col("at").cast("timestamp_ntz").alias("ts"))
