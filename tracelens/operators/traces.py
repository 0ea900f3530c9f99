"""Trace tables: the canonical log, hourly series, concurrency, event rates, curves and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import columns as C

# Breakpoints of the curves.
GPU_BREAKS = [1, 2, 4, 8, 12, 16, 24, 32, 40, 48, 56, 64, 80]
CPU_BREAKS = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]
DURATION_BREAKS = [2**i for i in range(22)]


def log(jobs: DataFrame) -> DataFrame:
    """Canonical trace: finished jobs with all times and a positive duration."""
    return (
        jobs.where("submit_time is not null and start_time is not null and end_time is not null")
        .select(
            "job_id",
            F.coalesce("user_id", F.lit("unknown_user")).alias("user"),
            F.coalesce("gpu_num", F.lit(0)).alias("gpu_num"),
            F.coalesce("cpu_num", F.lit(0)).alias("cpu_num"),
            F.coalesce("node_num", F.lit(1)).alias("node_num"),
            C.state("job_status_str", "exit_status").alias("state"),
            "submit_time",
            "start_time",
            "end_time",
            C.seconds("start_time", "end_time").alias("duration"),
            C.seconds("submit_time", "start_time").alias("queue"),
        )
        .where("duration > 0")
    )


def hours(log: DataFrame, time: str = "submit_time") -> DataFrame:
    """Every hour from the first to the last; days first, then the hours of each, so that no row holds the grid."""
    span = log.agg(F.date_trunc("hour", F.min(time)).cast("timestamp_ntz").alias("a"), F.date_trunc("hour", F.max(time)).cast("timestamp_ntz").alias("z"))
    days = span.where("a is not null").select("a", "z", F.explode(F.sequence(F.to_date("a"), F.to_date("z"))).alias("d"))
    hour = F.col("d").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))
    return days.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("a", "z", hour.alias("hour")).where("hour >= a and hour <= z").select("hour")


def _hour(time: str) -> Column:
    return F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")


def sequence(log: DataFrame) -> DataFrame:
    """Hourly submissions with their resources, every hour of the span, 0 where there are none."""
    per = log.groupBy(_hour("submit_time").alias("hour")).agg(
        F.count("*").alias("jobs"), F.sum("gpu_num").alias("gpus"), F.sum("cpu_num").alias("cpus"), F.round(F.avg("duration"), 6).alias("mean_duration")
    )
    return hours(log).join(per, "hour", "left").na.fill(0).withColumn("mean_duration", F.coalesce("mean_duration", F.lit(0.0)))


def throughput(log: DataFrame) -> DataFrame:
    """Hourly starts, their durations and resource hours."""
    return log.groupBy(_hour("start_time").alias("hour")).agg(
        F.count("*").alias("started"),
        F.round(F.avg("duration"), 6).alias("mean_duration"),
        F.sum("duration").alias("sum_duration"),
        F.round(F.sum(F.col("duration") * F.col("gpu_num")) / 3600, 6).alias("gpu_hours"),
        F.round(F.sum(F.col("duration") * F.col("cpu_num")) / 3600, 6).alias("cpu_hours"),
    )


def concurrency(log: DataFrame) -> DataFrame:
    """At every full hour: jobs, GPU jobs and GPUs with start <= t <= end, by a sweep over events summed per hour."""
    up = F.date_trunc("hour", F.col("start_time") + F.expr("interval '59' minute + interval '59' second")).cast("timestamp_ntz")
    down = F.date_trunc("hour", F.col("end_time") + F.expr("interval '1' hour")).cast("timestamp_ntz")
    sign = log.select(up.alias("up"), down.alias("down"), "gpu_num").where("up < down")
    steps = sign.select(F.explode(F.array(F.struct(F.col("up").alias("hour"), F.lit(1).alias("s")), F.struct(F.col("down").alias("hour"), F.lit(-1).alias("s")))).alias("e"), "gpu_num")
    per = steps.groupBy("e.hour").agg(F.sum("e.s").alias("dj"), F.sum(F.when(F.col("gpu_num") > 0, F.col("e.s")).otherwise(0)).alias("dg"), F.sum(F.col("e.s") * F.col("gpu_num")).alias("dn"))
    run = Window.partitionBy(F.lit(1)).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # over hours, not jobs
    return per.select("hour", F.sum("dj").over(run).alias("jobs"), F.sum("dg").over(run).alias("gpu_jobs"), F.sum("dn").over(run).alias("gpus"))


def event_rate(log: DataFrame) -> DataFrame:
    """Per hour: submitted, started and ended jobs and GPUs, all and GPU jobs."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _hour(c).alias("hour")) for k, c in (("submit", "submit_time"), ("start", "start_time"), ("end", "end_time"))])
    e = log.select(F.explode(kinds).alias("e"), "gpu_num")
    out = []
    for k in ("submit", "start", "end"):
        hit = F.col("e.kind") == k
        out += [F.count_if(hit).alias(f"{k}_all"), F.count_if(hit & (F.col("gpu_num") > 0)).alias(f"{k}_gpu"), F.sum(F.when(hit, F.col("gpu_num")).otherwise(0)).alias(f"{k}_gpu_num")]
    return e.groupBy("e.hour").agg(*out)


def monthly(log: DataFrame) -> DataFrame:
    """Per month: all, CPU, GPU, single- and multi-GPU jobs."""
    return log.groupBy(F.date_format("submit_time", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("jobs"), F.count_if(F.expr("gpu_num = 0")).alias("cpu_jobs"), F.count_if(F.expr("gpu_num > 0")).alias("gpu_jobs"), F.count_if(F.expr("gpu_num = 1")).alias("single_gpu"), F.count_if(F.expr("gpu_num > 1")).alias("multi_gpu")
    )


def daily_trend(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("submit_time").alias("day")).agg(F.count("*").alias("jobs"), F.count_if(F.expr("gpu_num > 0")).alias("gpu_jobs"), F.count_if(F.expr("gpu_num = 0")).alias("cpu_jobs"))


def diurnal(log: DataFrame) -> DataFrame:
    """Mean running jobs and GPUs by hour of day."""
    grid = hours(log, "start_time").join(concurrency(log), "hour", "left")
    # An hour without events keeps the level before it; the grid has one row an hour.
    level = Window.partitionBy(F.lit(1)).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    held = grid.select("hour", *[F.coalesce(F.last(c, True).over(level), F.lit(0)).alias(c) for c in ("jobs", "gpus")])
    return held.groupBy(F.hour("hour").cast("long").alias("hour_of_day")).agg(F.round(F.avg("jobs"), 6).alias("mean_jobs"), F.round(F.avg("gpus"), 6).alias("mean_gpus"))


def curve(log: DataFrame, value: str, weight: Column, breaks: list[int]) -> DataFrame:
    """Percentage of the weight of rows at or below each break. One aggregate, then one row a break."""
    w = log.withColumn("_w", weight)
    sums = w.agg(F.sum("_w").alias("whole"), *[F.sum(F.when(F.col(value) <= b, F.col("_w")).otherwise(0)).alias(f"b{i}") for i, b in enumerate(breaks)])
    rows = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("at"), F.col(f"b{i}").alias("part")) for i, b in enumerate(breaks)]))
    return sums.select("whole", rows.alias("r")).select("r.at", F.round(100 * F.col("r.part") / F.col("whole"), 6).alias("percent"))


def gpu_cdf(log: DataFrame) -> DataFrame:
    return curve(log.where("gpu_num > 0"), "gpu_num", F.lit(1), GPU_BREAKS)


def gputime_cdf(log: DataFrame) -> DataFrame:
    return curve(log.where("gpu_num > 0"), "gpu_num", F.col("gpu_num") * F.col("duration"), GPU_BREAKS)


def cpu_cdf(log: DataFrame) -> DataFrame:
    return curve(log.where("gpu_num = 0"), "cpu_num", F.lit(1), CPU_BREAKS)


def cputime_cdf(log: DataFrame) -> DataFrame:
    return curve(log.where("gpu_num = 0"), "cpu_num", F.col("cpu_num") * F.col("duration"), CPU_BREAKS)


def duration_cdf(log: DataFrame) -> DataFrame:
    parts = [curve(log.where(c), "duration", F.lit(1), DURATION_BREAKS).withColumn("job_type", F.lit(k)) for k, c in (("gpu", "gpu_num > 0"), ("cpu", "gpu_num = 0"))]
    return parts[0].unionByName(parts[1])


def gpu_hist(log: DataFrame) -> DataFrame:
    return log.groupBy("gpu_num").agg(F.count("*").alias("jobs"), F.sum(F.col("gpu_num") * F.col("duration")).alias("gpu_seconds"))


def completion_hist(log: DataFrame) -> DataFrame:
    """Users per ten points of their completion percentage; 100 falls in the last bin."""
    per = log.groupBy("user").agg((100 * F.count_if(F.col("state") == "COMPLETED") / F.count("*")).alias("rate"))
    return per.groupBy(F.least(F.floor(F.col("rate") / 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("users"))


def wait_run(log: DataFrame) -> DataFrame:
    return log.where("queue >= 0").select("job_id", C.job_type("gpu_num").alias("job_type"), "queue", "duration")


def by_hour(log: DataFrame) -> DataFrame:
    return log.groupBy(F.hour("submit_time").cast("long").alias("hour")).agg(F.count("*").alias("jobs"), F.count_if(F.expr("gpu_num > 0")).alias("gpu_jobs"), F.count_if(F.expr("gpu_num = 0")).alias("cpu_jobs"))


def by_weekday(log: DataFrame) -> DataFrame:
    """Jobs by weekday, Monday first."""
    day = F.weekday("submit_time").cast("long")
    return log.groupBy(day.alias("weekday")).agg(F.count("*").alias("jobs"), F.bool_or(F.weekday("submit_time") >= 5).alias("weekend"))


def hour_peak_by_type(log: DataFrame) -> DataFrame:
    """Per job type: total and peak hour (the earlier on a tie)."""
    per = log.groupBy(C.job_type("gpu_num").alias("job_type"), F.hour("submit_time").cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return per.groupBy("job_type").agg(F.sum("n").alias("jobs"), F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"), F.max("n").alias("peak_jobs"))


def hour_mean(log: DataFrame) -> DataFrame:
    return sequence(log).groupBy(F.hour("hour").cast("long").alias("hour_of_day")).agg(F.round(F.avg("jobs"), 6).alias("mean_jobs"), F.round(F.avg("gpus"), 6).alias("mean_gpus"))


def week_hour(log: DataFrame) -> DataFrame:
    """Jobs by weekday and hour of day, one column an hour, 0 where there are none."""
    cells = [F.count_if(F.hour("submit_time") == h).alias(f"h{h}") for h in range(24)]
    return log.groupBy(F.weekday("submit_time").cast("long").alias("weekday")).agg(*cells)


def month_capacity(log: DataFrame, gpus: int = 64) -> DataFrame:
    """Share of the month's GPU time that jobs used, by the month in which they start."""
    month = F.date_trunc("month", F.col("start_time")).cast("timestamp_ntz")
    per = log.groupBy(month.alias("month")).agg(F.sum(F.col("gpu_num") * F.col("duration")).alias("gpu_seconds"))
    return per.select(F.date_format("month", "yyyy-MM").alias("month"), "gpu_seconds", F.round(F.col("gpu_seconds") / (F.dayofmonth(F.last_day("month")) * 86400.0 * gpus), 9).alias("share"))
