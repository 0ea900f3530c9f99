"""Capacity, balance and demand by subcluster; job facts joined with telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import exact, sampling, telemetry

# Nodes, cores and GPUs of a node by subcluster.
SPEC = {"CPU1": (20, 64, 0), "CPU2": (21, 64, 0), "CPU3": (20, 128, 0), "GPU1": (23, 64, 8), "BIGMEM": (4, 96, 0)}


def spec(name: Column, field: int) -> Column:
    """A number of the hardware table: an expression, as the table is a constant."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in SPEC.items() for x in (k, v[field])]), name).cast("long")


def host_spec(jobs: DataFrame) -> DataFrame:
    """Each job's hosts with subcluster, cores and GPUs."""
    h = telemetry.job_hosts(jobs).select("job_id", "server", C.subcluster(F.col("server")).alias("subcluster"))
    return h.select("job_id", "server", "subcluster", spec(F.col("subcluster"), 1).alias("cores"), spec(F.col("subcluster"), 2).alias("gpus"))


def resources(jobs: DataFrame) -> DataFrame:
    """Sum of cores and GPUs, and number of hosts of each job."""
    return host_spec(jobs).groupBy("job_id").agg(F.sum("cores").alias("cores"), F.sum("gpus").alias("gpus"), F.count("*").alias("nodes"))


def _consumed(jobs: DataFrame, log: DataFrame) -> DataFrame:
    return log.join(sampling.primary_subcluster(jobs), "job_id").withColumn("node_hours", F.col("node_num") * F.col("duration") / 3600)


def days(log: DataFrame) -> int:
    """Whole days that the log covers: one number."""
    a, z = log.agg(F.min("submit_time"), F.max("submit_time")).first()
    return 1 if a is None else (z.date() - a.date()).days + 1


def utilisation(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Node hours that each subcluster's jobs took, and their percentage of the theoretical ones."""
    per = _consumed(jobs, log).groupBy("subcluster").agg(F.round(F.sum("node_hours"), 6).alias("node_hours"))
    return per.withColumn("percent", F.round(100 * F.col("node_hours") / (spec(F.col("subcluster"), 0) * 24 * days(log)), 6))


def theory(log: DataFrame) -> DataFrame:
    """Node hours of CPU (with large-memory) and GPU nodes over the log's days."""
    cpu, gpu = sum(v[0] for k, v in SPEC.items() if not k.startswith("GPU")), sum(v[0] for k, v in SPEC.items() if k.startswith("GPU"))
    span = log.agg((F.datediff(F.max("submit_time"), F.min("submit_time")) + 1).cast("long").alias("days"))
    return span.select("days", (F.col("days") * 24 * cpu).alias("cpu_node_hours"), (F.col("days") * 24 * gpu).alias("gpu_node_hours"))


def recommendation(jobs: DataFrame) -> DataFrame:
    """Largest job of each subcluster against its nodes: above 90 % expand, below 30 % over-provisioned."""
    per = host_spec(jobs).groupBy("subcluster", "job_id").agg(F.count("*").alias("n")).groupBy("subcluster").agg(F.max("n").alias("largest"))
    share = 100 * F.col("largest") / spec(F.col("subcluster"), 0)
    return per.select("subcluster", "largest", F.round(share, 6).alias("percent"), F.when(share > 90, "expand").when(share < 30, "over-provisioned").otherwise("adequate").alias("advice"))


def balance(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Spread of the subclusters' shares of node hours."""
    per = _consumed(jobs, log).groupBy("subcluster").agg(F.sum("node_hours").alias("x"))
    share = per.withColumn("share", 100 * F.col("x") / F.sum("x").over(Window.partitionBy(F.lit(1))))  # one row a subcluster
    s = share.agg(F.count("*").alias("k"), F.stddev_samp("share").alias("sd"), F.max_by("subcluster", "share").alias("most"), F.min_by("subcluster", "share").alias("least"))
    return s.select(F.round("sd", 6).alias("std"), F.round(F.col("sd") / (100 / F.col("k")), 6).alias("imbalance"), "most", "least")


def cpus_by_subcluster(jobs: DataFrame, log: DataFrame) -> DataFrame:
    per = log.where("gpu_num = 0").join(sampling.primary_subcluster(jobs).select("job_id", "subcluster"), "job_id").groupBy("subcluster").agg(F.count("*").alias("jobs"), F.round(F.avg("cpu_num"), 6).alias("mean_cpus"), F.max("cpu_num").alias("max_cpus"))
    return per.withColumn("cores", spec(F.col("subcluster"), 1))


def overlapping_gpus(log: DataFrame) -> DataFrame:
    """For each job the GPUs of all jobs that overlap it (itself included): those started by its end less those ended before its start."""
    t = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    none = F.lit(None).cast("long")

    def before(events: str, ask: str, event_first: bool) -> DataFrame:
        e = log.select(t(events).alias("t"), F.lit(0 if event_first else 1).alias("tag"), F.col("gpu_num").alias("w"), none.alias("job_id"))
        q = log.select(t(ask).alias("t"), F.lit(1 if event_first else 0).alias("tag"), F.lit(0).cast("long").alias("w"), F.col("job_id"))
        run = exact.prefix_sums(e.unionByName(q), F.floor(F.col("t") / 3600), [F.col("t"), F.col("tag"), F.col("job_id")], {"s": F.col("w")})
        return run.where("job_id is not null").select("job_id", "s")

    started, ended = before("start_time", "end_time", True), before("end_time", "start_time", False)
    return started.join(ended.withColumnRenamed("s", "e"), "job_id").select("job_id", (F.col("s") - F.col("e")).alias("gpus"))


def windows(log: DataFrame) -> DataFrame:
    """Jobs that run in each hour: days of a job first, then the hours inside each."""
    d = log.withColumn("day", F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time")))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    hour = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))
    met = d.withColumn("hour", hour).where("hour <= end_time").where((F.col("hour") + F.expr("interval 1 hour")) > F.col("start_time"))
    return met.groupBy("hour").agg(F.count("*").alias("jobs"), F.sum("gpu_num").alias("gpus"))


def normalised(name: Column) -> Column:
    """A host's name in lower case, without its domain and without signs other than letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\..*$", ""), "[^a-z0-9]", "")


def name_keys(name: Column) -> Column:
    """A name and what is left of it without each one of its signs: two names one edit apart share a key."""
    cut = lambda i: F.concat(name.substr(F.lit(1), i - 1), name.substr(i + 1, F.length(name)))
    return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), cut)).otherwise(F.array())))


def resolved(hosts: DataFrame, t: DataFrame) -> DataFrame:
    """Telemetry server of each of ``hosts`` (column host): the same name, else the first server of its subcluster, else one of a like name.

    Names are alike if their normalised forms are at most one edit apart: they meet by the index of ``name_keys``, and the edit distance confirms.
    The nearest counts, then the smaller name.
    """
    servers = t.select("server").distinct()
    first = servers.groupBy(C.subcluster(F.col("server")).alias("s")).agg(F.min("server").alias("other")).where("s <> 'UNKNOWN'")
    h = hosts.select("host").distinct().withColumn("s", C.subcluster(F.col("host")))
    got = h.join(servers.select(F.col("server").alias("host"), F.col("server").alias("same")), "host", "left").join(first, "s", "left")
    index = servers.withColumn("m", normalised(F.col("server"))).withColumn("key", F.explode(name_keys(F.col("m"))))
    asked = got.where("same is null and other is null").select("host").withColumn("n", normalised(F.col("host"))).where("n <> ''")
    met = asked.withColumn("key", F.explode(name_keys(F.col("n")))).join(index, "key").withColumn("far", F.levenshtein("n", "m")).where("far <= 1")
    near = met.groupBy("host").agg(F.min_by("server", F.struct("far", "server")).alias("like"))
    how = F.when(F.col("same").isNotNull(), "same").when(F.col("other").isNotNull(), "group").when(F.col("like").isNotNull(), "name").otherwise("none")
    return got.join(near, "host", "left").select("host", F.coalesce("same", "other", "like").alias("server"), how.alias("how"))


def by_command(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Per command: jobs with readings, mean CPU use, mean request."""
    read = ("cpu_total",)
    use = telemetry.at_hours(telemetry.job_days(jobs, t, read=read), read).groupBy("job_id").agg(F.sum("cpu_total").alias("s"), F.count("cpu_total").alias("n"))
    got = jobs.join(use.hint("merge"), "job_id").where("command is not null").groupBy("command")
    return got.agg(F.count("*").alias("jobs"), F.round(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), 5).alias("mean_cpu"), F.round(F.avg("cpu_num"), 6).alias("mean_request"))


#: Readings that job hours are set against, and their short names.
METRICS = {"cpu_total": "cpu", "gpu_util": "gpu", "load_1min": "load", "power": "power"}


def by_user(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Per user: jobs with readings, mean use in their hours, and mean request over the same hours."""
    known = jobs.where("job_id is not null and user_id is not null")
    h = telemetry.at_hours(telemetry.job_days(known, t, keep=("user_id", "cpu_num", "gpu_num")))
    return h.groupBy("user_id").agg(
        F.count_distinct("job_id").alias("jobs"), *[exact.exact_mean(F.col(c), 4).alias(k) for c, k in METRICS.items()],
        F.round(F.sum("cpu_num") / F.count("cpu_num"), 6).alias("cpus_asked"), F.round(F.sum("gpu_num") / F.count("gpu_num"), 6).alias("gpus_asked"),
    )


def hourly(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Per subcluster and hour: distinct jobs and mean readings.

    Means are summed where the rows are. Jobs are counted apart from them: a job's hours of a day in a subcluster are one row, a bit an hour.
    """
    group, keys = C.subcluster(F.col("server")).alias("subcluster"), ["subcluster", "hour"]
    means = telemetry.at_hours(telemetry.job_days(jobs, t)).groupBy(group, "hour").agg(*[exact.exact_mean(F.col(c), 5).alias(k) for c, k in METRICS.items()])
    bits = F.expr("aggregate(hours, 0, (s, x) -> s | shiftleft(1, x.h))")
    per = telemetry.job_days(jobs, t, read=()).where("job_id is not null").groupBy("job_id", group, "day").agg(F.bit_or(bits).alias("bits"))
    each = per.withColumn("h", F.explode(F.expr("filter(sequence(0, 23), h -> (bits & shiftleft(1, h)) <> 0)")))
    counts = each.groupBy("subcluster", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))).alias("hour")).agg(F.count("*").alias("jobs"))
    return means.join(counts, keys, "left").select(*keys, F.coalesce("jobs", F.lit(0).cast("long")).alias("jobs"), *METRICS.values())


def fit(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Least-squares line and correlation of each metric's hourly mean over the hour's jobs, by subcluster."""
    return exact.co_moments(hourly(jobs, t), ["subcluster"], "jobs", list(METRICS.values()))


def efficiency(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Per hour of day: mean CPU use as a share, and mean cores asked for, over jobs with readings."""
    read = ("cpu_total",)
    h = telemetry.at_hours(telemetry.job_days(jobs.where("job_id is not null"), t, keep=("cpu_num",), read=read), read)
    return h.groupBy(F.hour("hour").cast("long").alias("hour_of_day")).agg(F.round(F.avg("cpu_total") / 100, 6).alias("use"), F.round(F.avg("cpu_num"), 6).alias("asked"))


def labelled_hours(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Jobs by hour with the spread of each job over hosts; hours without readings are marked, not dropped.

    Hosts are counted over a job's days, before these become hours; the window holds one job's hosts, which come from one list.
    """
    read = ("cpu_total",)
    days = telemetry.job_days(jobs.where("job_id is not null"), t, read=read, unknown=True)
    servers = F.size(F.collect_set("server").over(Window.partitionBy("job_id"))).cast("long")
    h = telemetry.at_hours(days.withColumn("servers", servers), read)
    return h.select("job_id", "server", "hour", "cpu_total", "all_null", "servers", F.when(F.col("servers") > 1, "multi").otherwise("single").alias("spread"))
