"""Rule classification of jobs, user inference, quality overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import exact, rules, scan
from tracelens.operators.graph import cut


def is_distributed() -> Column:
    """More than one host, more than four GPUs, or a launcher in the command."""
    return (F.coalesce(F.size(C.hosts("exec_hosts")), F.lit(0)) > 1) | (F.col("gpu_num") > 4) | F.coalesce(F.lower("command").rlike("mpirun|srun|torchrun|horovod|deepspeed"), F.lit(False))


def distributed(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", is_distributed().alias("distributed"))


def distributed_view(jobs: DataFrame) -> DataFrame:
    """Jobs by number of hosts, distributed or not."""
    return jobs.groupBy(F.coalesce(F.size(C.hosts("exec_hosts")), F.lit(0)).cast("long").alias("hosts"), is_distributed().alias("distributed")).agg(F.count("*").alias("jobs"))


def type_distribution(jobs: DataFrame) -> DataFrame:
    s = rules.job_types(jobs)
    return s.groupBy("type").agg(F.count("*").alias("n"), exact.exact_mean(F.col("score")).alias("mean_score"), F.count_if(F.col("score") >= 0.7).alias("sure"))


def llm_split(jobs: DataFrame) -> DataFrame:
    """Jobs, GPU jobs and share by verdict, how it came about and task."""
    x = rules.language_model_jobs(jobs)
    n = x.groupBy("kind", "how", rules.task(rules.text_of(jobs, "command")).alias("task")).agg(F.count("*").alias("n"), F.count_if(F.col("gpu_num") > 0).alias("gpu_jobs"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 6))


def overview(jobs: DataFrame) -> DataFrame:
    """Rows, invalid durations and queues, and the months, weekdays and hours that submissions cover."""
    d, q = C.seconds("start_time", "end_time"), C.seconds("submit_time", "start_time")
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(d <= 0).alias("bad_duration"), F.count_if(q < 0).alias("bad_queue"), F.count_distinct(F.month("submit_time")).alias("months"), F.count_distinct(F.weekday("submit_time")).alias("weekdays"), F.count_distinct(F.hour("submit_time")).alias("hours"))


def intervals(jobs: DataFrame, least: int = 10) -> DataFrame:
    """Seconds between a user's submissions where there are ``least`` or more: number, mean, deviation, median.

    The submission before is carried over a user's hours, so that no task holds a user's history.
    """
    known = jobs.where("user_id is not null and submit_time is not null").select("user_id", "submit_time", "job_id")
    x = scan.beside(known, ["user_id"], C.hour_number("submit_time"), ["submit_time", "job_id"], {"_l": F.col("submit_time")}).withColumn("step", C.seconds("_l", "submit_time")).where("step is not null")
    s = x.groupBy("user_id").agg((F.count("*") + 1).alias("n"), F.round(F.avg("step"), 6).alias("mean"), F.round(F.stddev_samp("step"), 4).alias("std")).where(F.col("n") >= least)
    return s.join(exact.wide_quantiles(x, ["user_id"], "step", {"median": 0.5}), "user_id")


def anchors(times: DataFrame, key: list[str], gap: int) -> DataFrame:
    """``times`` (distinct key, at) that begin a group: the first of each key, and from each beginning the first time more than ``gap`` seconds after it.

    Every time points to the first one more than ``gap`` seconds after it. Marks run along the pointers from each key's first time; pointers
    double every round, so that the rounds are the logarithm of the longest chain. One number a round reaches the driver.
    """
    later = F.col("at") + F.make_dt_interval(secs=F.lit(float(gap)))
    asked = times.select(*key, F.col("at").alias("own"), later.alias("at"), F.lit(1).alias("tag"))
    stream = times.select(*key, F.col("at").alias("own"), "at", F.lit(0).alias("tag")).unionByName(asked)
    # A question comes behind a time equal to it, so that only later ones answer.
    met = scan.known(stream, key, C.hour_number("at"), ["at", "tag"], {"next": F.col("at")}, F.col("tag") == 0, after=True).where("tag = 1")
    first = times.groupBy(*key).agg(F.min("at").alias("at")).withColumn("mark", F.lit(True))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    on = same("n", "f")
    joined = met.select(*key, F.col("own").alias("at"), "next").alias("n").join(first.alias("f"), [*on, F.col("n.at") == F.col("f.at")], "left")
    nodes = cut(joined.select(*[F.col(f"n.{k}") for k in key], "n.at", "n.next", F.coalesce("f.mark", F.lit(False)).alias("mark")))
    while nodes.where("next is not null").limit(1).count():
        hit = nodes.where("mark and next is not null").select(*key, F.col("next").alias("at")).distinct()
        jump = nodes.select(*key, "at", F.col("next").alias("further"))
        n = nodes.alias("n").join(hit.withColumn("hit", F.lit(True)).alias("h"), [*same("n", "h"), F.col("n.at") == F.col("h.at")], "left")
        n = n.join(jump.alias("j"), [*same("n", "j"), F.col("n.next") == F.col("j.at")], "left")
        nodes = cut(n.select(*[F.col(f"n.{k}") for k in key], "n.at", F.col("j.further").alias("next"), (F.col("n.mark") | F.coalesce("h.hit", F.lit(False))).alias("mark")))
    return nodes.where("mark").select(*key, "at")


def groups(jobs: DataFrame, gap: int = 300) -> DataFrame:
    """Distributed jobs of one base name, submitted at most ``gap`` seconds after their group's first job, as one job.

    Its resources are the largest, its hosts the union, its ids joined in order. Rows of a group lie within ``gap`` seconds, which bounds the
    lists. Jobs without a name are one base name of their own.
    """
    key = ["base"]
    x = cut(jobs.where(is_distributed() & F.col("submit_time").isNotNull()).select("job_id", C.base_name("job_name").alias("base"), "user_id", F.col("submit_time").alias("at"), "gpu_num", "cpu_num", C.hosts("exec_hosts").alias("hosts")))
    begins = anchors(x.select(*key, "at").distinct(), key, gap)
    own = [f for f in x.schema.fields if f.name not in ("base", "at")]
    marks = begins.select(*key, "at", F.lit(0).alias("tag"), F.lit(-1).cast("long").alias("nth"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in own])
    stream = x.select(*key, "at", F.lit(1).alias("tag"), F.col("job_id").alias("nth"), *[f.name for f in own]).unionByName(marks)
    placed = scan.known(stream, key, C.hour_number("at"), ["at", "tag", "nth"], {"first": F.col("at")}, F.col("tag") == 0).where("tag = 1")
    got = placed.groupBy(*key, "first").agg(
        F.count("*").alias("jobs"), F.count_distinct("user_id").alias("users"), F.max("at").alias("last"), F.max("gpu_num").alias("gpus"), F.max("cpu_num").alias("cpus"), F.min("job_id").alias("head"),
        F.sort_array(F.collect_list("job_id")).alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("hosts", F.array()))))).alias("hosts"),
    )
    return got.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).withColumn("hosts", F.array_join("hosts", ","))


def word_affinity(jobs: DataFrame, weight: float = 0.1) -> DataFrame:
    """Per word of commands: net number of jobs with GPUs less jobs without, times the weight, from 0.5 on, clamped to 0..1 once."""
    w = jobs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("command"), F.lit(r"([a-z0-9_-]{3,})"), F.lit(1)))).alias("word"), F.when(F.col("gpu_num") > 0, 1).otherwise(-1).alias("sign"))
    return w.groupBy("word").agg(F.sum("sign").alias("net")).select("word", "net", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + weight * F.col("net"))), 6).alias("affinity"))
