"""Aggregates per user, state, size and recurrence; Pareto, ECDF and Gini."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import exact

def _done():
    return F.col("state") == "COMPLETED"


def basic(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("jobs"), F.count_distinct("user").alias("users"), F.min("submit_time").alias("first"), F.max("submit_time").alias("last"), F.count_if(F.expr("gpu_num > 0")).alias("gpu_jobs"),
        F.round(F.sum(F.col("node_num") * F.col("duration")) / 3600, 6).alias("node_hours"), F.round(F.avg("duration"), 6).alias("mean_duration"), F.max("gpu_num").alias("max_gpus"),
    )


def describe(log: DataFrame, value: str) -> DataFrame:
    """Mean, deviation, extremes and quantiles of positive values, for all, GPU and CPU jobs."""
    labelled = log.where(F.col(value) > 0).withColumn("part", F.explode(F.array(F.lit("all"), C.job_type("gpu_num"))))
    sums = labelled.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 4).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return sums.join(exact.wide_quantiles(labelled, ["part"], value, {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}), "part")


def duration_ratios(log: DataFrame) -> DataFrame:
    """Shares of durations below 5 minutes, an hour, a day, and above; all, GPU and CPU jobs."""
    labelled = log.withColumn("part", F.explode(F.array(F.lit("all"), C.job_type("gpu_num"))))
    d, n = F.col("duration"), F.count("*")
    share = lambda c: F.round(F.count_if(c) / n, 9)
    return labelled.groupBy("part").agg(n.alias("n"), share(d < 300).alias("m5"), share((d >= 300) & (d < 3600)).alias("h1"), share((d >= 3600) & (d < 86400)).alias("d1"), share(d >= 86400).alias("more"))


def queue_ratios(log: DataFrame) -> DataFrame:
    labelled = log.where("queue >= 0").withColumn("part", F.explode(F.array(F.lit("all"), C.job_type("gpu_num"))))
    q, n = F.col("queue"), F.count("*")
    share = lambda c: F.round(F.count_if(c) / n, 9)
    return labelled.groupBy("part").agg(n.alias("n"), F.round(F.avg("queue"), 6).alias("mean"), F.max("queue").alias("most"), share(q < 60).alias("m1"), share((q >= 60) & (q < 3600)).alias("h1"), share(q >= 3600).alias("more"))


def completion(log: DataFrame) -> DataFrame:
    labelled = log.withColumn("part", F.explode(F.array(F.lit("all"), C.job_type("gpu_num"))))
    states = ("COMPLETED", "FAILED", "CANCELLED")
    return labelled.groupBy("part").agg(F.count("*").alias("n"), *[F.count_if(F.col("state") == s).alias(s.lower()) for s in states], *[F.round(F.count_if(F.col("state") == s) / F.count("*"), 9).alias(f"{s.lower()}_share") for s in states])


def state_share(log: DataFrame) -> DataFrame:
    """Share of each state within GPU and within CPU jobs."""
    n = log.groupBy(C.job_type("gpu_num").alias("job_type"), "state").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("job_type")), 6))


def state_by_gpus(log: DataFrame) -> DataFrame:
    bins = F.when(F.col("gpu_num") < 2, "1").when(F.col("gpu_num") < 4, "2-3").when(F.col("gpu_num") < 8, "4-7").when(F.col("gpu_num") < 16, "8-15").otherwise("16+")
    return log.where("gpu_num > 0").groupBy(bins.alias("gpus")).agg(F.count("*").alias("n"), F.round(100 * F.count_if(_done()) / F.count("*"), 6).alias("completed"))


def sizes(log: DataFrame) -> DataFrame:
    kind = F.when(F.col("node_num") == 1, "single").when(F.col("node_num") <= 8, "small").when(F.col("node_num") <= 64, "medium").otherwise("large")
    return log.groupBy(kind.alias("size")).agg(F.count("*").alias("jobs"), F.round(F.sum(F.col("node_num") * F.col("duration")) / 3600, 6).alias("node_hours"))


def per_user(log: DataFrame) -> DataFrame:
    """Facts of each user. One pass."""
    return log.groupBy("user").agg(
        F.count("*").alias("jobs"), F.count_if(F.expr("gpu_num > 0")).alias("gpu_jobs"), F.count_if(_done()).alias("completed"), F.round(100 * F.count_if(_done()) / F.count("*"), 6).alias("completed_percent"),
        F.round(F.sum(F.col("gpu_num") * F.col("duration")) / 3600, 6).alias("gpu_hours"), F.round(F.sum(F.col("cpu_num") * F.col("duration")) / 3600, 6).alias("cpu_hours"),
        F.round(F.sum(F.greatest("queue", F.lit(0))) / 3600, 6).alias("pending_hours"), F.min("submit_time").alias("first"), F.max("submit_time").alias("last"),
    )


def per_user_quantiles(log: DataFrame) -> DataFrame:
    short = log.groupBy("user").agg(F.round(F.count_if(F.expr("duration <= 10")) / F.count("*"), 9).alias("short_share"), F.round(F.avg("duration"), 6).alias("mean"))
    return short.join(exact.wide_quantiles(log, ["user"], "duration", {"q25": 0.25, "median": 0.5, "q75": 0.75}), "user")


def type_preference(log: DataFrame) -> DataFrame:
    u = log.groupBy("user").agg(F.bool_or(F.col("gpu_num") > 0).alias("g"), F.bool_or(F.col("gpu_num") == 0).alias("c"))
    return u.groupBy(F.when(F.col("g") & F.col("c"), "mixed").when(F.col("g"), "gpu").otherwise("cpu").alias("kind")).agg(F.count("*").alias("users"))


def work_time(log: DataFrame) -> DataFrame:
    h = F.hour("submit_time")
    return log.groupBy("user").agg(F.round(100 * F.count_if((h >= 9) & (h <= 17)) / F.count("*"), 6).alias("work_hours"), F.round(100 * F.count_if(F.weekday("submit_time") < 5) / F.count("*"), 6).alias("weekdays"))


def pareto(log: DataFrame, width: float = 10.0) -> DataFrame:
    """Users by use, heaviest first, with running use and running share of users. GPU seconds are whole numbers."""
    use = log.groupBy("user").agg(F.sum(F.col("gpu_num") * F.col("duration")).alias("use"))
    b = -F.floor(F.log2(F.col("use") + 1) * width)
    run = exact.prefix_sums(use, b, [F.desc("use"), F.col("user")], {"running": F.col("use"), "place": F.lit(1).cast("long")})
    whole = use.agg(F.sum("use").alias("all_use"), F.count("*").alias("all_users"))
    total = whole.first()  # two numbers
    return run.select("user", "use", "place", "running", F.round(100 * F.col("running") / F.lit(total["all_use"]), 6).alias("use_percent"), F.round(100 * F.col("place") / F.lit(total["all_users"]), 6).alias("user_percent"))


def heavy(log: DataFrame, percent: float = 80.0) -> DataFrame:
    """Users in the prefix that holds at most ``percent`` of the use, with their jobs. All of them."""
    return pareto(log).where(F.col("use_percent") <= percent).join(log.groupBy("user").agg(F.count("*").alias("jobs")), "user").select("user", "use", "use_percent", "jobs")


def ecdf(log: DataFrame, value: str = "queue", width: int = 60) -> DataFrame:
    """Distinct values with the share of rows at or below them. Rows are counted per value, values are summed in buckets."""
    n = log.where(F.col(value) >= 0).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    all_ = n.agg(F.sum("n")).first()[0] or 0
    return exact.prefix_sums(n, F.floor(F.col("value") / width), [F.col("value")], {"upto": F.col("n")}).select("value", "upto", F.round(F.col("upto") / F.lit(max(all_, 1)), 9).alias("share"))


def gini(log: DataFrame, width: float = 10.0) -> DataFrame:
    """Gini coefficient of the users' GPU seconds, from places in ascending order."""
    use = log.groupBy("user").agg(F.sum(F.col("gpu_num") * F.col("duration")).alias("use"))
    placed = exact.prefix_sums(use, F.floor(F.log2(F.col("use") + 1) * width), [F.col("use"), F.col("user")], {"place": F.lit(1).cast("long")})
    s = placed.agg(F.count("*").alias("n"), F.sum("use").alias("s"), F.sum((F.col("place") * F.col("use")).cast("decimal(38,0)")).cast("double").alias("w"))
    g = 2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")
    return s.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), g)), 9).alias("gini"))


def recurrence(jobs: DataFrame) -> DataFrame:
    """Names submitted at least 2, 5, 10, 20, 50, 100 times, and their submissions."""
    n = jobs.where("job_name is not null").groupBy("job_name").agg(F.count("*").alias("n"))
    at = n.withColumn("times", F.explode(F.array(*[F.lit(x).cast("long") for x in (2, 5, 10, 20, 50, 100)]))).where("n >= times")
    return at.groupBy("times").agg(F.count("*").alias("names"), F.sum("n").alias("submissions"))


def recurrence_user(jobs: DataFrame) -> DataFrame:
    return jobs.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("jobs"), F.count_distinct("job_name").alias("names"), F.round(F.count_distinct("job_name") / F.count("*"), 9).alias("ratio"))


def recurrence_resources(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.concat_ws("_", "cpu_num", "gpu_num").alias("signature")).agg(F.count("*").alias("n"))


def duplicates(jobs: DataFrame) -> DataFrame:
    """Fingerprints of jobs (command, resources, queue, base name) that occur more than once, with their users."""
    name = C.base_name("job_name")
    mark = F.md5(F.concat_ws("|", F.coalesce("command", F.lit("")), F.col("cpu_num").cast("string"), F.col("gpu_num").cast("string"), "queue", name).cast("binary"))
    return jobs.groupBy(mark.alias("fingerprint")).agg(F.count("*").alias("jobs"), F.count_distinct("user_id").alias("users"), F.min("job_id").alias("example")).where("jobs > 1")


def across_users(jobs: DataFrame) -> DataFrame:
    """Fingerprints of more than one user, with the user who has most of their jobs (smaller name on a tie)."""
    mark = F.md5(F.concat_ws("|", F.coalesce("command", F.lit("")), F.col("cpu_num").cast("string"), "queue").cast("binary"))
    n = jobs.where("user_id is not null").groupBy(mark.alias("fingerprint"), "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("fingerprint").agg(F.count("*").alias("users"), F.sum("n").alias("jobs"), F.min_by("user_id", F.struct(-F.col("n"), F.col("user_id"))).alias("main_user")).where("users > 1")


def null_users(jobs: DataFrame) -> DataFrame:
    """Jobs without and with a user by queue: number, mean cores, GPU jobs."""
    return jobs.groupBy(F.col("user_id").isNull().alias("no_user"), "queue").agg(F.count("*").alias("jobs"), F.round(F.avg("cpu_num"), 6).alias("mean_cpus"), F.count_if(F.expr("gpu_num > 0")).alias("gpu_jobs"))


def shared_names(jobs: DataFrame) -> DataFrame:
    """Job names that occur both with and without a user."""
    return jobs.where("user_id is null").select("job_name").intersect(jobs.where("user_id is not null").select("job_name"))


def reconcile(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("jobs"), F.count("user_id").alias("with_user"), F.count_if(F.expr("user_id is null")).alias("without_user"), F.count_distinct("user_id").alias("users"))


def ranked(jobs: DataFrame, k: int = 20) -> DataFrame:
    """The k users with most jobs and their percentage of all."""
    n = jobs.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("jobs"))
    all_ = n.agg(F.sum("jobs")).first()[0] or 1
    top = n.orderBy(F.desc("jobs"), "user_id").limit(k)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("jobs"), "user_id")  # over k rows
    return top.select("user_id", "jobs", F.row_number().over(order).cast("long").alias("rank"), F.round(100 * F.col("jobs") / F.lit(all_), 6).alias("percent"))


def growth(orders: DataFrame) -> DataFrame:
    """Orders per month and their growth over the month before."""
    m = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    last = F.lag("n").over(Window.partitionBy(F.lit(1)).orderBy("month"))  # over months
    return m.select("month", "n", F.round(100 * (F.col("n") - last) / F.nullif(last, F.lit(0)), 6).alias("growth"))


def all_facts(jobs: DataFrame) -> DataFrame:
    """Twenty-six facts of each user, in one pass: jobs, queues, time, resources, waiting and states, over all, GPU and CPU jobs."""
    gpu, cpu, one = F.col("gpu_num") > 0, F.coalesce(F.col("gpu_num"), F.lit(0)) == 0, F.lit(True)
    d, q = F.greatest(C.seconds("start_time", "end_time"), F.lit(0)), F.greatest(C.seconds("submit_time", "start_time"), F.lit(0))
    state = C.state("job_status_str", "exit_status")
    whole = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    hours = lambda c, v: F.round(whole(c, v) / 3600, 6)
    percent = lambda c, s: F.round(100 * F.count_if(c & (state == s)) / F.nullif(F.count_if(c), F.lit(0)), 6)
    kinds = {"": one, "gpu_": gpu, "cpu_": cpu}
    facts = {f"{k}jobs": F.count_if(c) for k, c in kinds.items()}
    facts |= {"queues": F.count_distinct("queue"), "names": F.count_distinct("job_name")}
    facts |= {f"{k}hours": hours(c, d) for k, c in kinds.items()} | {"gpu_time": hours(gpu, d * F.col("gpu_num")), "cpu_time": hours(one, d * F.col("cpu_num"))}
    facts |= {f"{k}pending": hours(c, q) for k, c in kinds.items()} | {"max_gpus": F.max("gpu_num"), "max_cpus": F.max("cpu_num")}
    facts |= {f"{k}{s.lower()}": percent(c, s) for k, c in kinds.items() for s in ("COMPLETED", "FAILED", "CANCELLED")}
    facts |= {"first": F.min("submit_time"), "last": F.max("submit_time")}
    return jobs.where("user_id is not null").groupBy("user_id").agg(*[c.alias(k) for k, c in facts.items()])


MEASURES = ("duration", "queue", "gpu_num", "cpu_num", "node_num")


def aggregates(log: DataFrame) -> DataFrame:
    """Per user sum, mean, largest and median of five measures, and the percentage of completed jobs of all, GPU and CPU jobs.

    All medians come from one radix selection over (user, measure).
    """
    done = lambda c: F.round(100 * F.count_if(c & _done()) / F.nullif(F.count_if(c), F.lit(0)), 6)
    gpu = F.col("gpu_num") > 0
    sums = log.groupBy("user").agg(*[x for m in MEASURES for x in (F.sum(m).alias(f"sum_{m}"), F.round(F.sum(m) / F.count(m), 6).alias(f"mean_{m}"), F.max(m).alias(f"max_{m}"))], done(F.lit(True)).alias("done"), done(gpu).alias("gpu_done"), done(~gpu).alias("cpu_done"))
    long = log.select("user", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("long").alias("v")) for m in MEASURES])).alias("c")).select("user", "c.m", "c.v")
    q = exact.quantiles(long, ["user", "m"], "v", [0.5]).groupBy("user").agg(*[F.round(F.max(F.when(F.col("m") == m, F.col("q"))), 6).alias(f"median_{m}") for m in MEASURES])
    return sums.join(q, "user")


def metrics(log: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per user: jobs by type, state and subcluster (as ``name:number`` lists in order), node hours, mean waiting, percentage completed.

    ``hosts`` has (job_id, subcluster). Counts are made per (user, kind, name) first; a list has one entry a name.
    """
    named = log.select("user", F.explode(F.array(F.struct(F.lit("types").alias("kind"), C.job_type("gpu_num").alias("name")), F.struct(F.lit("states").alias("kind"), F.col("state").alias("name")))).alias("c")).select("user", "c.*")
    placed = log.select("user", "job_id").join(hosts, "job_id").select("user", F.lit("subclusters").alias("kind"), F.col("subcluster").alias("name"))
    n = named.unionByName(placed).groupBy("user", "kind", "name").agg(F.count("*").alias("n"))
    entry = F.struct("name", F.concat("name", F.lit(":"), F.col("n").cast("string")).alias("t"))
    lists = n.groupBy("user").agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))), lambda e: e["t"]), ",").alias(k) for k in ("types", "states", "subclusters")])
    sums = log.groupBy("user").agg(F.round(F.sum(F.col("node_num") * F.col("duration")) / 3600, 6).alias("node_hours"), F.round(F.sum("queue") / F.count("queue"), 6).alias("mean_queue"), F.round(100 * F.count_if(_done()) / F.count("*"), 6).alias("completed"))
    return lists.join(sums, "user")
