"""Daily anomaly levels, exact sampling, duplicates on a day, comparison of two traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import exact
from tracelens.operators import traces


def daily_levels(jobs: DataFrame, extreme: int = 1000, severe: int = 400, moderate: int = 340) -> DataFrame:
    """Submissions per day and the day's level. Thresholds are one row of statistics over the days."""
    d = jobs.where("submit_time is not null").groupBy(F.to_date("submit_time").alias("day")).agg(F.count("*").alias("n"))
    s = d.agg(F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("n").alias("m"), F.stddev_samp("n").alias("sd")).first()  # days, not jobs
    if s["q"] is None:
        return d.withColumn("level", F.lit("normal"))
    sd = s["sd"] or 0.0
    top = max(extreme, 10 * s["q"][1], s["m"] + 5 * sd)
    high = max(severe, s["q"][1] + 3 * (s["q"][2] - s["q"][0]), s["m"] + 3 * sd)
    return d.withColumn("level", F.when(F.col("n") >= top, "extreme").when(F.col("n") >= high, "severe").when(F.col("n") >= moderate, "moderate").otherwise("normal"))


def _hashed(jobs: DataFrame, seed: str) -> DataFrame:
    return jobs.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col("job_id").cast("string")).cast("binary")))


def stratified(jobs: DataFrame, by: str, ratio: float, seed: str = "s1-") -> DataFrame:
    """Exactly max(1, floor(ratio * size)) rows of every stratum, by hash order. Rows without a stratum form one of their own."""
    x = _hashed(jobs, seed).withColumn("_k", F.coalesce(F.col(by).cast("string"), F.lit("")))
    return exact.rank_select(x, ["_k"], "_h", "job_id", F.greatest(F.lit(1), F.floor(F.lit(ratio) * F.col("_size")))).drop("_h", "_k")


def random_rows(jobs: DataFrame, n: int, seed: str = "r1-") -> DataFrame:
    """Exactly n rows, by hash order."""
    return exact.rank_select(_hashed(jobs, seed).withColumn("_k", F.lit(1)), ["_k"], "_h", "job_id", F.lit(n)).drop("_h", "_k")


def errors_thinned(jobs: DataFrame, ratio: float = 0.5, seed: str = "e1-") -> DataFrame:
    """All rows that ended well and floor(ratio * n) of the others."""
    bad = _hashed(jobs.where("exit_status <> 0"), seed).withColumn("_k", F.lit(1))
    return jobs.where("exit_status = 0").unionByName(exact.rank_select(bad, ["_k"], "_h", "job_id", F.floor(F.lit(ratio) * F.col("_size"))).drop("_h", "_k"))


def systematic(jobs: DataFrame, step: int = 10, width: int = 1000) -> DataFrame:
    """Every step-th row by id."""
    placed = exact.prefix_sums(jobs, F.floor(F.col("job_id") / width), [F.col("job_id")], {"place": F.lit(1).cast("long")})
    return placed.where(F.col("place") % step == 1).drop("place")


def compare_days(jobs: DataFrame, sampled: DataFrame) -> DataFrame:
    """Rows per day before and after, and the rate kept."""
    day = F.to_date("submit_time").alias("day")
    a = jobs.where("submit_time is not null").groupBy(day).agg(F.count("*").alias("n"))
    b = sampled.where("submit_time is not null").groupBy(day).agg(F.count("*").alias("kept"))
    return a.join(b, "day", "left").select("day", "n", F.coalesce("kept", F.lit(0)).alias("kept"), F.round(F.coalesce("kept", F.lit(0)) / F.col("n"), 9).alias("rate"))


def missing_hours(jobs: DataFrame) -> DataFrame:
    """Hours of the day in which a user never submits, by user: one anti-join by (user, hour)."""
    users = jobs.where("user_id is not null").select("user_id").distinct()
    grid = users.withColumn("hour", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return grid.join(jobs.where("submit_time is not null").select("user_id", F.hour("submit_time").cast("long").alias("hour")).distinct(), ["user_id", "hour"], "left_anti")


def repeated(jobs: DataFrame, more_than: int = 3) -> DataFrame:
    """Same user and resources more than so often on one day."""
    return jobs.where("user_id is not null and submit_time is not null").groupBy(F.to_date("submit_time").alias("day"), "user_id", "gpu_num", "cpu_num").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def peak_day(jobs: DataFrame) -> DataFrame:
    """The rows of the day with most submissions (the earlier on a tie)."""
    d = jobs.where("submit_time is not null").withColumn("day", F.to_date("submit_time"))
    best = d.groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1).select("day")
    return d.join(best, "day").select("job_id", "day", "user_id", "submit_time")


def busiest_day_users(log: DataFrame) -> DataFrame:
    """Per user of the day with most submissions: jobs, durations, resources, first and last submission and the hours between."""
    d = log.where("submit_time is not null").withColumn("day", F.to_date("submit_time"))
    best = d.groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1).select("day")
    x = d.join(best, "day")
    mean = lambda c: F.round(F.sum(c) / F.count(c), 6)
    got = x.groupBy("day", "user").agg(
        F.count("*").alias("n"), mean("duration").alias("mean"), F.round(F.stddev_samp("duration"), 4).alias("std"), F.min("duration").alias("least"), F.max("duration").alias("most"),
        mean("gpu_num").alias("mean_gpus"), F.sum("gpu_num").alias("gpus"), mean("cpu_num").alias("mean_cpus"), F.sum("cpu_num").alias("cpus"), F.min("submit_time").alias("first"), F.max("submit_time").alias("last"),
        F.round(F.timestamp_diff("SECOND", F.min("submit_time"), F.max("submit_time")) / 3600, 6).alias("span_hours"),
    )
    return got.join(exact.wide_quantiles(x, ["user"], "duration", {"median": 0.5}), "user")


def busy_minutes(jobs: DataFrame, more_than: int = 2) -> DataFrame:
    minute = F.date_trunc("minute", F.col("submit_time")).cast("timestamp_ntz")
    return jobs.where("submit_time is not null").groupBy(minute.alias("minute")).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def short_jobs(log: DataFrame, seconds: int = 600) -> DataFrame:
    return log.groupBy("user").agg(F.count_if(F.col("duration") < seconds).alias("short"), F.round(F.count_if(F.col("duration") < seconds) / F.count("*"), 9).alias("share")).where("short > 0")


def user_scores(jobs: DataFrame, least: int = 100, burst: int = 100, many: int = 1000, very_many: int = 10_000) -> DataFrame:
    """Suspicious users among those with more than ``least`` jobs, with their scores and reasons.

    More than ``burst`` jobs in a minute: 3. Names fewer than a tenth of the jobs: 2. Durations that vary by less than a tenth of their mean over more
    than ``many`` jobs: 2. More than ``very_many`` jobs: 3. Users of 3 and more are kept. Minutes are counted before users, so that no task holds a user's jobs.
    """
    known = jobs.where("user_id is not null")
    per = known.where("submit_time is not null").groupBy("user_id", F.date_trunc("minute", F.col("submit_time")).alias("m")).agg(F.count("*").alias("n"))
    most = per.groupBy("user_id").agg(F.max("n").alias("burst"))
    d = C.seconds("start_time", "end_time")
    u = known.groupBy("user_id").agg(F.count("*").alias("jobs"), F.count_distinct("job_name").alias("names"), F.stddev_samp(d).alias("s"), F.avg(d).alias("a")).where(F.col("jobs") > least).join(most, "user_id", "left")
    u = u.withColumn("cv", F.when(F.col("a") > 0, F.round(F.col("s") / F.col("a"), 6)))
    rules = [
        ("burst", F.coalesce(F.col("burst") > burst, F.lit(False)), 3),
        ("few names", F.col("names") / F.col("jobs") < 0.1, 2),
        ("even durations", F.coalesce(F.col("cv") < 0.1, F.lit(False)) & (F.col("jobs") > many), 2),
        ("very many jobs", F.col("jobs") > very_many, 3),
    ]
    score = sum((F.when(c, w).otherwise(0) for _, c, w in rules[1:]), F.when(rules[0][1], rules[0][2]).otherwise(0)).cast("long")
    x = u.withColumn("score", score).where("score >= 3")
    return x.select("user_id", "jobs", "names", "burst", "cv", "score", F.concat_ws(",", *[F.when(c, name) for name, c, _ in rules]).alias("reasons"))


def datasets(log: DataFrame) -> DataFrame:
    """Two halves of the log (by job id) as two traces: size, users, mean duration, GPU hours."""
    return log.groupBy(F.when(F.col("job_id") % 2 == 0, "local").otherwise("external").alias("dataset")).agg(
        F.count("*").alias("jobs"), F.count_distinct("user").alias("users"), F.round(F.avg("duration"), 6).alias("mean_duration"), F.max("gpu_num").alias("max_gpus"), F.round(F.sum(F.col("gpu_num") * F.col("duration")) / 3600, 6).alias("gpu_hours")
    )


def state_time(log: DataFrame) -> DataFrame:
    """Percentage of GPU seconds by state, for both traces."""
    g = log.where("gpu_num > 0").withColumn("dataset", F.when(F.col("job_id") % 2 == 0, "local").otherwise("external")).withColumn("w", F.col("gpu_num") * F.col("duration"))
    share = lambda s: F.round(100 * F.sum(F.when(F.col("state") == s, F.col("w")).otherwise(0)) / F.sum("w"), 6)
    return g.groupBy("dataset").agg(share("COMPLETED").alias("completed"), share("FAILED").alias("failed"), share("CANCELLED").alias("cancelled"))


def durations(log: DataFrame) -> DataFrame:
    """Duration curve of both traces."""
    parts = [traces.curve(log.where(c), "duration", F.lit(1), traces.DURATION_BREAKS).withColumn("dataset", F.lit(k)) for k, c in (("local", "job_id % 2 = 0"), ("external", "job_id % 2 <> 0"))]
    return parts[0].unionByName(parts[1])


def duration_quantiles(log: DataFrame) -> DataFrame:
    x = log.withColumn("dataset", F.when(F.col("job_id") % 2 == 0, "local").otherwise("external"))
    return exact.wide_quantiles(x, ["dataset"], "duration", {"median": 0.5, "p95": 0.95})


def host_counts(jobs: DataFrame) -> DataFrame:
    """Hosts of each job: number, CPU and GPU hosts, kind."""
    h = C.hosts("exec_hosts")
    x = jobs.select("job_id", h.alias("hosts"))
    gpu, cpu = F.size(F.filter("hosts", lambda a: a.startswith("gpu"))), F.size(F.filter("hosts", lambda a: a.startswith("cpu")))
    kind = F.when((gpu > 0) & (cpu > 0), "mixed").when(gpu > 0, "gpu").when(cpu > 0, "cpu").otherwise("unknown")
    return x.select("job_id", F.coalesce(F.size("hosts"), F.lit(0)).cast("long").alias("hosts"), F.coalesce(cpu, F.lit(0)).cast("long").alias("cpu_hosts"), F.coalesce(gpu, F.lit(0)).cast("long").alias("gpu_hosts"), kind.alias("kind"))


def subcluster_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs and hosts per subcluster."""
    h = jobs.select("job_id", F.explode(C.hosts("exec_hosts")).alias("host"))
    return h.groupBy(C.subcluster(F.col("host")).alias("subcluster")).agg(F.count_distinct("job_id").alias("jobs"), F.count("*").alias("hosts"))


def primary_subcluster(jobs: DataFrame) -> DataFrame:
    """Per job the subcluster with most hosts (smaller name on a tie)."""
    h = jobs.select("job_id", F.explode(C.hosts("exec_hosts")).alias("host")).groupBy("job_id", C.subcluster(F.col("host")).alias("s")).agg(F.count("*").alias("n"))
    return h.groupBy("job_id").agg(F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("subcluster"), F.max("n").alias("hosts"))
