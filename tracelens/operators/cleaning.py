"""Cleaning: required fields, time repair, states, missing users, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import rules, scan

TIMES = ("submit_time", "start_time", "end_time")
# Importance of a field, 1 to 5.
IMPORTANCE = {"job_id": 5, "user_id": 5, "submit_time": 5, "start_time": 4, "end_time": 4, "exec_hosts": 3, "job_status_str": 3, "command": 2, "gpu_num": 3, "cpu_num": 3}


def required(jobs: DataFrame) -> DataFrame:
    """Rows with job, user and submission, and no duration of 0 or less."""
    d = C.seconds("start_time", "end_time")
    return jobs.where(F.col("job_id").isNotNull() & F.col("user_id").isNotNull() & F.col("submit_time").isNotNull() & (d.isNull() | (d > 0)))


def without_clusters(jobs: DataFrame, excluded: list[str]) -> DataFrame:
    """Rows of other clusters; a null cluster stays."""
    return jobs.where(F.col("cluster_name").isNull() | ~F.col("cluster_name").isin(*excluded))


def time_flags(jobs: DataFrame) -> DataFrame:
    """Missing times, and times out of order (comparisons with null are false)."""
    wrong = F.coalesce(F.col("submit_time") > F.col("start_time"), F.lit(False)) | F.coalesce(F.col("start_time") > F.col("end_time"), F.lit(False)) | F.coalesce(F.col("submit_time") > F.col("end_time"), F.lit(False))
    return jobs.select("job_id", *[F.col(t).isNull().alias(f"no_{t}") for t in TIMES], wrong.alias("out_of_order"))


def repair(jobs: DataFrame, before: int = 300, least: int = 10) -> DataFrame:
    """Repaired times.

    A missing submission becomes the user's last known one plus the user's mean interval, where the user has ``least`` known ones;
    one still missing becomes the start less ``before`` seconds. Intervals telescope, so that their mean comes from each
    user's first, last and number: no window over a user's rows. Only rows that lack a submission and have a user meet the
    users' guesses; the others are not shuffled, so null users are no hot key.
    """
    known = jobs.where("user_id is not null and submit_time is not null").groupBy("user_id").agg(F.min("submit_time").alias("a"), F.max("submit_time").alias("z"), F.count("*").alias("n")).where(F.col("n") >= least)
    mean = F.floor(C.seconds("a", "z") / (F.col("n") - 1))
    guess = known.select("user_id", (F.col("z") + F.make_dt_interval(secs=mean)).alias("guess"))
    submit = F.coalesce("submit_time", "guess", F.col("start_time") - F.make_dt_interval(secs=F.lit(before)))
    how = F.when(F.col("submit_time").isNotNull(), "known").when(F.col("guess").isNotNull(), "user").when(F.col("start_time").isNotNull(), "start").otherwise("none")
    asks = F.col("submit_time").isNull() & F.col("user_id").isNotNull()
    rows = jobs.where(asks).join(guess, "user_id", "left").unionByName(jobs.where(~asks).withColumn("guess", F.lit(None).cast(guess.schema["guess"].dataType)))
    return rows.select("job_id", submit.alias("submit_time"), how.alias("how"), "start_time", "end_time")


def usable(jobs: DataFrame) -> DataFrame:
    """Each row with its class: usable, unrecoverable (start or end missing) or out of order."""
    f = time_flags(jobs)
    return f.select("job_id", F.when(F.col("no_start_time") | F.col("no_end_time"), "unrecoverable").when(F.col("out_of_order"), "out_of_order").otherwise("usable").alias("part"))


def elapsed(jobs: DataFrame, most_hours: int = 8760) -> DataFrame:
    """Duration and queue in seconds, minutes and hours, negative ones as 0, with a flag for those above ``most_hours`` (kept)."""
    d, q = C.seconds("start_time", "end_time"), C.seconds("submit_time", "start_time")
    return jobs.select("job_id", d.alias("raw"), F.greatest(d, F.lit(0)).alias("seconds"), F.round(F.greatest(d, F.lit(0)) / 60, 6).alias("minutes"), F.round(F.greatest(d, F.lit(0)) / 3600, 6).alias("hours"), F.greatest(q, F.lit(0)).alias("queue"), F.coalesce(d > most_hours * 3600, F.lit(False)).alias("too_long"))


def user_or_unknown(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", F.coalesce("user_id", F.lit("unknown_user")).alias("user"))


def missing(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls and their ratio. One aggregate over all rows."""
    sums = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("nulls")) for c in df.columns]))
    return sums.select("_n", rows.alias("r")).select("r.name", F.col("_n").alias("n"), "r.nulls", F.round(F.col("r.nulls") / F.col("_n"), 9).alias("ratio"))


def missing_patterns(df: DataFrame) -> DataFrame:
    """Per column the class of its null ratio."""
    r = F.col("nulls") / F.col("n")
    kind = F.when(r == 1, "all").when(r == 0, "none").when(r > 0.5, "high").when(r >= 0.1, "medium").otherwise("low")
    return missing(df).select("name", kind.alias("pattern"))


def missing_together(jobs: DataFrame) -> DataFrame:
    """Rows that lack two times at once, or all of them."""
    pairs = [("submit_time", "start_time"), ("start_time", "end_time"), ("submit_time", "end_time")]
    return jobs.agg(*[F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias(f"{a}_{b}") for a, b in pairs], F.count_if(F.col(TIMES[0]).isNull() & F.col(TIMES[1]).isNull() & F.col(TIMES[2]).isNull()).alias("all_times"))


def field_scores(df: DataFrame) -> DataFrame:
    """Per weighted field: presence, importance and their product."""
    m = missing(df.select(*IMPORTANCE))
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in IMPORTANCE.items() for x in (k, v)]), F.col("name"))
    here = 1 - F.col("nulls") / F.col("n")
    weight = F.least(F.lit(1.0), w / 5 + 0.3 * here)
    return m.select("name", F.round(here, 6).alias("present"), F.round(weight, 6).alias("importance"), F.round(here * weight, 6).alias("score"))


def quality_grade(df: DataFrame) -> DataFrame:
    """Weighted presence of all fields and its grade."""
    s = missing(df.select(*IMPORTANCE))
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in IMPORTANCE.items() for x in (k, v)]), F.col("name"))
    all_ = s.select((w * (1 - F.col("nulls") / F.col("n"))).alias("a"), w.alias("w")).agg((F.sum("a") / F.sum("w")).alias("x"))
    return all_.select(F.round("x", 6).alias("score"), F.when(F.col("x") >= 0.9, "A").when(F.col("x") >= 0.8, "B").when(F.col("x") >= 0.7, "C").when(F.col("x") >= 0.6, "D").otherwise("F").alias("grade"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k most frequent values of each column; ties to the smaller value. Ranked inside salts first, then among survivors."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select("r.*").where("value is not null")
    n = rows.groupBy("name", "value").agg(F.count("*").alias("n")).withColumn("_s", F.pmod(F.xxhash64("value"), F.lit(64)))
    order = [F.desc("n"), F.col("value")]
    first = n.withColumn("_r", F.row_number().over(Window.partitionBy("name", "_s").orderBy(*order))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*order)).cast("long")).where(F.col("rank") <= k).select("name", "rank", "value", "n")


def word_counts(jobs: DataFrame, least: int = 5) -> DataFrame:
    """Words of commands with their number, those of ``least`` or more."""
    w = jobs.select(F.explode(F.regexp_extract_all(F.lower("command"), F.lit(r"([a-z0-9_-]{3,})"), F.lit(1))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def majority(jobs: DataFrame) -> DataFrame:
    """Per cluster the most frequent generation (smaller name on a tie), and how many rows disagree."""
    n = rules.generations(jobs).groupBy("cluster_name", "generation").agg(F.count("*").alias("n"))
    best = n.groupBy("cluster_name").agg(F.min_by("generation", F.struct(-F.col("n"), F.col("generation"))).alias("generation"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return best.select("cluster_name", "generation", "n", (F.col("n") - F.col("most")).alias("others"))


def by_sequence(jobs: DataFrame, width: int = 1000) -> DataFrame:
    """Missing submissions between two known ones, interpolated along the job id.

    The known neighbours on both sides are carried along the ids: inside buckets of ``width`` ids, and over a tree of the buckets.
    """
    x = jobs.select("job_id", F.unix_seconds(F.col("submit_time").cast("timestamp")).alias("s"))
    bucket, there = F.floor(F.col("job_id") / width), F.col("s").isNotNull()
    x = scan.known(x, [], bucket, ["job_id"], {"pj": F.col("job_id"), "ps": F.col("s")}, there)
    x = scan.known(x, [], bucket, ["job_id"], {"nj": F.col("job_id"), "ns": F.col("s")}, there, after=True)
    at = F.col("ps") + F.floor((F.col("ns") - F.col("ps")) * (F.col("job_id") - F.col("pj")) / (F.col("nj") - F.col("pj")))
    return x.where("s is null and pj is not null and nj is not null").select("job_id", F.timestamp_seconds(at).cast("timestamp_ntz").alias("submit_time"))
