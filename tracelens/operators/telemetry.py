"""Telemetry: deduplication, resampling, profiles, islands above a threshold, boxes and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import exact, scan


def readings(raw: DataFrame) -> DataFrame:
    """One reading for each server, metric and time (the smallest value of several), nulls left out."""
    return raw.where("server is not null and metric is not null and ts is not null and value is not null").groupBy("server", "metric", "ts").agg(F.min("value").alias("value"))


def group(server: str = "server") -> Column:
    return C.subcluster(F.col(server))


def resample(t: DataFrame, every: str) -> DataFrame:
    """Mean per metric and hour, day, week (labelled by its Sunday) or month (labelled by its last day)."""
    at = F.date_trunc(every, F.col("ts"))
    label = {"week": F.date_add(at.cast("date"), 6), "month": F.last_day(at.cast("date"))}.get(every, at.cast("timestamp_ntz")).cast("timestamp_ntz")
    return t.groupBy("metric", label.alias("at")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


def by_weekday(t: DataFrame) -> DataFrame:
    """Mean by metric and weekday; all seven days, null where there is no reading."""
    days = t.select("metric").distinct().withColumn("weekday", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    return days.join(t.groupBy("metric", F.weekday("ts").cast("long").alias("weekday")).agg(exact.exact_mean(F.col("value")).alias("mean")), ["metric", "weekday"], "left")


def hour_profile(t: DataFrame) -> DataFrame:
    return t.groupBy("metric", F.hour("ts").cast("long").alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("std"))


def heatmap(t: DataFrame) -> DataFrame:
    """Mean by weekday and hour of day, a row a weekday, a column an hour."""
    cells = [F.round(F.avg(F.when(F.hour("ts") == h, F.col("value"))), 6).alias(f"h{h}") for h in range(24)]
    return t.groupBy(F.weekday("ts").cast("long").alias("weekday")).agg(*cells)


def group_stats(t: DataFrame) -> DataFrame:
    """Per subcluster and metric: mean, median, population deviation, extremes, servers."""
    g = t.withColumn("grp", group())
    sums = g.groupBy("grp", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("server").alias("servers"))
    return sums.join(exact.wide_quantiles(g, ["grp", "metric"], "value", {"median": 0.5}), ["grp", "metric"])


def server_stats(t: DataFrame) -> DataFrame:
    sums = t.groupBy("server", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count("*").alias("n"))
    return sums.join(exact.wide_quantiles(t, ["server", "metric"], "value", {"median": 0.5}), ["server", "metric"])


def above(t: DataFrame, thresholds: tuple[float, ...] = (60.0, 80.0, 90.0)) -> DataFrame:
    return t.groupBy("metric").agg(F.count("*").alias("n"), *[F.count_if(F.col("value") > x).alias(f"above_{int(x)}") for x in thresholds])


def utilisation_class(t: DataFrame, high: float = 60.0, low: float = 40.0) -> DataFrame:
    """Servers per subcluster whose mean is high, low or between."""
    s = t.withColumn("grp", group()).groupBy("grp", "server").agg(F.avg("value").alias("m"))
    return s.groupBy("grp").agg(F.count_if(F.col("m") > high).alias("high"), F.count_if(F.col("m") < low).alias("low"), F.count_if((F.col("m") >= low) & (F.col("m") <= high)).alias("balanced"))


def power_bands(t: DataFrame, bands: tuple[float, ...] = (25.0, 50.0, 75.0)) -> DataFrame:
    p = t.where(F.col("metric") == "power")
    v = F.col("value")
    lows = [None, *bands]
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 9)
    parts = [share((v < b) if a is None else (v >= a) & (v < b)).alias(f"below_{int(b)}") for a, b in zip(lows, bands, strict=False)] + [share(v >= bands[-1]).alias("rest")]
    sums = p.groupBy("metric").agg(*parts)
    return sums.join(exact.wide_quantiles(p, ["metric"], "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}), "metric")


def clipped(t: DataFrame, most: float = 200.0, share: float = 0.99) -> DataFrame:
    """Daily series of each metric: mean of the readings clipped at ``most``, mean without those above the metric's ``share`` quantile, and how many those are.

    The quantile comes from radix selection over all readings.
    """
    q = exact.quantiles(t, ["metric"], "value", [share]).select("metric", F.col("q").alias("limit"))
    x = t.join(q, "metric").withColumn("over", F.col("value") > F.col("limit"))
    return x.groupBy("metric", F.to_date("ts").alias("day")).agg(
        exact.exact_mean(F.least("value", F.lit(most))).alias("clipped"), exact.exact_mean(F.when(~F.col("over"), F.col("value"))).alias("without"), F.count_if("over").alias("n_over"), F.count("*").alias("n"), F.round(F.max("limit"), 6).alias("p99")
    )


def report(t: DataFrame, thresholds: tuple[float, ...] = (80.0, 90.0)) -> DataFrame:
    """Per metric: mean, extremes, median and 95 % quantile, busiest hour and weekday, share above thresholds, busiest and idlest server."""
    sums = t.groupBy("metric").agg(
        F.count("*").alias("n"), exact.exact_mean(F.col("value")).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("server").alias("servers"),
        *[F.round(F.count_if(F.col("value") > x) / F.count("*"), 9).alias(f"above_{int(x)}") for x in thresholds],
    )
    out = sums.join(exact.wide_quantiles(t, ["metric"], "value", {"median": 0.5, "p95": 0.95}), "metric")
    for name, by, low in (("hour", F.hour("ts").cast("long"), False), ("weekday", F.weekday("ts").cast("long"), False), ("server", F.col("server"), True)):
        m = t.groupBy("metric", by.alias("k")).agg(exact.exact_mean(F.col("value")).alias("m"))
        ends = [F.min_by("k", F.struct(-F.col("m"), F.col("k"))).alias(f"top_{name}"), F.max("m").alias(f"top_{name}_mean")]
        ends += [F.min_by("k", F.struct("m", "k")).alias(f"low_{name}")] if low else []
        out = out.join(m.groupBy("metric").agg(*ends), "metric")
    return out


def boxes(t: DataFrame) -> DataFrame:
    """Box of each metric: quartiles, whiskers within 1.5 interquartile ranges, number of readings outside."""
    q = exact.quantiles(t, ["metric"], "value", [0.25, 0.5, 0.75]).groupBy("metric").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(k) for k, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    got = t.join(q, "metric").groupBy("metric", "q1", "q2", "q3").agg(F.min(F.when(inside, F.col("value"))).alias("low"), F.max(F.when(inside, F.col("value"))).alias("high"), F.count_if(~inside).alias("outside"))
    return got.select("metric", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")], "low", "high", "outside")


def top_anomalies(t: DataFrame, k: int = 20, iqrs: float = 0.5) -> DataFrame:
    """The k highest readings of each metric above the third quartile and ``iqrs`` ranges; ranked inside salts, then among survivors."""
    q = exact.quantiles(t, ["metric"], "value", [0.25, 0.75]).groupBy("metric").agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"), F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    over = t.join(q, "metric").where(F.col("value") > F.col("q3") + iqrs * (F.col("q3") - F.col("q1"))).drop("q1", "q3")
    order = [F.desc("value"), F.col("server"), F.col("ts")]
    first = over.withColumn("_s", F.pmod(F.xxhash64("server", "ts"), F.lit(64))).withColumn("_r", F.row_number().over(Window.partitionBy("metric", "_s").orderBy(*order))).where(F.col("_r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(*order)).cast("long")).where(F.col("rank") <= k).select("metric", "rank", "server", "ts", "value")


def envelope(t: DataFrame) -> DataFrame:
    return t.groupBy(group().alias("grp"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("server").alias("servers"))


def islands(t: DataFrame, threshold: float = 60.0, gap_hours: int = 12, least_hours: int = 1) -> DataFrame:
    """Periods of readings above the threshold with no gap of more than ``gap_hours`` between them, of ``least_hours`` or more.

    The reading before and the number of islands begun are carried over a server's hours, so that no task holds its history.
    """
    order = ["ts", "metric"]
    high = scan.beside(t.where(F.col("value") > threshold), ["server"], C.hour_number("ts"), order, {"_last": F.col("ts")})
    new = F.coalesce((F.timestamp_diff("SECOND", F.col("_last"), F.col("ts")) > gap_hours * 3600).cast("long"), F.lit(1))
    numbered = scan.running_sums(high, ["server"], C.hour_number("ts"), order, {"island": new})
    got = numbered.groupBy("server", "island").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), exact.exact_mean(F.col("value")).alias("mean"), F.max("value").alias("most"))
    return got.where(F.timestamp_diff("SECOND", F.col("first"), F.col("last")) >= least_hours * 3600).drop("island")


def differences(t: DataFrame) -> DataFrame:
    """Each reading's change from the one before of its server and metric; null for the first."""
    x = scan.beside(t, ["server", "metric"], C.hour_number("ts"), ["ts"], {"_before": F.col("value")})
    return x.select("server", "metric", "ts", F.round(F.col("value") - F.col("_before"), 9).alias("d"))


def changes(t: DataFrame) -> DataFrame:
    """Changes to a server's next reading of a metric, in five bins per metric."""
    x = scan.beside(t, ["server", "metric"], C.hour_number("ts"), ["ts"], {"_next": F.col("value")}, after=True)
    d = x.withColumn("d", F.col("_next") - F.col("value")).where("d is not null")
    kind = F.when(F.col("d") <= -20, "much lower").when(F.col("d") <= -5, "lower").when(F.col("d") <= 5, "same").when(F.col("d") <= 20, "higher").otherwise("much higher")
    return d.groupBy("metric", kind.alias("change")).agg(F.count("*").alias("n"))


def idle_inverted(t: DataFrame) -> DataFrame:
    return t.where(F.col("metric") == "cpu_total").select("server", "ts", F.round(100 - F.col("value"), 9).alias("used"))


def wide(t: DataFrame, metrics: tuple[str, ...] = ("cpu_total", "gpu_util", "power", "load_1min", "mem_percent")) -> DataFrame:
    """One row a server and hour, one column a metric."""
    means = [exact.exact_mean(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return t.groupBy("server", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(*means)


def busiest(t: DataFrame, k: int = 5) -> DataFrame:
    return t.groupBy("server").agg(F.round(F.avg("value"), 6).alias("mean")).orderBy(F.desc("mean"), "server").limit(k)


def instance_usage(t: DataFrame) -> DataFrame:
    return t.groupBy("server", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("peak"), F.round(F.avg("value") / F.nullif(F.max("value"), F.lit(0.0)), 6).alias("mean_to_peak"))


def consistency(t: DataFrame) -> DataFrame:
    return t.groupBy("metric").agg(F.count_distinct("server").alias("servers"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


# Jobs and telemetry


def job_hosts(jobs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each job and host, with the job's columns ``keep``."""
    return jobs.select("job_id", "gpu_num", "start_time", "end_time", *[F.col(c).alias(f"_{c}") for c in keep], F.explode(C.hosts("exec_hosts")).alias("server"))


#: Readings of a job's hours.
READ = ("cpu_total", "gpu_util", "load_1min", "power")


def job_days(jobs: DataFrame, t: DataFrame, keep: tuple[str, ...] = (), read: tuple[str, ...] = READ, unknown: bool = False) -> DataFrame:
    """Days of each job on each host, with the job's columns ``keep``: (job_id, server, day, all_null, hours); ``hours`` is an array of ``h`` and ``read``.

    A row holds no more than a day, and rows are hours only after the join, so what is shuffled does not grow with the hours of a job. Jobs are
    merged with the readings of (server, day): Spark takes the size of exploded rows for that of the rows before, and would send them to the driver
    to broadcast them. An hour without readings on a known server is left out; with ``unknown``, the hours on unknown servers are kept with nulls.
    The list of known servers, one row each, is broadcast.
    """
    h = job_hosts(jobs, keep).where("start_time is not null and end_time is not null and start_time < end_time")
    days = h.withColumn("day", F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time"))))
    first = F.when(F.to_date("start_time") == F.col("day"), F.hour("start_time")).otherwise(0)
    # The last hour begins before the end: an end at a full hour does not count that hour.
    last = F.when(F.to_date("end_time") == F.col("day"), F.hour("end_time") - (F.date_trunc("hour", "end_time").cast("timestamp_ntz") == F.col("end_time")).cast("int")).otherwise(23)
    kept = [f"_{c}" for c in keep]
    spans = days.select("job_id", "server", "day", *kept, first.alias("first"), last.alias("last")).where("first <= last")
    hour = F.struct(F.hour("hour").alias("h"), *read)
    of_day = wide(t).groupBy("server", F.to_date("hour").alias("day")).agg(F.collect_list(hour).alias("hours")).hint("merge")
    known = F.broadcast(t.select("server").distinct().withColumn("known", F.lit(True)))
    met = spans.join(known, "server", "left" if unknown else "inner").join(of_day, ["server", "day"], "left" if unknown else "inner")
    hours = F.filter("hours", lambda x: x["h"].between(F.col("first"), F.col("last")))
    if unknown:
        none = F.transform(F.sequence("first", "last"), lambda i: F.struct(i.alias("h"), *[F.lit(None).cast("double").alias(c) for c in read]))
        hours = F.when(F.col("known").isNull(), none).otherwise(hours)
    got = met.select("job_id", "server", "day", F.col("known").isNull().alias("all_null"), hours.alias("hours"), *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)])
    return got.where(F.size("hours") > 0)


def at_hours(days: DataFrame, read: tuple[str, ...] = READ) -> DataFrame:
    """``job_days`` with a row an hour."""
    other = [c for c in days.columns if c not in ("job_id", "server", "day", "all_null", "hours")]
    hour = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("x.h"))
    return days.withColumn("x", F.explode("hours")).select("job_id", "server", hour.alias("hour"), *[F.col(f"x.{c}").alias(c) for c in read], "all_null", *other)


def job_hours(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Jobs by host and hour of their run, with the hour's readings.

    An hour without readings on a known server is left out, on an unknown server kept with nulls; ``all_null`` marks those.
    """
    return at_hours(job_days(jobs, t, unknown=True))


def next_readings(jobs: DataFrame, t: DataFrame, metric: str = "cpu_total") -> DataFrame:
    """For each job and known host the first reading at or after the job's start.

    Starts and readings are one stream in the order of time, starts before readings of the same time; the next reading is carried back to
    the starts inside a (server, hour) and over a tree of the hours. Nothing is joined.
    """
    starts = job_hosts(jobs).where("start_time is not null").select("server", F.col("start_time").alias("at"), F.lit(0).alias("tag"), "job_id", F.lit(None).cast("double").alias("value"))
    stream = starts.unionByName(t.where(F.col("metric") == metric).select("server", F.col("ts").alias("at"), F.lit(1).alias("tag"), F.lit(0).cast("long").alias("job_id"), "value"))
    met = scan.known(stream, ["server"], C.hour_number("at"), ["at", "tag", "job_id"], {"next_at": F.col("at"), "next_value": F.col("value")}, F.col("tag") == 1, after=True)
    return met.where("tag = 0 and next_at is not null").select("job_id", "server", F.col("at").alias("start_time"), F.col("next_at").alias("ts"), F.col("next_value").alias("value"))


def touched(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Readings of servers that jobs ran on."""
    return t.join(job_hosts(jobs).select("server").distinct(), "server", "left_semi")


def coverage(jobs: DataFrame, t: DataFrame) -> DataFrame:
    """Per day: distinct jobs and servers with readings in a job's hour."""
    return job_days(jobs, t, read=()).groupBy("day").agg(F.count_distinct("job_id").alias("jobs"), F.count_distinct("server").alias("servers"))
