"""Registered queries of the job and telemetry operators, each with its DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import cleaning, sampling, telemetry, traces, users
from tracelens.sources.views import ANON, JOBS, TELEMETRY, WORK, Tables



def _mean(x: str, digits: int = 6) -> str:
    """Mean by exact sums of decimals."""
    return f"round(sum(CAST({x} AS DECIMAL(28, 9)))::DOUBLE / nullif(count({x}), 0), {digits})"


_SECONDS = "date_diff('second', start_time, end_time)"
_VIEWS = {
    "jobs": JOBS.format(ts="TIMESTAMP"),
    "work": WORK.replace("{extract}", "regexp_extract(hosts, '^[a-z0-9-]+')"),
    "anon": ANON,
    "burst": """SELECT * REPLACE (CASE WHEN job_id % 3 = 0 THEN TIMESTAMP '2024-01-14 00:00:00' + (submit_time - date_trunc('day', submit_time)) ELSE submit_time END AS submit_time) FROM jobs""",
    "log": f"""SELECT job_id, coalesce(user_id, 'unknown_user') AS "user", gpu_num, cpu_num, node_num,
        CASE WHEN job_status_str = 'DONE' THEN 'COMPLETED' WHEN job_status_str = 'EXIT' THEN 'FAILED' WHEN exit_status = 0 THEN 'COMPLETED' WHEN exit_status >= 128 THEN 'CANCELLED' ELSE 'FAILED' END AS state,
        submit_time, start_time, end_time, {_SECONDS} AS duration, date_diff('second', submit_time, start_time) AS queue
        FROM jobs WHERE submit_time IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL AND {_SECONDS} > 0""",
    "part": """SELECT *, unnest(['all', CASE WHEN gpu_num > 0 THEN 'gpu' ELSE 'cpu' END]) AS part FROM log""",
    "raw": TELEMETRY.format(ts="TIMESTAMP"),
    "tel": "SELECT server, metric, ts, min(value) AS value FROM raw WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL",
    "hosts": """SELECT job_id, lower(CASE WHEN part IS NULL THEN item ELSE prefix || part END) AS host FROM (SELECT job_id, item, prefix, unnest(CASE WHEN inside = '' THEN [NULL] ELSE flatten(list_transform(string_split(inside, ','), lambda p: CASE WHEN contains(p, '-') THEN list_transform(range(split_part(p, '-', 1)::BIGINT, split_part(p, '-', 2)::BIGINT + 1), lambda i: i::VARCHAR) ELSE [p] END)) END) AS part
        FROM (SELECT job_id, item, regexp_extract(item, '^([^\\[]*)', 1) AS prefix, regexp_extract(item, '\\[([^\\]]*)\\]', 1) AS inside
        FROM (SELECT job_id, unnest(CASE WHEN starts_with(exec_hosts, '{') THEN json_extract(exec_hosts, '$.nodes')::VARCHAR[] ELSE regexp_extract_all(exec_hosts, '[^,+\\[]+(?:\\[[^\\]]*\\])?') END) AS item FROM jobs)))""",
    "grid": """SELECT unnest(generate_series(date_trunc('hour', min(submit_time)), date_trunc('hour', max(submit_time)), INTERVAL 1 HOUR)) AS hour FROM log""",
    "conc": """SELECT hour, CAST(sum(dj) OVER w AS BIGINT) AS jobs, CAST(sum(dg) OVER w AS BIGINT) AS gpu_jobs, CAST(sum(dn) OVER w AS BIGINT) AS gpus FROM (
        SELECT hour, sum(s) AS dj, sum(CASE WHEN gpu_num > 0 THEN s ELSE 0 END) AS dg, sum(s * gpu_num) AS dn FROM (
          SELECT unnest([{'hour': up, 's': 1}, {'hour': down, 's': -1}], recursive := true), gpu_num FROM (
            SELECT date_trunc('hour', start_time + INTERVAL 3599 SECOND) AS up, date_trunc('hour', end_time) + INTERVAL 1 HOUR AS down, gpu_num FROM log) WHERE up < down) GROUP BY hour) WINDOW w AS (ORDER BY hour)""",
    "jobhour": """SELECT h.job_id, h.host AS server, unnest(generate_series(date_trunc('hour', start_time), end_time - INTERVAL 1 MICROSECOND, INTERVAL 1 HOUR)) AS hour
        FROM hosts h JOIN jobs j USING (job_id) WHERE start_time < end_time AND host IS NOT NULL""",
    "wide": "SELECT server, date_trunc('hour', ts) AS hour, "
    + ", ".join(f"{_mean(f'CASE WHEN metric = {chr(39)}{m}{chr(39)} THEN value END')} AS {m}" for m in ("cpu_total", "gpu_util", "power", "load_1min", "mem_percent"))
    + " FROM tel GROUP BY 1, 2",
    "marks": """SELECT *, md5(concat_ws('|', coalesce(command, ''), CAST(cpu_num AS VARCHAR), CAST(gpu_num AS VARCHAR), queue, regexp_replace(job_name, '_?[0-9]+$', ''))) AS f1,
        md5(concat_ws('|', coalesce(command, ''), CAST(cpu_num AS VARCHAR), queue)) AS f2 FROM jobs""",
    "days": "SELECT CAST(submit_time AS DATE) AS day, count(*) AS n FROM burst WHERE submit_time IS NOT NULL GROUP BY 1",
    "grp": """SELECT *, CASE WHEN server LIKE 'cpu1-%' THEN 'CPU1' WHEN server LIKE 'gpu1-%' THEN 'GPU1' WHEN server LIKE 'bigmem-%' THEN 'BIGMEM' ELSE 'UNKNOWN' END AS grp FROM tel""",
    "use": 'SELECT "user", CAST(sum(gpu_num * duration) AS BIGINT) AS use, count(*) AS jobs FROM log GROUP BY 1',
}


def _sql(body: str) -> str:
    """``body`` with the views it needs, in order."""
    needed, order = {w for w in re.findall(r"\w+", body)} & set(_VIEWS), list(_VIEWS)
    while True:
        more = needed | {v for n in needed for v in set(re.findall(r"\w+", _VIEWS[n])) & set(order[: order.index(n)])}
        if more == needed:
            break
        needed = more
    heads = ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in order if n in needed)
    return f"WITH {heads}\n{body}" if heads else body


_ALL: dict[str, tuple[Callable[[Tables], DataFrame], str]] = {}


def _add(name: str, of: Callable[[Tables], DataFrame], sql: str) -> None:
    _ALL[name] = (of, _sql(sql))


def _log(t: Tables) -> DataFrame:
    return traces.log(t.jobs)


def _tel(t: Tables) -> DataFrame:
    return telemetry.readings(t.telemetry)


def _burst(t: Tables) -> DataFrame:
    day = F.date_trunc("day", F.col("submit_time")).cast("timestamp_ntz")
    moved = F.expr("timestamp_ntz'2024-01-14 00:00:00'") + (F.col("submit_time") - day)
    return t.jobs.withColumn("submit_time", F.when(F.col("job_id") % 3 == 0, moved).otherwise(F.col("submit_time")))


_TYPE = "CASE WHEN gpu_num > 0 THEN 'gpu' ELSE 'cpu' END"
_WD = "CAST(isodow({}) - 1 AS BIGINT)"
_Q6 = ", ".join(f"round(quantile_cont({{v}}, {p}), 6) AS {k}" for k, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))

# Traces
_add("trc_log", _log, "SELECT * FROM log")
_add("trc_sequence", lambda t: traces.sequence(_log(t)), """SELECT hour, coalesce(jobs, 0) AS jobs, coalesce(gpus, 0) AS gpus, coalesce(cpus, 0) AS cpus, coalesce(mean_duration, 0) AS mean_duration FROM grid LEFT JOIN
    (SELECT date_trunc('hour', submit_time) AS hour, count(*) AS jobs, CAST(sum(gpu_num) AS BIGINT) AS gpus, CAST(sum(cpu_num) AS BIGINT) AS cpus, round(avg(duration), 6) AS mean_duration FROM log GROUP BY 1) USING (hour)""")
_add("jn_left_grid", lambda t: traces.hours(_log(t)).join(_log(t).groupBy(F.date_trunc("hour", F.col("end_time")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("ended")), "hour", "left").na.fill(0),
     "SELECT hour, coalesce(ended, 0) AS ended FROM grid LEFT JOIN (SELECT date_trunc('hour', end_time) AS hour, count(*) AS ended FROM log GROUP BY 1) USING (hour)")
_add("trc_throughput", lambda t: traces.throughput(_log(t)), """SELECT date_trunc('hour', start_time) AS hour, count(*) AS started, round(avg(duration), 6) AS mean_duration, CAST(sum(duration) AS BIGINT) AS sum_duration,
    round(sum(duration * gpu_num) / 3600, 6) AS gpu_hours, round(sum(duration * cpu_num) / 3600, 6) AS cpu_hours FROM log GROUP BY 1""")
_add("trc_concurrency", lambda t: traces.concurrency(_log(t)), "SELECT * FROM conc")
_add("trc_event_rate", lambda t: traces.event_rate(_log(t)), "SELECT e.hour AS hour, " + ", ".join(f"count_if(e.k = '{k}') AS {k}_all, count_if(e.k = '{k}' AND gpu_num > 0) AS {k}_gpu, CAST(sum(CASE WHEN e.k = '{k}' THEN gpu_num ELSE 0 END) AS BIGINT) AS {k}_gpu_num" for k in ("submit", "start", "end")) + """
    FROM (SELECT gpu_num, unnest([{'k': 'submit', 'hour': date_trunc('hour', submit_time)}, {'k': 'start', 'hour': date_trunc('hour', start_time)}, {'k': 'end', 'hour': date_trunc('hour', end_time)}]) AS e FROM log) GROUP BY 1""")
_add("trc_monthly", lambda t: traces.monthly(_log(t)), "SELECT strftime(submit_time, '%Y-%m') AS month, count(*) AS jobs, count_if(gpu_num = 0) AS cpu_jobs, count_if(gpu_num > 0) AS gpu_jobs, count_if(gpu_num = 1) AS single_gpu, count_if(gpu_num > 1) AS multi_gpu FROM log GROUP BY 1")
_add("trc_daily_trend", lambda t: traces.daily_trend(_log(t)), "SELECT CAST(submit_time AS DATE) AS day, count(*) AS jobs, count_if(gpu_num > 0) AS gpu_jobs, count_if(gpu_num = 0) AS cpu_jobs FROM log GROUP BY 1")
_add("trc_diurnal_util", lambda t: traces.diurnal(_log(t)), """SELECT CAST(hour(hour) AS BIGINT) AS hour_of_day, round(avg(jobs), 6) AS mean_jobs, round(avg(gpus), 6) AS mean_gpus FROM (
    SELECT h AS hour, (SELECT count(*) FROM log WHERE start_time <= h AND end_time >= h) AS jobs, (SELECT coalesce(sum(gpu_num), 0) FROM log WHERE start_time <= h AND end_time >= h) AS gpus FROM
    (SELECT unnest(generate_series(date_trunc('hour', min(start_time)), date_trunc('hour', max(start_time)), INTERVAL 1 HOUR)) AS h FROM log)) GROUP BY 1""")
_add("trc_month_capacity", lambda t: traces.month_capacity(_log(t)), """SELECT strftime(m, '%Y-%m') AS month, gpu_seconds, round(gpu_seconds / (day(last_day(m)) * 86400.0 * 64), 9) AS share FROM (SELECT date_trunc('month', start_time) AS m, CAST(sum(gpu_num * duration) AS BIGINT) AS gpu_seconds FROM log GROUP BY 1)""")


def _curve(where: str, value: str, weight: str, breaks: list[int], extra: str = "") -> str:
    return f"SELECT CAST(b AS BIGINT) AS at, round(100 * (SELECT coalesce(sum({weight}), 0) FROM log WHERE {where} AND {value} <= b) / (SELECT sum({weight}) FROM log WHERE {where})::DOUBLE, 6) AS percent{extra} FROM (SELECT unnest({breaks}) AS b)"


for _n, _f, _w, _v, _x, _b in (
    ("crv_gpu_cdf", traces.gpu_cdf, "gpu_num > 0", "gpu_num", "1", traces.GPU_BREAKS),
    ("crv_gputime_cdf", traces.gputime_cdf, "gpu_num > 0", "gpu_num", "gpu_num * duration", traces.GPU_BREAKS),
    ("crv_cpu_cdf", traces.cpu_cdf, "gpu_num = 0", "cpu_num", "1", traces.CPU_BREAKS),
    ("crv_cputime_cdf", traces.cputime_cdf, "gpu_num = 0", "cpu_num", "cpu_num * duration", traces.CPU_BREAKS),
):
    _add(_n, lambda t, f=_f: f(_log(t)), _curve(_w, _v, _x, _b))
_add("crv_duration_cdf", lambda t: traces.duration_cdf(_log(t)), _curve("gpu_num > 0", "duration", "1", traces.DURATION_BREAKS, ", 'gpu' AS job_type") + " UNION ALL " + _curve("gpu_num = 0", "duration", "1", traces.DURATION_BREAKS, ", 'cpu' AS job_type"))
_add("crv_gpu_hist", lambda t: traces.gpu_hist(_log(t)), "SELECT gpu_num, count(*) AS jobs, CAST(sum(gpu_num * duration) AS BIGINT) AS gpu_seconds FROM log GROUP BY 1")
_add("crv_completion_hist", lambda t: traces.completion_hist(_log(t)), """SELECT least(CAST(floor(rate / 10) AS BIGINT), 9) AS bin, count(*) AS users FROM (SELECT "user", 100 * count_if(state = 'COMPLETED') / count(*) AS rate FROM log GROUP BY 1) GROUP BY 1""")
_add("crv_wait_run", lambda t: traces.wait_run(_log(t)), f"SELECT job_id, {_TYPE} AS job_type, queue, duration FROM log WHERE queue >= 0")
_add("pat_hour", lambda t: traces.by_hour(_log(t)), "SELECT CAST(hour(submit_time) AS BIGINT) AS hour, count(*) AS jobs, count_if(gpu_num > 0) AS gpu_jobs, count_if(gpu_num = 0) AS cpu_jobs FROM log GROUP BY 1")
_add("pat_week", lambda t: traces.by_weekday(_log(t)), f"SELECT {_WD.format('submit_time')} AS weekday, count(*) AS jobs, bool_or(isodow(submit_time) > 5) AS weekend FROM log GROUP BY 1")
_add("pat_hour_type", lambda t: traces.hour_peak_by_type(_log(t)), f"""SELECT job_type, CAST(sum(n) AS BIGINT) AS jobs, arg_min(hour, (-n) * 100 + hour) AS peak_hour, max(n) AS peak_jobs FROM (SELECT {_TYPE} AS job_type, CAST(hour(submit_time) AS BIGINT) AS hour, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1""")
_add("pat_hour_mean", lambda t: traces.hour_mean(_log(t)), """SELECT CAST(hour(hour) AS BIGINT) AS hour_of_day, round(avg(coalesce(jobs, 0)), 6) AS mean_jobs, round(avg(coalesce(gpus, 0)), 6) AS mean_gpus FROM grid LEFT JOIN
    (SELECT date_trunc('hour', submit_time) AS hour, count(*) AS jobs, sum(gpu_num) AS gpus FROM log GROUP BY 1) USING (hour) GROUP BY 1""")
_add("pat_week_hour", lambda t: traces.week_hour(_log(t)), f"SELECT {_WD.format('submit_time')} AS weekday, " + ", ".join(f"count_if(hour(submit_time) = {h}) AS h{h}" for h in range(24)) + " FROM log GROUP BY 1")

# Cleaning
_add("flt_required", lambda t: cleaning.required(t.jobs), f"SELECT * FROM jobs WHERE job_id IS NOT NULL AND user_id IS NOT NULL AND submit_time IS NOT NULL AND ({_SECONDS} IS NULL OR {_SECONDS} > 0)")
_add("flt_cluster", lambda t: cleaning.without_clusters(t.jobs, ["excluded"]).select("job_id", "cluster_name"), "SELECT job_id, cluster_name FROM jobs WHERE cluster_name IS NULL OR cluster_name <> 'excluded'")
_add("flt_time_valid", lambda t: t.jobs.na.drop(subset=list(cleaning.TIMES)).select("job_id"), "SELECT job_id FROM jobs WHERE submit_time IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL")
_WRONG = "coalesce(submit_time > start_time, false) OR coalesce(start_time > end_time, false) OR coalesce(submit_time > end_time, false)"
_add("tim_missing_flags", lambda t: cleaning.time_flags(t.jobs), f"SELECT job_id, submit_time IS NULL AS no_submit_time, start_time IS NULL AS no_start_time, end_time IS NULL AS no_end_time, {_WRONG} AS out_of_order FROM jobs")
_add("prd_time_logic", lambda t: cleaning.time_flags(t.jobs).where("out_of_order").select("job_id"), f"SELECT job_id FROM jobs WHERE {_WRONG}")
_add("prd_unrecoverable", lambda t: cleaning.time_flags(t.jobs).where("no_start_time or no_end_time").select("job_id"), "SELECT job_id FROM jobs WHERE start_time IS NULL OR end_time IS NULL")
_add("spl_usable", lambda t: cleaning.usable(t.jobs), f"SELECT job_id, CASE WHEN start_time IS NULL OR end_time IS NULL THEN 'unrecoverable' WHEN {_WRONG} THEN 'out_of_order' ELSE 'usable' END AS part FROM jobs")
_add("tim_recover", lambda t: cleaning.repair(t.jobs), """SELECT job_id, coalesce(submit_time, guess, start_time - INTERVAL 300 SECOND) AS submit_time, CASE WHEN submit_time IS NOT NULL THEN 'known' WHEN guess IS NOT NULL THEN 'user' WHEN start_time IS NOT NULL THEN 'start' ELSE 'none' END AS how, start_time, end_time
    FROM jobs LEFT JOIN (SELECT user_id, max(submit_time) + INTERVAL 1 SECOND * CAST(floor(date_diff('second', min(submit_time), max(submit_time)) / (count(*) - 1)) AS BIGINT) AS guess FROM jobs WHERE user_id IS NOT NULL AND submit_time IS NOT NULL GROUP BY 1 HAVING count(*) >= 10) USING (user_id)""")
_add("fn_elapsed", lambda t: cleaning.elapsed(t.jobs), f"""SELECT job_id, d AS raw, CASE WHEN d IS NULL THEN 0 ELSE greatest(d, 0) END AS seconds, round(CASE WHEN d IS NULL THEN 0 ELSE greatest(d, 0) END / 60, 6) AS minutes, round(CASE WHEN d IS NULL THEN 0 ELSE greatest(d, 0) END / 3600, 6) AS hours,
    CASE WHEN q IS NULL THEN 0 ELSE greatest(q, 0) END AS queue, coalesce(d > 8760 * 3600, false) AS too_long FROM (SELECT job_id, {_SECONDS} AS d, date_diff('second', submit_time, start_time) AS q FROM jobs)""")
_add("inf_finalize", lambda t: cleaning.user_or_unknown(t.jobs), """SELECT job_id, coalesce(user_id, 'unknown_user') AS "user" FROM jobs""")
_COLS = list(cleaning.IMPORTANCE)
_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count_if({c} IS NULL) AS nulls FROM jobs" for c in _COLS)
_add("ag_missing", lambda t: cleaning.missing(t.jobs.select(*_COLS)), f"SELECT name, n, nulls, round(nulls / n, 9) AS ratio FROM ({_MISSING})")
_add("dq_patterns", lambda t: cleaning.missing_patterns(t.jobs.select(*_COLS)), f"SELECT name, CASE WHEN nulls = n THEN 'all' WHEN nulls = 0 THEN 'none' WHEN nulls / n > 0.5 THEN 'high' WHEN nulls / n >= 0.1 THEN 'medium' ELSE 'low' END AS pattern FROM ({_MISSING})")
_add("ag_missing_combo", lambda t: cleaning.missing_together(t.jobs), """SELECT count_if(submit_time IS NULL AND start_time IS NULL) AS submit_time_start_time, count_if(start_time IS NULL AND end_time IS NULL) AS start_time_end_time, count_if(submit_time IS NULL AND end_time IS NULL) AS submit_time_end_time,
    count_if(submit_time IS NULL AND start_time IS NULL AND end_time IS NULL) AS all_times FROM jobs""")
_W = "CASE name " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cleaning.IMPORTANCE.items()) + " END"
_add("dq_field_score", lambda t: cleaning.field_scores(t.jobs), f"SELECT name, round(p, 6) AS present, round(least(1.0::DOUBLE, w / 5 + 0.3::DOUBLE * p), 6) AS importance, round(p * least(1.0::DOUBLE, w / 5 + 0.3::DOUBLE * p), 6) AS score FROM (SELECT name, 1 - nulls / n AS p, {_W} AS w FROM ({_MISSING}))")
_TOP = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM jobs" for c in ("queue", "job_name", "exec_hosts", "user_id"))
_add("ag_profile_topk", lambda t: cleaning.top_values(t.jobs, ["queue", "job_name", "exec_hosts", "user_id"]), f"SELECT name, rank, value, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM (SELECT name, value, count(*) AS n FROM ({_TOP}) WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5")
_add("ag_value_counts", lambda t: t.jobs.groupBy("queue", "cluster_name", "job_status_str").agg(F.count("*").alias("n")), "SELECT queue, cluster_name, job_status_str, count(*) AS n FROM jobs GROUP BY ALL")
_add("cls_llm_learn", lambda t: cleaning.word_counts(t.jobs), "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(command), '[a-z0-9_-]{3,}')) AS word FROM jobs) GROUP BY 1 HAVING count(*) >= 5")
_add("fn_words", lambda t: t.jobs.select("job_id", F.coalesce(F.size(F.regexp_extract_all(F.lower("command"), F.lit("([a-z0-9_-]{3,})"), F.lit(1))), F.lit(0)).cast("long").alias("words")).withColumn("words", F.greatest("words", F.lit(0))), "SELECT job_id, CAST(coalesce(len(regexp_extract_all(lower(command), '[a-z0-9_-]{3,}')), 0) AS BIGINT) AS words FROM jobs")
_add("fn_status_map3", lambda t: t.jobs.select("job_id", C.state("job_status_str", "exit_status").alias("state")), "SELECT job_id, CASE WHEN job_status_str = 'DONE' THEN 'COMPLETED' WHEN job_status_str = 'EXIT' THEN 'FAILED' WHEN exit_status = 0 THEN 'COMPLETED' WHEN exit_status >= 128 THEN 'CANCELLED' ELSE 'FAILED' END AS state FROM jobs")
_add("fn_base_name", lambda t: t.jobs.select("job_id", C.base_name("job_name").alias("base")), "SELECT job_id, regexp_replace(job_name, '_?[0-9]+$', '') AS base FROM jobs")
_add("fn_md5_short", lambda t: t.jobs.where("user_id is not null").select("job_id", F.concat(F.lit("u"), F.substring(F.md5(F.col("user_id").cast("binary")), 1, 4)).alias("short")), "SELECT job_id, 'u' || substring(md5(user_id), 1, 4) AS short FROM jobs WHERE user_id IS NOT NULL")
_add("fn_date_parts", lambda t: t.table("orders").select("o_orderkey", F.hour("o_orderdate").cast("long").alias("hour"), F.weekday("o_orderdate").cast("long").alias("weekday"), F.month("o_orderdate").cast("long").alias("month"), F.weekofyear("o_orderdate").cast("long").alias("week"), F.dayofmonth(F.last_day("o_orderdate")).cast("long").alias("days")),
     f"SELECT o_orderkey, CAST(hour(o_orderdate::TIMESTAMP) AS BIGINT) AS hour, {_WD.format('o_orderdate')} AS weekday, CAST(month(o_orderdate) AS BIGINT) AS month, CAST(weekofyear(o_orderdate) AS BIGINT) AS week, CAST(day(last_day(o_orderdate::DATE)) AS BIGINT) AS days FROM orders")
_BINS = ([0.0, 1, 4, 8, 16, 64], ["1", "2-4", "5-8", "9-16", "17-64"])
_add("prj_bucket", lambda t: t.jobs.select("job_id", C.right_closed(F.col("gpu_num"), *_BINS).alias("bin")), "SELECT job_id, CASE WHEN gpu_num <= 0 THEN NULL WHEN gpu_num <= 1 THEN '1' WHEN gpu_num <= 4 THEN '2-4' WHEN gpu_num <= 8 THEN '5-8' WHEN gpu_num <= 16 THEN '9-16' WHEN gpu_num <= 64 THEN '17-64' END AS bin FROM jobs")
_add("prj_is_gpu", lambda t: t.jobs.select("job_id", ((F.coalesce("gpu_num", F.lit(0)) > 0) | F.coalesce(F.lower("exec_hosts").contains("gpu"), F.lit(False))).alias("is_gpu")), "SELECT job_id, coalesce(gpu_num, 0) > 0 OR coalesce(contains(lower(exec_hosts), 'gpu'), false) AS is_gpu FROM jobs")
_add("fn_hosts_parse", lambda t: t.jobs.select("job_id", F.explode(C.hosts("exec_hosts")).alias("host")), "SELECT job_id, host FROM hosts WHERE host IS NOT NULL")
_add("fn_range_expand", lambda t: t.jobs.withColumn("n", 7 + F.col("job_id") % 4).selectExpr("job_id", """CASE job_id % 5 WHEN 0 THEN concat('node[', lpad(n, 3, '0'), '-', lpad(n + 2, 3, '0'), ']') WHEN 1 THEN concat('cpu1-', n, '-', n + 1)
    WHEN 2 THEN concat('p[', n, '-', n + 2) WHEN 3 THEN concat('p[0', n, ', ', n, '-', n + 1, ']') END AS form""").select("job_id", F.explode(C.hosts("form")).alias("host")), """SELECT job_id, unnest(CASE job_id % 5
    WHEN 0 THEN [format('node{:03d}', n), format('node{:03d}', n + 1), format('node{:03d}', n + 2)] WHEN 1 THEN ['cpu1-' || n, 'cpu1-' || (n + 1)] WHEN 2 THEN ['p' || n, 'p' || (n + 1), 'p' || (n + 2)]
    WHEN 3 THEN ['p0' || n, 'p' || n, 'p' || (n + 1)] END) AS host FROM (SELECT job_id, 7 + job_id % 4 AS n FROM jobs)""")
_add("fn_node_counts", lambda t: sampling.host_counts(t.jobs), """SELECT j.job_id, count(host) AS hosts, count(*) FILTER (host LIKE 'cpu%') AS cpu_hosts, count(*) FILTER (host LIKE 'gpu%') AS gpu_hosts, CASE WHEN count_if(host LIKE 'cpu%') > 0 AND count_if(host LIKE 'gpu%') > 0 THEN 'mixed' WHEN count_if(host LIKE 'gpu%') > 0 THEN 'gpu' WHEN count_if(host LIKE 'cpu%') > 0 THEN 'cpu' ELSE 'unknown' END AS kind
    FROM jobs j LEFT JOIN hosts h ON h.job_id = j.job_id GROUP BY 1""")
_SUB = "upper(regexp_replace(host, '-.*', ''))"
_add("ag_job_distribution", lambda t: sampling.subcluster_jobs(t.jobs), f"SELECT {_SUB} AS subcluster, count(DISTINCT job_id) AS jobs, count(*) AS hosts FROM hosts WHERE host IS NOT NULL GROUP BY 1")
_add("fn_primary_sub", lambda t: sampling.primary_subcluster(t.jobs), f"SELECT job_id, arg_min(s, (-n, s)) AS subcluster, max(n) AS hosts FROM (SELECT job_id, {_SUB} AS s, count(*) AS n FROM hosts WHERE host IS NOT NULL GROUP BY 1, 2) GROUP BY 1")

# Users and aggregates
_add("ag_basic_metrics", lambda t: users.basic(_log(t)), """SELECT count(*) AS jobs, count(DISTINCT "user") AS users, min(submit_time) AS first, max(submit_time) AS last, count_if(gpu_num > 0) AS gpu_jobs, round(sum(node_num * duration) / 3600, 6) AS node_hours, round(avg(duration), 6) AS mean_duration, max(gpu_num) AS max_gpus FROM log""")
_add("ag_describe", lambda t: users.describe(_log(t), "cpu_num"), f"SELECT part, count(*) AS n, round(avg(cpu_num), 6) AS mean, round(stddev_samp(cpu_num), 4) AS std, min(cpu_num) AS least, max(cpu_num) AS most, {_Q6.format(v='cpu_num')} FROM part WHERE cpu_num > 0 GROUP BY 1")
_add("ag_duration_stats", lambda t: users.describe(_log(t), "duration"), f"SELECT part, count(*) AS n, round(avg(duration), 6) AS mean, round(stddev_samp(duration), 4) AS std, min(duration) AS least, max(duration) AS most, {_Q6.format(v='duration')} FROM part GROUP BY 1")
_add("ag_queue_stats", lambda t: users.describe(_log(t), "queue"), f"SELECT part, count(*) AS n, round(avg(queue), 6) AS mean, round(stddev_samp(queue), 4) AS std, min(queue) AS least, max(queue) AS most, {_Q6.format(v='queue')} FROM part WHERE queue > 0 GROUP BY 1")
_add("ag_duration_ratio", lambda t: users.duration_ratios(_log(t)), "SELECT part, count(*) AS n, round(count_if(duration < 300) / count(*), 9) AS m5, round(count_if(duration >= 300 AND duration < 3600) / count(*), 9) AS h1, round(count_if(duration >= 3600 AND duration < 86400) / count(*), 9) AS d1, round(count_if(duration >= 86400) / count(*), 9) AS more FROM part GROUP BY 1")
_add("ag_queue_ratio", lambda t: users.queue_ratios(_log(t)), "SELECT part, count(*) AS n, round(avg(queue), 6) AS mean, max(queue) AS most, round(count_if(queue < 60) / count(*), 9) AS m1, round(count_if(queue >= 60 AND queue < 3600) / count(*), 9) AS h1, round(count_if(queue >= 3600) / count(*), 9) AS more FROM part WHERE queue >= 0 GROUP BY 1")
_add("ag_completion", lambda t: users.completion(_log(t)), "SELECT part, count(*) AS n, " + ", ".join(f"count_if(state = '{s.upper()}') AS {s}, round(count_if(state = '{s.upper()}') / count(*), 9) AS {s}_share" for s in ("completed", "failed", "cancelled")) + " FROM part GROUP BY 1")
_add("ag_status_share", lambda t: users.state_share(_log(t)), f"SELECT job_type, state, n, round(100 * n / sum(n) OVER (PARTITION BY job_type), 6) AS percent FROM (SELECT {_TYPE} AS job_type, state, count(*) AS n FROM log GROUP BY 1, 2)")
_add("ag_status_by_gpubin", lambda t: users.state_by_gpus(_log(t)), "SELECT CASE WHEN gpu_num < 2 THEN '1' WHEN gpu_num < 4 THEN '2-3' WHEN gpu_num < 8 THEN '4-7' WHEN gpu_num < 16 THEN '8-15' ELSE '16+' END AS gpus, count(*) AS n, round(100 * count_if(state = 'COMPLETED') / count(*), 6) AS completed FROM log WHERE gpu_num > 0 GROUP BY 1")
_add("ag_size_class", lambda t: users.sizes(_log(t)), "SELECT CASE WHEN node_num = 1 THEN 'single' WHEN node_num <= 8 THEN 'small' WHEN node_num <= 64 THEN 'medium' ELSE 'large' END AS size, count(*) AS jobs, round(sum(node_num * duration) / 3600, 6) AS node_hours FROM log GROUP BY 1")
_add("ag_user_facts", lambda t: users.per_user(_log(t)), """SELECT "user", count(*) AS jobs, count_if(gpu_num > 0) AS gpu_jobs, count_if(state = 'COMPLETED') AS completed, round(100 * count_if(state = 'COMPLETED') / count(*), 6) AS completed_percent, round(sum(gpu_num * duration) / 3600, 6) AS gpu_hours, round(sum(cpu_num * duration) / 3600, 6) AS cpu_hours,
    round(sum(greatest(queue, 0)) / 3600, 6) AS pending_hours, min(submit_time) AS first, max(submit_time) AS last FROM log GROUP BY 1""")
_add("ag_user_duration_q", lambda t: users.per_user_quantiles(_log(t)), """SELECT "user", round(count_if(duration <= 10) / count(*), 9) AS short_share, round(avg(duration), 6) AS mean, round(quantile_cont(duration, 0.25), 6) AS q25, round(quantile_cont(duration, 0.5), 6) AS median, round(quantile_cont(duration, 0.75), 6) AS q75 FROM log GROUP BY 1""")
_add("ag_user_type_pref", lambda t: users.type_preference(_log(t)), """SELECT CASE WHEN g AND c THEN 'mixed' WHEN g THEN 'gpu' ELSE 'cpu' END AS kind, count(*) AS users FROM (SELECT "user", bool_or(gpu_num > 0) AS g, bool_or(gpu_num = 0) AS c FROM log GROUP BY 1) GROUP BY 1""")
_add("ag_user_worktime", lambda t: users.work_time(_log(t)), """SELECT "user", round(100 * count_if(hour(submit_time) BETWEEN 9 AND 17) / count(*), 6) AS work_hours, round(100 * count_if(isodow(submit_time) < 6) / count(*), 6) AS weekdays FROM log GROUP BY 1""")
_PARETO = """SELECT "user", use, row_number() OVER w AS place, CAST(sum(use) OVER w AS BIGINT) AS running, round(100 * sum(use) OVER w / (SELECT sum(use) FROM use), 6) AS use_percent, round(100 * row_number() OVER w / (SELECT count(*) FROM use), 6) AS user_percent, jobs FROM use WINDOW w AS (ORDER BY use DESC, "user" ROWS UNBOUNDED PRECEDING)"""
_add("win_pareto", lambda t: users.pareto(_log(t)), f"SELECT * EXCLUDE (jobs) FROM ({_PARETO})")
_add("ag_heavy_users", lambda t: users.heavy(_log(t)), f"""SELECT "user", use, use_percent, jobs FROM ({_PARETO}) WHERE use_percent <= 80""")
_add("win_running_cover", lambda t: users.pareto(_log(t).withColumn("gpu_num", F.lit(1))).select("user", "use", "use_percent"), """SELECT "user", use, round(100 * sum(use) OVER (ORDER BY use DESC, "user" ROWS UNBOUNDED PRECEDING) / sum(use) OVER (), 6) AS use_percent FROM (SELECT "user", CAST(sum(duration) AS BIGINT) AS use FROM log GROUP BY 1)""")
_add("win_ecdf", lambda t: users.ecdf(_log(t)), "SELECT value, upto, round(upto / (SELECT count(*) FROM log WHERE queue >= 0), 9) AS share FROM (SELECT queue AS value, CAST(sum(count(*)) OVER (ORDER BY queue) AS BIGINT) AS upto FROM log WHERE queue >= 0 GROUP BY queue)")
_add("ag_gini", lambda t: users.gini(_log(t)), """SELECT round(greatest(0.0, least(1.0, 2 * sum(i * use)::DOUBLE / (count(*) * sum(use)::DOUBLE) - (count(*) + 1) / count(*))), 9) AS gini FROM (SELECT use, row_number() OVER (ORDER BY use, "user") AS i FROM use)""")
_add("ag_recurrence_name", lambda t: users.recurrence(t.jobs), "SELECT CAST(t AS BIGINT) AS times, count(*) AS names, CAST(sum(n) AS BIGINT) AS submissions FROM (SELECT job_name, count(*) AS n FROM jobs GROUP BY 1), (SELECT unnest([2, 5, 10, 20, 50, 100]) AS t) WHERE n >= t GROUP BY 1")
_add("ag_recurrence_user", lambda t: users.recurrence_user(t.jobs), "SELECT user_id, count(*) AS jobs, count(DISTINCT job_name) AS names, round(count(DISTINCT job_name) / count(*), 9) AS ratio FROM jobs WHERE user_id IS NOT NULL GROUP BY 1")
_add("ag_recurrence_res", lambda t: users.recurrence_resources(t.jobs), "SELECT concat_ws('_', cpu_num, gpu_num) AS signature, count(*) AS n FROM jobs GROUP BY 1")
_add("dup_fingerprint", lambda t: users.duplicates(t.jobs), "SELECT f1 AS fingerprint, count(*) AS jobs, count(DISTINCT user_id) AS users, min(job_id) AS example FROM marks GROUP BY 1 HAVING count(*) > 1")
_add("dup_cross_user", lambda t: users.across_users(t.jobs), "SELECT fingerprint, count(*) AS users, CAST(sum(n) AS BIGINT) AS jobs, arg_min(user_id, (-n, user_id)) AS main_user FROM (SELECT f2 AS fingerprint, user_id, count(*) AS n FROM marks WHERE user_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1")
_add("null_user_profile", lambda t: users.null_users(t.jobs), "SELECT user_id IS NULL AS no_user, queue, count(*) AS jobs, round(avg(cpu_num), 6) AS mean_cpus, count_if(gpu_num > 0) AS gpu_jobs FROM jobs GROUP BY 1, 2")
_add("jn_name_overlap", lambda t: users.shared_names(t.jobs), "SELECT job_name FROM jobs WHERE user_id IS NULL INTERSECT SELECT job_name FROM jobs WHERE user_id IS NOT NULL")
_add("ag_reconcile", lambda t: users.reconcile(t.jobs), "SELECT count(*) AS jobs, count(user_id) AS with_user, count(*) - count(user_id) AS without_user, count(DISTINCT user_id) AS users FROM jobs")
_add("win_rank", lambda t: users.ranked(t.jobs), "SELECT user_id, jobs, row_number() OVER (ORDER BY jobs DESC, user_id) AS rank, round(100 * jobs / (SELECT count(user_id) FROM jobs), 6) AS percent FROM (SELECT user_id, count(*) AS jobs FROM jobs WHERE user_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)")
_add("win_growth", lambda t: users.growth(t.table("orders")), "SELECT month, n, round(100 * (n - lag(n) OVER w) / lag(n) OVER w, 6) AS growth FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) WINDOW w AS (ORDER BY month)")

# Anomalies, samples, two traces
_add("anm_daily_level", lambda t: sampling.daily_levels(_burst(t)), """SELECT day, n, CASE WHEN n >= e THEN 'extreme' WHEN n >= s THEN 'severe' WHEN n >= 340 THEN 'moderate' ELSE 'normal' END AS level FROM days, (SELECT greatest(1000, 10 * q2, m + 5 * sd) AS e, greatest(400, q2 + 3 * (q3 - q1), m + 3 * sd) AS s FROM
    (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, avg(n) AS m, stddev_samp(n) AS sd FROM days))""")
_add("smp_stratified", lambda t: sampling.stratified(t.jobs, "user_id", 0.2).select("job_id", "user_id"), "SELECT job_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(user_id, '') ORDER BY md5('s1-' || job_id), job_id) AS r, count(*) OVER (PARTITION BY coalesce(user_id, '')) AS n FROM jobs) WHERE r <= greatest(1, floor(0.2::DOUBLE * n))")
_add("smp_cluster", lambda t: sampling.stratified(t.jobs, "job_name", 0.1, "c1-").select("job_id", "job_name"), "SELECT job_id, job_name FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(job_name, '') ORDER BY md5('c1-' || job_id), job_id) AS r, count(*) OVER (PARTITION BY coalesce(job_name, '')) AS n FROM jobs) WHERE r <= greatest(1, floor(0.1::DOUBLE * n))")
_add("smp_random", lambda t: sampling.random_rows(t.jobs, 1234).select("job_id"), "SELECT job_id FROM (SELECT job_id, row_number() OVER (ORDER BY md5('r1-' || job_id), job_id) AS r FROM jobs) WHERE r <= 1234")
_add("smp_errors", lambda t: sampling.errors_thinned(t.jobs).select("job_id", "exit_status"), "SELECT job_id, exit_status FROM jobs WHERE exit_status = 0 UNION ALL SELECT job_id, exit_status FROM (SELECT *, row_number() OVER (ORDER BY md5('e1-' || job_id), job_id) AS r, count(*) OVER () AS n FROM jobs WHERE exit_status <> 0) WHERE r <= floor(0.5 * n)")
_add("smp_systematic", lambda t: sampling.systematic(t.jobs).select("job_id"), "SELECT job_id FROM (SELECT job_id, row_number() OVER (ORDER BY job_id) AS r FROM jobs) WHERE r % 10 = 1")
_add("smp_compare", lambda t: sampling.compare_days(t.jobs, sampling.systematic(t.jobs)), """SELECT day, n, coalesce(kept, 0) AS kept, round(coalesce(kept, 0) / n, 9) AS rate FROM (SELECT CAST(submit_time AS DATE) AS day, count(*) AS n FROM jobs WHERE submit_time IS NOT NULL GROUP BY 1) LEFT JOIN
    (SELECT CAST(submit_time AS DATE) AS day, count(*) AS kept FROM (SELECT submit_time, row_number() OVER (ORDER BY job_id) AS r FROM jobs) WHERE r % 10 = 1 AND submit_time IS NOT NULL GROUP BY 1) USING (day)""")
_add("set_except", lambda t: sampling.missing_hours(t.jobs), """SELECT user_id, hour FROM (SELECT DISTINCT user_id FROM jobs WHERE user_id IS NOT NULL), (SELECT unnest(range(24)) AS hour) EXCEPT SELECT user_id, hour(submit_time) FROM jobs WHERE submit_time IS NOT NULL""")
_add("dup_repeated", lambda t: sampling.repeated(_burst(t), 1), "SELECT CAST(submit_time AS DATE) AS day, user_id, gpu_num, cpu_num, count(*) AS n FROM burst WHERE user_id IS NOT NULL AND submit_time IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
_add("top_peak_day", lambda t: sampling.peak_day(_burst(t)), "SELECT job_id, CAST(submit_time AS DATE) AS day, user_id, submit_time FROM burst WHERE CAST(submit_time AS DATE) = (SELECT day FROM days ORDER BY n DESC, day LIMIT 1)")
_add("top_minutes", lambda t: sampling.busy_minutes(_burst(t)), "SELECT date_trunc('minute', submit_time) AS minute, count(*) AS n FROM burst WHERE submit_time IS NOT NULL GROUP BY 1 HAVING count(*) > 2")
_add("anm_short_jobs", lambda t: sampling.short_jobs(_log(t)), """SELECT "user", count_if(duration < 600) AS short, round(count_if(duration < 600) / count(*), 9) AS share FROM log GROUP BY 1 HAVING count_if(duration < 600) > 0""")
_DS = "CASE WHEN job_id % 2 = 0 THEN 'local' ELSE 'external' END AS dataset"
_add("cmp_datasets", lambda t: sampling.datasets(_log(t)), f"""SELECT {_DS}, count(*) AS jobs, count(DISTINCT "user") AS users, round(avg(duration), 6) AS mean_duration, max(gpu_num) AS max_gpus, round(sum(gpu_num * duration) / 3600, 6) AS gpu_hours FROM log GROUP BY 1""")
_add("cmp_gputime_status", lambda t: sampling.state_time(_log(t)), f"SELECT {_DS}, " + ", ".join(f"round(100 * sum(CASE WHEN state = '{s.upper()}' THEN gpu_num * duration ELSE 0 END) / sum(gpu_num * duration), 6) AS {s}" for s in ("completed", "failed", "cancelled")) + " FROM log WHERE gpu_num > 0 GROUP BY 1")
_add("cmp_duration", lambda t: sampling.durations(_log(t)), _curve("job_id % 2 = 0", "duration", "1", traces.DURATION_BREAKS, ", 'local' AS dataset") + " UNION ALL " + _curve("job_id % 2 <> 0", "duration", "1", traces.DURATION_BREAKS, ", 'external' AS dataset"))
_add("cmp_status_count", lambda t: sampling.duration_quantiles(_log(t)), f"SELECT {_DS}, round(quantile_cont(duration, 0.5), 6) AS median, round(quantile_cont(duration, 0.95), 6) AS p95 FROM log GROUP BY 1")

# Telemetry
_add("src_telemetry", _tel, "SELECT * FROM tel")
_LABEL = {"hour": "date_trunc('hour', ts)", "day": "date_trunc('day', ts)::TIMESTAMP", "week": "(date_trunc('week', ts) + INTERVAL 6 DAY)::TIMESTAMP", "month": "last_day(ts)::TIMESTAMP"}
_add("tel_resample", lambda t: reduce(DataFrame.unionByName, [telemetry.resample(_tel(t), e).withColumn("every", F.lit(e)) for e in _LABEL]),
     " UNION ALL ".join(f"SELECT metric, {x} AS at, round(avg(value), 6) AS mean, count(*) AS n, '{e}' AS every FROM tel GROUP BY 1, 2" for e, x in _LABEL.items()))
_add("tel_weekday", lambda t: telemetry.by_weekday(_tel(t)), f"SELECT m.metric, CAST(d AS BIGINT) AS weekday, {_mean('value')} AS mean FROM (SELECT DISTINCT metric FROM tel) m CROSS JOIN (SELECT unnest(range(7)) AS d) LEFT JOIN tel t ON t.metric = m.metric AND {_WD.format('ts')} = d GROUP BY 1, 2")
_add("tel_hour_profile", lambda t: telemetry.hour_profile(_tel(t)), "SELECT metric, CAST(hour(ts) AS BIGINT) AS hour, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value), 6) AS std FROM tel GROUP BY 1, 2")
_add("tel_heatmap", lambda t: telemetry.heatmap(_tel(t)), f"SELECT {_WD.format('ts')} AS weekday, " + ", ".join(f"round(avg(CASE WHEN hour(ts) = {h} THEN value END), 6) AS h{h}" for h in range(24)) + " FROM tel GROUP BY 1")
_add("tel_group_stats", lambda t: telemetry.group_stats(_tel(t)), "SELECT grp, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most, count(DISTINCT server) AS servers, round(quantile_cont(value, 0.5), 6) AS median FROM grp GROUP BY 1, 2")
_add("tel_server_stats", lambda t: telemetry.server_stats(_tel(t)), "SELECT server, metric, round(avg(value), 6) AS mean, max(value) AS most, round(stddev_samp(value), 6) AS std, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM tel GROUP BY 1, 2")
_add("tel_above", lambda t: telemetry.above(_tel(t)), "SELECT metric, count(*) AS n, count_if(value > 60) AS above_60, count_if(value > 80) AS above_80, count_if(value > 90) AS above_90 FROM tel GROUP BY 1")
_add("tel_util_class", lambda t: telemetry.utilisation_class(_tel(t)), "SELECT grp, count_if(m > 60) AS high, count_if(m < 40) AS low, count_if(m BETWEEN 40 AND 60) AS balanced FROM (SELECT grp, server, avg(value) AS m FROM grp GROUP BY 1, 2) GROUP BY 1")
_add("tel_power_bands", lambda t: telemetry.power_bands(_tel(t)), "SELECT metric, round(count_if(value < 25) / count(*), 9) AS below_25, round(count_if(value >= 25 AND value < 50) / count(*), 9) AS below_50, round(count_if(value >= 50 AND value < 75) / count(*), 9) AS below_75, round(count_if(value >= 75) / count(*), 9) AS rest, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM tel WHERE metric = 'power' GROUP BY 1")
_BOX = "SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM tel GROUP BY 1"
_IN = "value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)"
_add("tel_boxplot", lambda t: telemetry.boxes(_tel(t)), f"SELECT metric, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, min(CASE WHEN {_IN} THEN value END) AS low, max(CASE WHEN {_IN} THEN value END) AS high, count_if(NOT ({_IN})) AS outside FROM tel JOIN ({_BOX}) USING (metric) GROUP BY metric, q1, q2, q3")
_add("top_anomaly", lambda t: telemetry.top_anomalies(_tel(t)), f"SELECT metric, rank, server, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, server, ts) AS rank FROM tel JOIN ({_BOX}) USING (metric) WHERE value > q3 + 0.5 * (q3 - q1)) WHERE rank <= 20")
_add("tel_daily_envelope", lambda t: telemetry.envelope(_tel(t)), "SELECT grp, CAST(ts AS DATE) AS day, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(DISTINCT server) AS servers FROM grp GROUP BY 1, 2")
_add("win_gap_island", lambda t: telemetry.islands(_tel(t)), """SELECT server, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(CAST(value AS DECIMAL(28, 9)))::DOUBLE / count(*), 6) AS mean, max(value) AS most FROM (SELECT *, sum(new) OVER (PARTITION BY server ORDER BY ts, metric ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 12 * 3600 THEN 0 ELSE 1 END AS new FROM tel WHERE value > 60 WINDOW w AS (PARTITION BY server ORDER BY ts, metric))) GROUP BY server, island HAVING date_diff('second', min(ts), max(ts)) >= 3600""")
_add("win_change_bins", lambda t: telemetry.changes(_tel(t)), "SELECT metric, CASE WHEN d <= -20 THEN 'much lower' WHEN d <= -5 THEN 'lower' WHEN d <= 5 THEN 'same' WHEN d <= 20 THEN 'higher' ELSE 'much higher' END AS change, count(*) AS n FROM (SELECT metric, lead(value) OVER (PARTITION BY server, metric ORDER BY ts) - value AS d FROM tel) WHERE d IS NOT NULL GROUP BY 1, 2")
_add("fn_invert_idle", lambda t: telemetry.idle_inverted(_tel(t)), "SELECT server, ts, round(100 - value, 9) AS used FROM tel WHERE metric = 'cpu_total'")
_add("jn_resource_wide", lambda t: telemetry.wide(_tel(t)), "SELECT * FROM wide")
_add("top_servers", lambda t: telemetry.busiest(_tel(t)), "SELECT server, round(avg(value), 6) AS mean FROM tel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
_add("ag_instance_usage", lambda t: telemetry.instance_usage(_tel(t)), "SELECT server, metric, round(avg(value), 6) AS mean, max(value) AS peak, round(avg(value) / nullif(max(value), 0), 6) AS mean_to_peak FROM tel GROUP BY 1, 2")
_add("tel_consistency", lambda t: telemetry.consistency(_tel(t)), "SELECT metric, count(DISTINCT server) AS servers, min(ts) AS first, max(ts) AS last, count(*) AS n FROM tel GROUP BY 1")
_HOURS = """SELECT DISTINCT h.job_id, h.server, h.hour, cpu_total, gpu_util, load_1min, power, w.server IS NULL AS all_null FROM jobhour h LEFT JOIN wide w ON w.server = h.server AND w.hour = h.hour WHERE w.server IS NOT NULL OR h.server NOT IN (SELECT server FROM tel)"""
_add("jn_job_host_hour", lambda t: telemetry.job_hours(t.jobs, _tel(t)), _HOURS)
_add("ag_daily_coverage", lambda t: telemetry.coverage(t.jobs, _tel(t)), f"SELECT CAST(hour AS DATE) AS day, count(DISTINCT job_id) AS jobs, count(DISTINCT server) AS servers FROM ({_HOURS}) WHERE NOT all_null GROUP BY 1")
_add("src_target_load", lambda t: telemetry.touched(t.jobs, _tel(t)), "SELECT * FROM tel WHERE server IN (SELECT host FROM hosts)")
_add("jn_asof_points", lambda t: telemetry.next_readings(t.jobs, _tel(t)), "SELECT h.job_id, h.host AS server, j.start_time, min(t.ts) AS ts, arg_min(t.value, t.ts) AS value FROM hosts h JOIN jobs j USING (job_id) JOIN tel t ON t.server = h.host AND t.metric = 'cpu_total' AND t.ts >= j.start_time GROUP BY 1, 2, 3")
