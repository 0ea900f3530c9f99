"""Queries of full profiles: users, days, telemetry, quality, resolved names and parsed text, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import capacity, quality, sampling, telemetry, users
from tracelens.plans.registry import _SECONDS, _VIEWS, _WD, _add, _burst, _log, _mean, _tel
from tracelens.sources import csv_text

_STATE = "CASE WHEN job_status_str = 'DONE' THEN 'COMPLETED' WHEN job_status_str = 'EXIT' THEN 'FAILED' WHEN exit_status = 0 THEN 'COMPLETED' WHEN exit_status >= 128 THEN 'CANCELLED' ELSE 'FAILED' END"
_KINDS = {"": "true", "gpu_": "gpu_num > 0", "cpu_": "coalesce(gpu_num, 0) = 0"}
_hours = lambda c, v: f"round(coalesce(sum(CASE WHEN {c} THEN {v} END), 0) / 3600, 6)"
_FACTS = [f"count_if({c}) AS {k}jobs" for k, c in _KINDS.items()] + ["count(DISTINCT queue) AS queues", "count(DISTINCT job_name) AS names"]
_FACTS += [f"{_hours(c, 'd')} AS {k}hours" for k, c in _KINDS.items()] + [f"{_hours('gpu_num > 0', 'd * gpu_num')} AS gpu_time", f"{_hours('true', 'd * cpu_num')} AS cpu_time"]
_FACTS += [f"{_hours(c, 'q')} AS {k}pending" for k, c in _KINDS.items()] + ["max(gpu_num) AS max_gpus", "max(cpu_num) AS max_cpus"]
_FACTS += [f"round(100 * count_if({c} AND s = '{s}') / nullif(count_if({c}), 0), 6) AS {k}{s.lower()}" for k, c in _KINDS.items() for s in ("COMPLETED", "FAILED", "CANCELLED")]
_add("ag_user_full", lambda t: users.all_facts(t.jobs), f"""SELECT user_id, {', '.join(_FACTS)}, min(submit_time) AS first, max(submit_time) AS last
    FROM (SELECT *, greatest({_SECONDS}, 0) AS d, greatest(date_diff('second', submit_time, start_time), 0) AS q, {_STATE} AS s FROM jobs WHERE user_id IS NOT NULL) GROUP BY 1""")
_AGG = ", ".join(f"CAST(sum({m}) AS BIGINT) AS sum_{m}, round(sum({m}) / count({m}), 6) AS mean_{m}, max({m}) AS max_{m}, round(quantile_cont({m}, 0.5), 6) AS median_{m}" for m in users.MEASURES)
_done = lambda c: f"round(100 * count_if({c} AND state = 'COMPLETED') / nullif(count_if({c}), 0), 6)"
_add("ag_user_agg", lambda t: users.aggregates(_log(t)), f"""SELECT "user", {_AGG}, {_done('true')} AS done, {_done('gpu_num > 0')} AS gpu_done, {_done('NOT gpu_num > 0')} AS cpu_done FROM log GROUP BY 1""")
_list = lambda name, x: f"""(SELECT "user", string_agg(k || ':' || n, ',' ORDER BY k) AS {name} FROM (SELECT "user", {x} AS k, count(*) AS n FROM log LEFT JOIN prim USING (job_id) WHERE {x} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
_add("ag_user_metrics", lambda t: users.metrics(_log(t), sampling.primary_subcluster(t.jobs).select("job_id", "subcluster")), f"""SELECT "user", types, states, coalesce(subclusters, '') AS subclusters, node_hours, mean_queue, completed FROM {_list('types', "CASE WHEN gpu_num > 0 THEN 'gpu' ELSE 'cpu' END")} JOIN {_list('states', 'state')} USING ("user") LEFT JOIN {_list('subclusters', 'subcluster')} USING ("user")
    JOIN (SELECT "user", round(sum(node_num * duration) / 3600, 6) AS node_hours, round(sum(queue) / count(queue), 6) AS mean_queue, round(100 * count_if(state = 'COMPLETED') / count(*), 6) AS completed FROM log GROUP BY 1) USING ("user")""")

# Suspicious users: a log in which one user submits evenly and one in crowds.
_CROWD = """SELECT * REPLACE (CASE WHEN job_id % 5 = 0 THEN 'robot' WHEN job_id % 5 = 1 THEN 'crowd' WHEN job_id % 5 = 2 THEN 'u' || (job_id % 50) ELSE user_id END AS user_id, CASE WHEN job_id % 5 = 1 THEN TIMESTAMP '2024-01-14 10:00:00' + INTERVAL 1 SECOND * (job_id % 50) ELSE submit_time END AS submit_time,
    CASE WHEN job_id % 5 = 0 THEN start_time + INTERVAL 1 SECOND * (1000 + job_id % 3) ELSE end_time END AS end_time) FROM jobs"""
_VIEWS["crowd"] = _CROWD


def _crowd(t):
    k = F.col("job_id") % 5
    user = F.when(k == 0, "robot").when(k == 1, "crowd").when(k == 2, F.concat(F.lit("u"), (F.col("job_id") % 50).cast("string"))).otherwise(F.col("user_id"))
    second = lambda n: F.make_dt_interval(secs=n.cast("decimal(18,6)"))
    at = F.when(k == 1, F.expr("timestamp_ntz'2024-01-14 10:00:00'") + second(F.col("job_id") % 50)).otherwise(F.col("submit_time"))
    end = F.when(k == 0, F.col("start_time") + second(1000 + F.col("job_id") % 3)).otherwise(F.col("end_time"))
    return t.jobs.withColumns({"user_id": user, "submit_time": at, "end_time": end})


_add("anm_user_score", lambda t: sampling.user_scores(_crowd(t)), f"""SELECT * FROM (SELECT user_id, jobs, names, burst, cv, CAST(CASE WHEN burst > 100 THEN 3 ELSE 0 END + CASE WHEN names / jobs < 0.1 THEN 2 ELSE 0 END + CASE WHEN cv < 0.1 AND jobs > 1000 THEN 2 ELSE 0 END + CASE WHEN jobs > 10000 THEN 3 ELSE 0 END AS BIGINT) AS score,
    concat_ws(',', CASE WHEN burst > 100 THEN 'burst' END, CASE WHEN names / jobs < 0.1 THEN 'few names' END, CASE WHEN cv < 0.1 AND jobs > 1000 THEN 'even durations' END, CASE WHEN jobs > 10000 THEN 'very many jobs' END) AS reasons
    FROM (SELECT user_id, count(*) AS jobs, count(DISTINCT job_name) AS names, CASE WHEN avg({_SECONDS}) > 0 THEN round(stddev_samp({_SECONDS}) / avg({_SECONDS}), 6) END AS cv FROM crowd WHERE user_id IS NOT NULL GROUP BY 1 HAVING count(*) > 100)
    LEFT JOIN (SELECT user_id, max(n) AS burst FROM (SELECT user_id, date_trunc('minute', submit_time) AS m, count(*) AS n FROM crowd WHERE user_id IS NOT NULL AND submit_time IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (user_id)) WHERE score >= 3""")
_LEVEL = """SELECT day, n, CASE WHEN n >= e THEN 'extreme' WHEN n >= s THEN 'severe' WHEN n >= 340 THEN 'moderate' ELSE 'normal' END AS level FROM days, (SELECT greatest(1000, 10 * q2, m + 5 * sd) AS e, greatest(400, q2 + 3 * (q3 - q1), m + 3 * sd) AS s
    FROM (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, avg(n) AS m, stddev_samp(n) AS sd FROM days))"""
_add("jn_bounds_back", lambda t: _burst(t).withColumn("day", F.to_date("submit_time")).join(sampling.daily_levels(_burst(t)), "day", "left").select("job_id", "day", F.col("n").alias("day_jobs"), "level"), f"SELECT job_id, CAST(submit_time AS DATE) AS day, n AS day_jobs, level FROM burst b LEFT JOIN ({_LEVEL}) l ON l.day = CAST(b.submit_time AS DATE)")

# Telemetry
_VIEWS["p99s"] = "SELECT metric, quantile_cont(value, 0.99) AS p99 FROM tel GROUP BY 1"
_add("tel_clip_p99", lambda t: telemetry.clipped(_tel(t)), f"SELECT metric, CAST(ts AS DATE) AS day, {_mean('least(value, 200)')} AS clipped, {_mean('CASE WHEN value <= p99 THEN value END')} AS without, count_if(value > p99) AS n_over, count(*) AS n, round(max(p99), 6) AS p99 FROM tel JOIN p99s USING (metric) GROUP BY 1, 2")


def _ends(name: str, by: str, low: bool = False) -> str:
    more = f", arg_min(k, (m, k)) AS low_{name}" if low else ""
    return f"(SELECT metric, arg_min(k, (-m, k)) AS top_{name}, max(m) AS top_{name}_mean{more} FROM (SELECT metric, {by} AS k, {_mean('value')} AS m FROM tel GROUP BY 1, 2) GROUP BY 1)"


_add("tel_report", lambda t: telemetry.report(_tel(t)), f"""SELECT * FROM (SELECT metric, count(*) AS n, {_mean('value')} AS mean, min(value) AS least, max(value) AS most, count(DISTINCT server) AS servers, round(count_if(value > 80) / count(*), 9) AS above_80, round(count_if(value > 90) / count(*), 9) AS above_90,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM tel GROUP BY 1) JOIN {_ends('hour', 'CAST(hour(ts) AS BIGINT)')} USING (metric) JOIN {_ends('weekday', _WD.format('ts'))} USING (metric) JOIN {_ends('server', 'server', True)} USING (metric)""")

# Names that no server has as they are: dotted, in capitals, misspelt.
_odd = lambda t: telemetry.job_hosts(t.jobs).select(F.expr("CASE job_id % 5 WHEN 1 THEN concat(upper(replace(server, '1-', '1_')), '.Local') WHEN 2 THEN concat('x', server) WHEN 3 THEN replace(replace(server, 'gpu', 'gqu'), 'big', 'bg') ELSE server END").alias("host"))
_VIEWS["odd"] = "SELECT DISTINCT CASE job_id % 5 WHEN 1 THEN upper(replace(host, '1-', '1_')) || '.Local' WHEN 2 THEN 'x' || host WHEN 3 THEN replace(replace(host, 'gpu', 'gqu'), 'big', 'bg') ELSE host END AS host FROM hosts WHERE host IS NOT NULL"
_group = lambda x: f"CASE WHEN {x} LIKE 'cpu1-%' THEN 'CPU1' WHEN {x} LIKE 'cpu2-%' THEN 'CPU2' WHEN {x} LIKE 'cpu3-%' THEN 'CPU3' WHEN {x} LIKE 'gpu1-%' THEN 'GPU1' WHEN {x} LIKE 'bigmem-%' THEN 'BIGMEM' ELSE 'UNKNOWN' END"
_norm = lambda x: f"regexp_replace(regexp_replace(lower({x}), '[.].*$', ''), '[^a-z0-9]', '', 'g')"
_add("jn_server_resolve", lambda t: capacity.resolved(_odd(t), _tel(t)), f"""SELECT host, coalesce(same, other, nearest) AS server, CASE WHEN same IS NOT NULL THEN 'same' WHEN other IS NOT NULL THEN 'group' WHEN nearest IS NOT NULL THEN 'name' ELSE 'none' END AS how
    FROM (SELECT host, {_group('host')} AS s FROM odd) LEFT JOIN (SELECT DISTINCT server AS same FROM tel) ON same = host LEFT JOIN (SELECT {_group('server')} AS s, min(server) AS other FROM tel WHERE {_group('server')} <> 'UNKNOWN' GROUP BY 1) USING (s)
    LEFT JOIN (SELECT host, arg_min(server, (far, server)) AS nearest FROM (SELECT host, server, levenshtein({_norm('host')}, {_norm('server')}) AS far FROM odd, (SELECT DISTINCT server FROM tel)) WHERE far <= 1 GROUP BY 1) USING (host)""")

# Quality of the log as text
_TYPES = {"job_id": "long", "user_id": "string", "cpu_num": "long", "gpu_num": "long", "exit_status": "long", "submit_time": "timestamp_ntz", "start_time": "timestamp_ntz", "end_time": "timestamp_ntz"}
_at = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_VIEWS["raw_text"] = f"""SELECT job_id::VARCHAR AS job_id, CASE WHEN job_id % 31 = 4 THEN '' ELSE user_id END AS user_id, CASE WHEN job_id % 41 = 7 THEN 'many' WHEN job_id % 53 = 9 THEN '9999' ELSE cpu_num::VARCHAR END AS cpu_num, gpu_num::VARCHAR AS gpu_num, CASE WHEN job_id % 37 = 5 THEN 'killed' ELSE exit_status::VARCHAR END AS exit_status,
    CASE WHEN job_id % 43 = 6 THEN 'no time' ELSE {_at('submit_time')} END AS submit_time, {_at('start_time')} AS start_time, {_at('end_time')} AS end_time FROM (SELECT *, unnest(CASE WHEN job_id % 29 = 3 THEN [1, 2] ELSE [1] END) FROM jobs)"""


def _raw_text(t):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    k = F.col("job_id")
    twice = t.jobs.withColumn("_", F.explode(F.when(k % 29 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = lambda c: F.col(c).cast("string")
    return twice.select(
        text("job_id").alias("job_id"), F.when(k % 31 == 4, "").otherwise(F.col("user_id")).alias("user_id"), F.when(k % 41 == 7, "many").when(k % 53 == 9, "9999").otherwise(text("cpu_num")).alias("cpu_num"), text("gpu_num").alias("gpu_num"),
        F.when(k % 37 == 5, "killed").otherwise(text("exit_status")).alias("exit_status"), F.when(k % 43 == 6, "no time").otherwise(at("submit_time")).alias("submit_time"), at("start_time").alias("start_time"), at("end_time").alias("end_time"),
    )


_DUCK = {"long": "BIGINT", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}
_PER = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS different, round(count(TRY_CAST({c} AS {_DUCK[ty]})) / nullif(count({c}), 0), 9) AS typed, round(count_if(length({c}) > 0) / nullif(count({c}), 0), 9) AS filled FROM raw_text" for c, ty in _TYPES.items())
_FAR = " UNION ALL ".join(f"SELECT round(count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(*), 9) AS outside FROM (SELECT TRY_CAST({c} AS DOUBLE) AS v FROM raw_text), (SELECT quantile_cont(TRY_CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(TRY_CAST({c} AS DOUBLE), 0.75) AS q3 FROM raw_text) WHERE v IS NOT NULL" for c, ty in _TYPES.items() if ty == "long")
_T3 = ", ".join(f"TRY_CAST({c} AS TIMESTAMP) AS {c}" for c in quality.TIMES)
_add("dq_assess", lambda t: quality.assess(_raw_text(t), _TYPES), f"""SELECT *, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *, round(0.3::DOUBLE * completeness + 0.25::DOUBLE * consistency + 0.25::DOUBLE * validity + 0.2::DOUBLE * uniqueness, 6) AS score FROM
    (SELECT round(sum(n) / sum(n + nulls), 9) AS completeness, round(avg(coalesce(typed, 1)), 9) AS consistency, round(avg(CASE WHEN name IN ('user_id', 'job_id', 'exit_status') THEN least(typed, filled) END), 9) AS validity, round(max(CASE WHEN name = 'job_id' THEN different / n END), 9) AS key_uniqueness FROM ({_PER})),
    (SELECT count(*) AS "rows", round((SELECT count(*) FROM (SELECT DISTINCT * FROM raw_text)) / count(*), 9) AS uniqueness FROM raw_text),
    (SELECT round(count_if(submit_time <= start_time AND start_time <= end_time) / count_if(submit_time IS NOT NULL AND start_time IS NOT NULL AND end_time IS NOT NULL), 9) AS time_logic, round(greatest(0, 1 - date_diff('second', greatest(max(submit_time), max(start_time), max(end_time)), TIMESTAMP '2024-03-01') // 86400 / 365), 9) AS freshness FROM (SELECT {_T3} FROM raw_text)),
    (SELECT round(1 - avg(outside), 9) AS within_ranges FROM ({_FAR})))""")

# CSV text
_VIEWS["records"] = """SELECT *, CASE WHEN job_id % 13 = 5 OR (job_id % 17 = 6 AND job_id % 13 <> 5) OR job_id % 19 = 2 THEN 'corrupt' WHEN job_id % 11 = 3 THEN 'coerced' ELSE 'good' END AS status,
    job_name || CASE WHEN job_id % 3 = 0 THEN ' "x"' ELSE '' END || CASE WHEN job_id % 5 = 0 THEN chr(10) || 'and, more' ELSE '' END AS name FROM jobs"""
_add("src_csv_typed", lambda t: csv_text.parsed(csv_text.jobs_as_text(t.jobs)).groupBy("status").agg(F.count("*").alias("n"), F.count("bad").alias("kept"), F.count("job_id").alias("ids"), F.count_if(F.col("job_name").contains("\n") & (F.col("status") == "good")).alias("broken_lines")),
     "SELECT status, count(*) AS n, count_if(status <> 'good') AS kept, count(*) AS ids, count_if(contains(name, chr(10)) AND status = 'good') AS broken_lines FROM records GROUP BY 1")
_add("src_csv_jobs", lambda t: csv_text.parsed(csv_text.jobs_as_text(t.jobs)).where("status <> 'corrupt'").select("job_id", F.col("job_name").alias("name"), "cpu_num", "status", F.round(C.seconds("submit_time", "start_time") / 60, 6).alias("queue_min"), F.round(C.seconds("start_time", "end_time") / 60, 6).alias("run_min")).where("run_min > 0"),
     f"SELECT * FROM (SELECT job_id, name, CASE WHEN job_id % 11 <> 3 THEN cpu_num END AS cpu_num, status, round(date_diff('second', submit_time, start_time) / 60, 6) AS queue_min, round({_SECONDS} / 60, 6) AS run_min FROM records WHERE status <> 'corrupt') WHERE run_min > 0")

# Amounts and states
_CODES = [32, 1, 2, 3, 4, 99, None]
_add("fn_status_map", lambda t: t.jobs.withColumn("code", F.element_at(F.array(*map(F.lit, _CODES)), (F.col("job_id") % 7 + 1).cast("int"))).withColumn("text", F.when(F.col("job_id") % 3 == 0, F.lower("job_status_str")).when(F.col("job_id") % 10 == 1, "TIMEOUT")).select("job_id", C.layered_state("text", "code", "exit_status").alias("m")).select("job_id", "m.state", "m.confidence"),
     """SELECT job_id, coalesce(a, b, c, 'Unknown') AS state, CASE WHEN a IS NOT NULL THEN 0.9::DOUBLE WHEN b IS NOT NULL THEN 0.8::DOUBLE WHEN c IS NOT NULL THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM (SELECT job_id, CASE upper(text) WHEN 'DONE' THEN 'Pass' WHEN 'EXIT' THEN 'Failed' WHEN 'TIMEOUT' THEN 'Killed' END AS a,
    CASE code WHEN 32 THEN 'Pass' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Failed' WHEN 3 THEN 'Killed' WHEN 4 THEN 'Killed' END AS b, CASE WHEN exit_status = 0 THEN 'Pass' WHEN exit_status IN (1, 2, 130, 143) THEN 'Failed' END AS c
    FROM (SELECT *, [32, 1, 2, 3, 4, 99, NULL][job_id % 7 + 1] AS code, CASE WHEN job_id % 3 = 0 THEN lower(job_status_str) WHEN job_id % 10 = 1 THEN 'TIMEOUT' END AS text FROM jobs))""")
_FORMS = ["{} MB", "{}gb", "{} T", "{}k", "{}", "{}000", "none"]
_TIMES = ["{}:30:00", "{}:15", "{} days", "{}h", "{} min", "{} s", "{}", "{}00000", "soon"]
_form = lambda forms, x: f"CASE {x} % {len(forms)} " + " ".join(f"WHEN {i} THEN concat('{a}', cpu_num, '{b}')" for i, (a, _, b) in enumerate(f.partition("{}") if "{}" in f else (f, "", None) for f in forms) if b is not None) + f" ELSE '{forms[-1]}' END"
_MEM, _RUN = _form(_FORMS, "job_id"), _form(_TIMES, "job_id")
_add("fn_resource_norm", lambda t: t.jobs.selectExpr("job_id", f"{_MEM} AS mem", f"{_RUN} AS run", "concat(cpu_num, ' cores') AS cores").select("job_id", F.round(C.gigabytes("mem"), 6).alias("gb"), F.round(C.run_hours("run"), 6).alias("hours"), C.bare_count("cores").alias("cores")), f"""SELECT job_id,
    round(CASE WHEN contains(lower(mem), 't') THEN g * 1024 WHEN contains(lower(mem), 'g') THEN g WHEN contains(lower(mem), 'm') THEN g / 1024 WHEN contains(lower(mem), 'k') THEN g / 1048576 WHEN g > 10000 THEN g / 1024 ELSE g END, 6) AS gb,
    round(coalesce(CASE len(p) WHEN 3 THEN p[1]::INT + p[2]::INT / 60 + p[3]::INT / 3600 WHEN 2 THEN p[1]::INT / 60 + p[2]::INT / 3600 END, CASE WHEN u = 'days' THEN h * 24 WHEN u = 'h' THEN h WHEN u = 'min' THEN h / 60 WHEN u = 's' THEN h / 3600 END, CASE WHEN h > 10000 THEN h / 3600 ELSE h END), 6) AS hours, cpu_num::DOUBLE AS cores
    FROM (SELECT *, TRY_CAST(regexp_extract(mem, '([0-9]+[.]?[0-9]*)', 1) AS DOUBLE) AS g, TRY_CAST(regexp_extract(run, '([0-9]+[.]?[0-9]*)', 1) AS DOUBLE) AS h, regexp_extract(run, '[0-9]+[.]?[0-9]*\\s*([a-z]*)', 1) AS u, string_split(run, ':') AS p FROM (SELECT *, {_MEM} AS mem, {_RUN} AS run FROM jobs))""")
