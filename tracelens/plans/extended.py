"""Further queries: small projections, capacity, classification, telemetry facts. Each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.functions import columns as C
from tracelens.operators import capacity, classify, cleaning, exact, inference, sampling, telemetry, traces, users
from tracelens.plans.registry import _SECONDS, _TYPE, _VIEWS, _WD, _add, _burst, _log, _mean, _tel
from tracelens.sources.views import Tables
from tracelens.streaming import series

_SUB = "CASE WHEN {} LIKE 'cpu1-%' THEN 'CPU1' WHEN {} LIKE 'cpu2-%' THEN 'CPU2' WHEN {} LIKE 'cpu3-%' THEN 'CPU3' WHEN {} LIKE 'gpu1-%' THEN 'GPU1' WHEN {} LIKE 'bigmem-%' THEN 'BIGMEM' ELSE 'UNKNOWN' END"


def _sub(x: str) -> str:
    return _SUB.replace("{}", x)


_NODES, _CORES, _GPUS = ("CASE subcluster " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in capacity.SPEC.items()) + " END" for i in range(3))
_VIEWS["prim"] = f"SELECT job_id, arg_min(s, (-n, s)) AS subcluster, max(n) AS hosts FROM (SELECT job_id, {_sub('host')} AS s, count(*) AS n FROM hosts WHERE host IS NOT NULL GROUP BY 1, 2) GROUP BY 1"
_VIEWS["jh"] = "SELECT DISTINCT h.job_id, h.server, h.hour, cpu_total, gpu_util, load_1min, power, w.server IS NULL AS all_null FROM jobhour h LEFT JOIN wide w ON w.server = h.server AND w.hour = h.hour WHERE w.server IS NOT NULL OR h.server NOT IN (SELECT server FROM tel)"

# Sources and projections
_TOKENS = ["", "NA", "null", "NULL", "none", "None"]
_add("src_na_tokens", lambda t: t.table("orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in _TOKENS], F.lit("7"), F.lit(" x")), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("v")).select("o_orderkey", F.when(~F.col("v").isin(*_TOKENS), F.col("v")).alias("v")), "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 6 THEN '7' WHEN 7 THEN ' x' END AS v FROM orders")
_add("src_sheet_filter", lambda t: t.telemetry.where(~F.col("server").rlike("-4$")).select(F.regexp_replace("server", "^bigmem-", "bigman-").alias("server"), "metric").groupBy("server", "metric").agg(F.count("*").alias("n")), "SELECT regexp_replace(server, '^bigmem-', 'bigman-') AS server, metric, count(*) AS n FROM raw WHERE server NOT LIKE '%-4' GROUP BY 1, 2")
_add("src_multi_trace", lambda t: _log(t).where("job_id % 2 = 0").withColumn("cluster", F.lit("a")).unionByName(_log(t).where("job_id % 2 = 1").withColumn("cluster", F.lit("b"))).groupBy("cluster").agg(F.count("*").alias("n")), "SELECT CASE WHEN job_id % 2 = 0 THEN 'a' ELSE 'b' END AS cluster, count(*) AS n FROM log GROUP BY 1")


def rename_replacing(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with columns renamed; a column that has a target's name already gives way."""
    have = {k: v for k, v in names.items() if k in df.columns}
    return df.drop(*have.values()).withColumnsRenamed(have)


_add("prj_rename_prefer", lambda t: rename_replacing(t.jobs.select("job_id", "user_id", F.coalesce("user_id", F.lit("inferred")).alias("final_user_id")), {"final_user_id": "user_id", "absent": "x"}), "SELECT job_id, coalesce(user_id, 'inferred') AS user_id FROM jobs")
_add("prj_alias_pick", lambda t: t.jobs.select("job_id", F.col(next(c for c in ("num_gpu", "gpus", "gpu_num") if c in t.jobs.columns)).alias("gpu"), F.col(next(c for c in ("processors", "cpu_num") if c in t.jobs.columns)).alias("cpu")), "SELECT job_id, gpu_num AS gpu, cpu_num AS cpu FROM jobs")
_add("flt_duration", lambda t: t.jobs.select(C.seconds("start_time", "end_time").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("d") <= 0).alias("removed"), F.count_if(F.col("d") > 365 * 86400).alias("over_a_year"), F.round(1 - F.count_if(F.col("d") <= 0) / F.count("*"), 9).alias("retention")), f"SELECT count(*) AS n, count_if({_SECONDS} <= 0) AS removed, count_if({_SECONDS} > 365 * 86400) AS over_a_year, round(1 - count_if({_SECONDS} <= 0) / count(*), 9) AS retention FROM jobs")
_add("flt_status_replace", lambda t: t.jobs.select("job_id", F.coalesce("job_status_str", F.lit("RUNNING")).alias("s")).select("job_id", F.when(F.col("s").isin("PENDING", "RUNNING"), "FAILED").otherwise(F.col("s")).alias("state")), "SELECT job_id, coalesce(job_status_str, 'FAILED') AS state FROM jobs")
_add("prd_zero_resource", lambda t: t.jobs.withColumn("cpu_num", F.col("cpu_num") - 1).where("cpu_num = 0 and gpu_num = 0").select("job_id"), "SELECT job_id FROM jobs WHERE cpu_num = 1 AND gpu_num = 0")
_add("tim_derive", lambda t: t.jobs.select("job_id", C.seconds("start_time", "end_time").alias("duration"), C.seconds("submit_time", "start_time").alias("queue_time")), f"SELECT job_id, {_SECONDS} AS duration, date_diff('second', submit_time, start_time) AS queue_time FROM jobs")
_add("tim_est_batch", lambda t: t.jobs.where("submit_time is null").select("job_id", (F.col("start_time") - F.expr("interval 300 seconds")).alias("submit_time")), "SELECT job_id, start_time - INTERVAL 300 SECOND AS submit_time FROM jobs WHERE submit_time IS NULL")
_GUESS = "SELECT user_id, max(submit_time) + INTERVAL 1 SECOND * CAST(floor(date_diff('second', min(submit_time), max(submit_time)) / (count(*) - 1)) AS BIGINT) AS guess FROM jobs WHERE user_id IS NOT NULL AND submit_time IS NOT NULL GROUP BY 1 HAVING count(*) >= 10"
_add("tim_est_user", lambda t: cleaning.repair(t.jobs).where("how = 'user'").select("job_id", "submit_time"), f"SELECT job_id, guess AS submit_time FROM jobs JOIN ({_GUESS}) USING (user_id) WHERE submit_time IS NULL")
_add("tim_pipeline", lambda t: cleaning.repair(t.jobs).groupBy("how").agg(F.count("*").alias("n"), F.count_if(F.col("start_time").isNull() | F.col("end_time").isNull()).alias("unrecoverable")), f"SELECT CASE WHEN submit_time IS NOT NULL THEN 'known' WHEN guess IS NOT NULL THEN 'user' WHEN start_time IS NOT NULL THEN 'start' ELSE 'none' END AS how, count(*) AS n, count_if(start_time IS NULL OR end_time IS NULL) AS unrecoverable FROM jobs LEFT JOIN ({_GUESS}) USING (user_id) GROUP BY 1")

# Functions
_add("fn_trunc", lambda t: t.jobs.select("job_id", F.date_trunc("hour", "submit_time").cast("timestamp_ntz").alias("h"), F.date_trunc("minute", "submit_time").cast("timestamp_ntz").alias("m"), F.date_trunc("hour", F.col("submit_time") + F.expr("interval 3599999999 microseconds")).cast("timestamp_ntz").alias("up")), "SELECT job_id, date_trunc('hour', submit_time) AS h, date_trunc('minute', submit_time) AS m, date_trunc('hour', submit_time + INTERVAL 3599999999 MICROSECOND) AS up FROM jobs")
_add("fn_job_type_simple", lambda t: t.jobs.select("job_id", F.when(F.coalesce(F.col("exec_hosts").contains("gpu"), F.lit(False)), "GPU").otherwise("CPU").alias("kind")), "SELECT job_id, CASE WHEN contains(exec_hosts, 'gpu') THEN 'GPU' ELSE 'CPU' END AS kind FROM jobs")
_add("fn_id_numeric", lambda t: t.jobs.select("job_id", F.regexp_extract("job_name", r"(\d+)", 1).cast("long").alias("n")), "SELECT job_id, CAST(regexp_extract(job_name, '([0-9]+)', 1) AS BIGINT) AS n FROM jobs")
_add("fn_ratio", lambda t: t.jobs.select("job_id", F.round(F.try_divide("gpu_num", F.col("cpu_num") - 1), 3).alias("r")), "SELECT job_id, round(gpu_num / nullif(cpu_num - 1, 0), 3) AS r FROM jobs")
_add("fn_map_evidence", lambda t: t.jobs.select("job_id", F.to_json(F.struct(F.col("gpu_num").alias("gpus"), F.struct("queue").alias("where"))).alias("evidence")), """SELECT job_id, '{"gpus":' || gpu_num || ',"where":{"queue":"' || queue || '"}}' AS evidence FROM jobs""")
_add("fn_fingerprint", lambda t: t.jobs.select("job_id", F.md5(F.concat_ws("|", F.coalesce("command", F.lit("")), F.col("cpu_num").cast("string"), F.col("gpu_num").cast("string"), "queue", "job_name").cast("binary")).alias("f")), "SELECT job_id, md5(concat_ws('|', coalesce(command, ''), cpu_num, gpu_num, queue, job_name)) AS f FROM jobs")
_PATTERNS = [("json", r"^\{"), ("bracket_range", r"\[[0-9]+-[0-9]+\]"), ("plus", r"\+"), ("comma", ","), ("single", r"^[a-z0-9]+-[0-9]+$")]


def _pattern() -> F.Column:
    out = F.lit("other")
    for name, p in reversed(_PATTERNS):
        out = F.when(F.col("exec_hosts").rlike(p), name).otherwise(out)
    return F.when(F.col("exec_hosts").isNull(), "empty").otherwise(out)
_add("fn_job_type4", lambda t: sampling.host_counts(t.jobs).groupBy("kind").agg(F.count("*").alias("n")), "SELECT CASE WHEN c > 0 AND g > 0 THEN 'mixed' WHEN g > 0 THEN 'gpu' WHEN c > 0 THEN 'cpu' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT j.job_id, count(*) FILTER (host LIKE 'cpu%') AS c, count(*) FILTER (host LIKE 'gpu%') AS g FROM jobs j LEFT JOIN hosts h ON h.job_id = j.job_id GROUP BY 1) GROUP BY 1")
_add("fn_hosts_pattern", lambda t: t.jobs.groupBy(_pattern().alias("pattern")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.size(C.hosts("exec_hosts")) > 0, 1.0).otherwise(0.0)), 6).alias("parsed")),
     "SELECT CASE WHEN exec_hosts IS NULL THEN 'empty' " + " ".join(f"WHEN regexp_matches(exec_hosts, '{p}') THEN '{k}'" for k, p in _PATTERNS) + " ELSE 'other' END AS pattern, count(*) AS n, round(avg((h.job_id IS NOT NULL)::INT), 6) AS parsed FROM jobs j LEFT JOIN (SELECT DISTINCT job_id FROM hosts WHERE host IS NOT NULL) h ON h.job_id = j.job_id GROUP BY 1")
_add("fn_json_hosts", lambda t: t.jobs.where("exec_hosts like '{%'").select("job_id", F.explode(F.from_json(F.get_json_object("exec_hosts", "$.nodes"), "array<string>")).alias("host")),  "SELECT job_id, unnest(json_extract(exec_hosts, '$.nodes')::VARCHAR[]) AS host FROM jobs WHERE starts_with(exec_hosts, '{')")
_add("fn_kv_hosts", lambda t: t.jobs.select("job_id", F.concat(F.lit("host="), F.split("exec_hosts", r"[,+]")[0], F.lit(" task=3")).alias("kv")).select("job_id", F.regexp_extract_all("kv", F.lit(r"(?:host|node)=([^\s]+)"), F.lit(1))[0].alias("host")).where("host is not null"), "SELECT job_id, regexp_extract(exec_hosts, '^[^,+]*') AS host FROM jobs WHERE exec_hosts IS NOT NULL")
_add("fn_node_clean", lambda t: t.jobs.select("job_id", F.regexp_replace(F.regexp_replace(F.lower(F.concat("exec_hosts", F.lit(".LOCAL"))), r"\.(local|domain|com)$", ""), "[^a-z0-9-]", "").alias("node")), "SELECT job_id, regexp_replace(lower(exec_hosts), '[^a-z0-9-]', '', 'g') AS node FROM jobs")
_add("fn_exec_hosts_label", lambda t: t.jobs.select("job_id", C.hosts("exec_hosts").alias("h")).where("h is not null").select("job_id", F.when(F.size("h") > 2, F.concat(F.array_join(F.slice("h", 1, 2), ","), F.lit(" and "), (F.size("h") - 2).cast("string"), F.lit(" more"))).otherwise(F.array_join("h", ",")).alias("label")),
     "SELECT job_id, CASE WHEN len(h) > 2 THEN h[1] || ',' || h[2] || ' and ' || (len(h) - 2) || ' more' ELSE array_to_string(h, ',') END AS label FROM (SELECT job_id, list(host) AS h FROM hosts WHERE host IS NOT NULL GROUP BY 1)")
_add("fn_subcluster", lambda t: telemetry.job_hosts(t.jobs).select("job_id", "server", C.subcluster(F.col("server")).alias("subcluster")), f"SELECT job_id, host AS server, {_sub('host')} AS subcluster FROM hosts WHERE host IS NOT NULL")
_add("fn_server_group", lambda t: _tel(t).select("server").distinct().select("server", C.subcluster(F.col("server")).alias("grp")), f"SELECT DISTINCT server, {_sub('server')} AS grp FROM tel")
_add("jn_group_mapping", lambda t: _tel(t).groupBy(C.subcluster(F.col("server")).alias("grp")).agg(F.count_distinct("server").alias("servers"), F.count("*").alias("n")), "SELECT grp, count(DISTINCT server) AS servers, count(*) AS n FROM grp GROUP BY 1")
_add("fn_resources", lambda t: capacity.resources(t.jobs), f"SELECT job_id, CAST(sum({_CORES}) AS BIGINT) AS cores, CAST(sum({_GPUS}) AS BIGINT) AS gpus, count(*) AS nodes FROM (SELECT job_id, {_sub('host')} AS subcluster FROM hosts WHERE host IS NOT NULL) GROUP BY 1")
_add("jn_spec_prefix", lambda t: capacity.host_spec(t.jobs), f"SELECT job_id, server, subcluster, CAST({_CORES} AS BIGINT) AS cores, CAST({_GPUS} AS BIGINT) AS gpus FROM (SELECT job_id, host AS server, {_sub('host')} AS subcluster FROM hosts WHERE host IS NOT NULL)")
_add("fn_time_multi", lambda t: t.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.unix_timestamp("o_orderdate").cast("string")).alias("x")).select("o_orderkey", F.coalesce(*[F.try_to_timestamp(F.col("x"), F.lit(f)) for f in ("yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")], F.when(F.col("x").try_cast("long").between(1, 4102444799), F.timestamp_seconds(F.col("x").try_cast("long")))).cast("timestamp_ntz").alias("at")),
     "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN date_trunc('day', o_orderdate) ELSE o_orderdate END::TIMESTAMP AS at FROM orders")
_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyyMMdd HHmmss", "MM/dd/yyyy HH:mm:ss"]
_add("fn_time_formats5", lambda t: t.jobs.where("submit_time is not null").select("job_id", F.element_at(F.array(*[F.date_format("submit_time", f) for f in _FORMATS]), (F.col("job_id") % 5 + 1).cast("int")).alias("x")).select("job_id", F.coalesce(*[F.try_to_timestamp(F.col("x"), F.lit(f)) for f in _FORMATS]).cast("timestamp_ntz").alias("at")),
     "SELECT job_id, CASE WHEN job_id % 5 = 2 THEN date_trunc('minute', submit_time) ELSE submit_time END AS at FROM jobs WHERE submit_time IS NOT NULL")
_add("fn_status_map2", lambda t: t.jobs.select("job_id", F.when(F.col("job_status_str") == "DONE", "Pass").when(F.col("job_status_str") == "EXIT", "Failed").when(F.col("exit_status") == 0, "Pass").otherwise("Killed").alias("state")), "SELECT job_id, CASE WHEN job_status_str = 'DONE' THEN 'Pass' WHEN job_status_str = 'EXIT' THEN 'Failed' WHEN exit_status = 0 THEN 'Pass' ELSE 'Killed' END AS state FROM jobs")

# Joins
_add("jn_equi_metric", lambda t: _log(t).groupBy(F.date_trunc("hour", "start_time").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("started"), F.sum(F.col("node_num") * F.col("duration")).alias("node_seconds")), "SELECT date_trunc('hour', start_time) AS hour, count(*) AS started, CAST(sum(node_num * duration) AS BIGINT) AS node_seconds FROM log GROUP BY 1")
_OK = "state = 'COMPLETED'"
_add("jn_user_left3", lambda t: _log(t).groupBy("user").agg(F.count("*").alias("jobs"), F.count_if(F.expr("gpu_num > 0")).alias("gpu"), F.count_if(F.expr(_OK)).alias("done"), F.count_if(F.expr(f"{_OK} and gpu_num > 0")).alias("gpu_done")), f"""SELECT "user", count(*) AS jobs, count_if(gpu_num > 0) AS gpu, count_if({_OK}) AS done, count_if({_OK} AND gpu_num > 0) AS gpu_done FROM log GROUP BY 1""")
_STRAT = "SELECT submit_time FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(user_id, '') ORDER BY md5('s1-' || job_id), job_id) AS r, count(*) OVER (PARTITION BY coalesce(user_id, '')) AS n FROM burst) WHERE r <= greatest(1, floor(0.2::DOUBLE * n))"
_add("jn_day_compare", lambda t: sampling.compare_days(_burst(t), sampling.stratified(_burst(t), "user_id", 0.2)), f"SELECT day, n, coalesce(kept, 0) AS kept, round(coalesce(kept, 0) / n, 9) AS rate FROM days LEFT JOIN (SELECT CAST(submit_time AS DATE) AS day, count(*) AS kept FROM ({_STRAT}) WHERE submit_time IS NOT NULL GROUP BY 1) USING (day)")
_add("jn_overlap_window", lambda t: capacity.windows(_log(t)), "SELECT hour, count(*) AS jobs, CAST(sum(gpu_num) AS BIGINT) AS gpus FROM (SELECT gpu_num, unnest(generate_series(date_trunc('hour', start_time), end_time, INTERVAL 1 HOUR)) AS hour FROM log) GROUP BY 1")
_add("jn_overlap_self", lambda t: capacity.overlapping_gpus(_log(t)), "SELECT a.job_id, CAST(sum(b.gpu_num) AS BIGINT) AS gpus FROM log a JOIN log b ON b.start_time <= a.end_time AND b.end_time >= a.start_time GROUP BY 1")

# Aggregates
_add("ag_basic_stats_trace", lambda t: _log(t).withColumn("k", F.explode(F.array(F.lit("all")))).groupBy("k").agg(F.count("*").alias("jobs"), F.count_distinct("user").alias("users"), F.round(F.avg("gpu_num"), 6).alias("mean_gpus"), F.max("duration").alias("longest")).join(exact.wide_quantiles(_log(t).withColumn("k", F.explode(F.array(F.lit("all")))), ["k"], "duration", {"median": 0.5}), "k").drop("k"), """SELECT count(*) AS jobs, count(DISTINCT "user") AS users, round(avg(gpu_num), 6) AS mean_gpus, max(duration) AS longest, round(quantile_cont(duration, 0.5), 6) AS median FROM log""")


def top_states(log: DataFrame, k: int = 2) -> DataFrame:
    """The k most frequent states and the rest as Other."""
    n = log.groupBy("state").agg(F.count("*").alias("n"))
    names = [r[0] for r in n.orderBy(F.desc("n"), "state").limit(k).select("state").collect()]
    return n.groupBy(F.when(F.col("state").isin(*names), F.col("state")).otherwise("Other").alias("state")).agg(F.sum("n").alias("n"))


_add("ag_status_topn_other", lambda t: top_states(_log(t)), "SELECT CASE WHEN r <= 2 THEN state ELSE 'Other' END AS state, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, state) AS r FROM (SELECT state, count(*) AS n FROM log GROUP BY 1)) GROUP BY 1")
_add("ag_job_status_rates", lambda t: _log(t).groupBy(C.job_type("gpu_num").alias("job_type")).agg(F.round(F.avg(F.expr(f"if({_OK}, 1.0D, 0.0D)")), 9).alias("ok"), F.round(F.avg(F.expr("if(state in ('FAILED', 'CANCELLED'), 1.0D, 0.0D)")), 9).alias("bad")), f"SELECT {_TYPE} AS job_type, round(count_if({_OK}) / count(*), 9) AS ok, round(count_if(state IN ('FAILED', 'CANCELLED')) / count(*), 9) AS bad FROM log GROUP BY 1")
_add("ag_status_counts", lambda t: t.jobs.groupBy("job_status_str", "exit_status").agg(F.count("*").alias("n")), "SELECT job_status_str, exit_status, count(*) AS n FROM jobs GROUP BY 1, 2")
_add("ag_resource_demand", lambda t: _log(t).groupBy("node_num").agg(F.count("*").alias("jobs"), F.round(F.sum(F.col("gpu_num") * F.col("duration")) / 3600, 6).alias("gpu_hours")), "SELECT node_num, count(*) AS jobs, round(sum(gpu_num * duration) / 3600, 6) AS gpu_hours FROM log GROUP BY 1")


_add("ag_user_day_stats", lambda t: sampling.busiest_day_users(_log(t)), """SELECT CAST(submit_time AS DATE) AS day, "user", count(*) AS n, round(sum(duration) / count(*), 6) AS mean, round(stddev_samp(duration), 4) AS std, min(duration) AS least, max(duration) AS most, round(quantile_cont(duration, 0.5), 6) AS median,
    round(sum(gpu_num) / count(*), 6) AS mean_gpus, CAST(sum(gpu_num) AS BIGINT) AS gpus, round(sum(cpu_num) / count(*), 6) AS mean_cpus, CAST(sum(cpu_num) AS BIGINT) AS cpus, min(submit_time) AS first, max(submit_time) AS last, round(date_diff('second', min(submit_time), max(submit_time)) / 3600, 6) AS span_hours
    FROM log WHERE CAST(submit_time AS DATE) = (SELECT d FROM (SELECT CAST(submit_time AS DATE) AS d, count(*) AS n FROM log GROUP BY 1) ORDER BY n DESC, d LIMIT 1) GROUP BY 1, 2""")
_add("ag_user_queue", lambda t: _log(t).where("queue >= 0").groupBy("user").agg(F.count("*").alias("n"), F.round(F.avg("queue"), 6).alias("mean"), F.max("queue").alias("most")).orderBy(F.desc("mean"), "user").limit(10), """SELECT "user", count(*) AS n, round(avg(queue), 6) AS mean, max(queue) AS most FROM log WHERE queue >= 0 GROUP BY 1 ORDER BY mean DESC, "user" LIMIT 10""")
_add("ag_res_eff_day", lambda t: _log(t).groupBy(F.to_date("submit_time").alias("day")).agg(F.count_if(F.expr("duration > 600")).alias("effective"), F.round(F.sum(F.when(F.col("duration") <= 600, F.col("duration") * F.col("cpu_num")).otherwise(0)) / 3600, 6).alias("short_cpu_hours"), F.round(F.sum(F.col("duration") * F.col("cpu_num")) / 3600, 6).alias("cpu_hours")), "SELECT CAST(submit_time AS DATE) AS day, count_if(duration > 600) AS effective, round(sum(CASE WHEN duration <= 600 THEN duration * cpu_num ELSE 0 END) / 3600, 6) AS short_cpu_hours, round(sum(duration * cpu_num) / 3600, 6) AS cpu_hours FROM log GROUP BY 1")
_add("ag_util_overall", lambda t: users.sizes(_log(t)).withColumn("percent", F.round(100 * F.col("node_hours") / F.lit(_log(t).agg(F.sum(F.col("node_num") * F.col("duration")) / 3600).first()[0]), 5)), "SELECT CASE WHEN node_num = 1 THEN 'single' WHEN node_num <= 8 THEN 'small' WHEN node_num <= 64 THEN 'medium' ELSE 'large' END AS size, count(*) AS jobs, round(sum(node_num * duration) / 3600, 6) AS node_hours, round(100 * sum(node_num * duration) / (SELECT sum(node_num * duration) FROM log), 5) AS percent FROM log GROUP BY 1")
_DAYS = "(SELECT date_diff('day', CAST(min(submit_time) AS DATE), CAST(max(submit_time) AS DATE)) + 1 FROM log)"
_add("ag_util_subcluster", lambda t: capacity.utilisation(t.jobs, _log(t)), f"SELECT subcluster, nh AS node_hours, round(100 * nh / (({_NODES}) * 24 * {_DAYS}), 6) AS percent FROM (SELECT subcluster, round(sum(node_num * duration / 3600), 6) AS nh FROM log JOIN prim USING (job_id) GROUP BY 1)")
_add("ag_capacity_theory", lambda t: capacity.theory(_log(t)), f"SELECT {_DAYS} AS days, {_DAYS} * 24 * {sum(v[0] for k, v in capacity.SPEC.items() if not k.startswith('GPU'))} AS cpu_node_hours, {_DAYS} * 24 * {capacity.SPEC['GPU1'][0]} AS gpu_node_hours")
_add("ag_capacity_reco", lambda t: capacity.recommendation(t.jobs), f"SELECT subcluster, largest, round(p, 6) AS percent, CASE WHEN p > 90 THEN 'expand' WHEN p < 30 THEN 'over-provisioned' ELSE 'adequate' END AS advice FROM (SELECT subcluster, max(n) AS largest, 100 * max(n) / ({_NODES}) AS p FROM (SELECT {_sub('host')} AS subcluster, job_id, count(*) AS n FROM hosts WHERE host IS NOT NULL GROUP BY 1, 2) GROUP BY 1)")
_add("ag_load_balance", lambda t: capacity.balance(t.jobs, _log(t)), "SELECT round(stddev_samp(share), 6) AS std, round(stddev_samp(share) / (100 / count(*)), 6) AS imbalance, arg_max(subcluster, share) AS most, arg_min(subcluster, share) AS least FROM (SELECT subcluster, 100 * x / sum(x) OVER () AS share FROM (SELECT subcluster, sum(node_num * duration / 3600) AS x FROM log JOIN prim USING (job_id) GROUP BY 1))")
_add("ag_cpu_by_sub", lambda t: capacity.cpus_by_subcluster(t.jobs, _log(t)), f"SELECT subcluster, jobs, mean_cpus, max_cpus, CAST({_CORES} AS BIGINT) AS cores FROM (SELECT subcluster, count(*) AS jobs, round(avg(cpu_num), 6) AS mean_cpus, max(cpu_num) AS max_cpus FROM log JOIN prim USING (job_id) WHERE gpu_num = 0 GROUP BY 1)")
_add("ag_resource_overview", lambda t: users.describe(_log(t), "gpu_num").where("part = 'gpu'"), "SELECT part, count(*) AS n, round(avg(gpu_num), 6) AS mean, round(stddev_samp(gpu_num), 4) AS std, min(gpu_num) AS least, max(gpu_num) AS most, round(quantile_cont(gpu_num, 0.25), 6) AS p25, round(quantile_cont(gpu_num, 0.5), 6) AS p50, round(quantile_cont(gpu_num, 0.75), 6) AS p75, round(quantile_cont(gpu_num, 0.9), 6) AS p90, round(quantile_cont(gpu_num, 0.95), 6) AS p95, round(quantile_cont(gpu_num, 0.99), 6) AS p99 FROM part WHERE gpu_num > 0 AND part = 'gpu' GROUP BY 1")
_add("ag_trace_summary", lambda t: _log(t).agg(F.lit("log").alias("name"), F.count("*").alias("n")).unionByName(traces.throughput(_log(t)).agg(F.lit("throughput").alias("name"), F.count("*").alias("n"))).unionByName(users.per_user(_log(t)).agg(F.lit("user").alias("name"), F.count("*").alias("n"))), """SELECT 'log' AS name, count(*) AS n FROM log UNION ALL SELECT 'throughput', count(DISTINCT date_trunc('hour', start_time)) FROM log UNION ALL SELECT 'user', count(DISTINCT "user") FROM log""")
_add("ag_app_efficiency", lambda t: capacity.by_command(t.jobs, _tel(t)), "SELECT command, count(*) AS jobs, round(sum(s) / nullif(sum(n), 0), 5) AS mean_cpu, round(avg(cpu_num), 6) AS mean_request FROM jobs JOIN (SELECT job_id, sum(cpu_total) AS s, count(cpu_total) AS n FROM jh WHERE NOT all_null GROUP BY 1) USING (job_id) WHERE command IS NOT NULL GROUP BY 1")
_MEANS = lambda digits: ", ".join(f"{_mean(c, digits)} AS {k}" for c, k in capacity.METRICS.items())
_add("ag_user_telemetry", lambda t: capacity.by_user(t.jobs, _tel(t)), f"SELECT user_id, count(DISTINCT job_id) AS jobs, {_MEANS(4)}, round(sum(cpu_num) / count(cpu_num), 6) AS cpus_asked, round(sum(gpu_num) / count(gpu_num), 6) AS gpus_asked FROM jh JOIN (SELECT job_id, user_id, cpu_num, gpu_num FROM jobs WHERE user_id IS NOT NULL) USING (job_id) WHERE NOT all_null GROUP BY 1")
_add("ag_group_usage", lambda t: _tel(t).groupBy(C.subcluster(F.col("server")).alias("grp"), "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("peak"), F.count_distinct("server").alias("servers")), "SELECT grp, metric, round(avg(value), 6) AS mean, max(value) AS peak, count(DISTINCT server) AS servers FROM grp GROUP BY 1, 2")
_VIEWS["hourly"] = f"SELECT {_sub('server')} AS subcluster, hour, count(DISTINCT job_id) AS jobs, {_MEANS(5)} FROM jh WHERE NOT all_null GROUP BY 1, 2"


def _lines(ys: list[str]) -> str:
    """Lines and correlations from exact sums."""
    out = []
    for y in ys:
        x, v = f"(CASE WHEN {y} IS NOT NULL THEN jobs END)::DECIMAL(18, 0)", f"{y}::DECIMAL(18, 5)"
        n, sx, sxx, sy, sxy, syy = (f"{c}::DOUBLE" for c in (f"count({y})", f"sum({x})", f"sum({x} * {x})", f"sum({v})", f"sum({x} * {v})", f"sum({v} * {v})"))
        both, own, other = f"({n} * {sxy} - {sx} * {sy})", f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
        slope = f"(CASE WHEN {own} > 0 THEN {both} / {own} END)"
        out.append(f"count({y}) AS n_{y}, round({slope}, 4) AS slope_{y}, round(({sy} - {slope} * {sx}) / {n}, 4) AS intercept_{y}, round(CASE WHEN {own} > 0 AND {other} > 0 THEN {both} / sqrt({own} * {other}) END, 4) AS corr_{y}")
    return ", ".join(out)


_add("ag_linear_fit", lambda t: capacity.fit(t.jobs, _tel(t)), f"SELECT subcluster, {_lines(list(capacity.METRICS.values()))} FROM hourly GROUP BY 1")
_add("tel_corr_hour", lambda t: capacity.hourly(t.jobs, _tel(t)), "SELECT * FROM hourly")
_add("tel_job_hours", lambda t: capacity.labelled_hours(t.jobs, _tel(t)), "SELECT job_id, server, hour, cpu_total, all_null, servers, CASE WHEN servers > 1 THEN 'multi' ELSE 'single' END AS spread FROM jh JOIN (SELECT job_id, count(DISTINCT server) AS servers FROM jh GROUP BY 1) USING (job_id)")
_add("tel_efficiency", lambda t: capacity.efficiency(t.jobs, _tel(t)), "SELECT CAST(hour(hour) AS BIGINT) AS hour_of_day, round(avg(cpu_total) / 100, 6) AS use, round(avg(cpu_num), 6) AS asked FROM jh JOIN jobs USING (job_id) WHERE NOT all_null GROUP BY 1")

# Windows, limits, sets
_add("win_diff", lambda t: telemetry.differences(_tel(t)), "SELECT server, metric, ts, round(value - lag(value) OVER (PARTITION BY server, metric ORDER BY ts), 9) AS d FROM tel")
_add("win_interval_stats", lambda t: classify.intervals(t.jobs), """SELECT user_id, count(*) + 1 AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 4) AS std, round(quantile_cont(d, 0.5), 6) AS median
    FROM (SELECT user_id, date_diff('second', lag(submit_time) OVER (PARTITION BY user_id ORDER BY submit_time, job_id), submit_time) AS d FROM jobs WHERE user_id IS NOT NULL AND submit_time IS NOT NULL) WHERE d IS NOT NULL GROUP BY 1 HAVING count(*) + 1 >= 10""")
_add("win_first_idx", lambda t: traces.by_hour(_log(t)).agg(F.max_by("hour", F.struct("jobs", -F.col("hour"))).alias("peak"), F.min_by("hour", F.struct("jobs", "hour")).alias("valley")), "SELECT arg_max(hour, jobs * 100 - hour) AS peak, arg_min(hour, jobs * 100 + hour) AS valley FROM (SELECT CAST(hour(submit_time) AS BIGINT) AS hour, count(*) AS jobs FROM log GROUP BY 1)")
_add("win_mode", lambda t: _log(t).groupBy("user", "state").agg(F.count("*").alias("n")).groupBy("user").agg(F.min_by("state", F.struct(-F.col("n"), F.col("state"))).alias("state")), """SELECT "user", arg_min(state, (-n, state)) AS state FROM (SELECT "user", state, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY 1""")
_add("top_head", lambda t: t.jobs.where("job_name is not null").groupBy("job_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "job_name").limit(10), "SELECT job_name, count(*) AS n FROM jobs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("top_nlargest", lambda t: _log(t).select("job_id", "duration").orderBy(F.desc("duration"), "job_id").limit(10), "SELECT job_id, duration FROM log ORDER BY 2 DESC, 1 LIMIT 10")
_add("set_union", lambda t: t.jobs.where("gpu_num > 0").select("job_id").unionByName(t.jobs.where("gpu_num = 0").select("job_id")).agg(F.count("*").alias("n"), F.sum("job_id").alias("s")), "SELECT count(*) AS n, CAST(sum(job_id) AS BIGINT) AS s FROM jobs")
_add("set_intersect", lambda t: t.table("lineitem").where("l_linenumber = 1").select("l_partkey").intersect(t.table("lineitem").where("l_linenumber = 2").select("l_partkey")), "SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2")
_add("set_distinct", lambda t: t.telemetry.select("server", "metric", "ts").distinct(), "SELECT DISTINCT server, metric, ts FROM raw")

# Classification, inference, quality
_DIST = "coalesce(n, 0) > 1 OR gpu_num > 4 OR coalesce(regexp_matches(lower(command), 'mpirun|srun|torchrun|horovod|deepspeed'), false)"
_HN = "jobs LEFT JOIN (SELECT job_id, count(*) AS n FROM hosts WHERE host IS NOT NULL GROUP BY 1) USING (job_id)"
_add("cls_distributed", lambda t: classify.distributed(t.jobs), f"SELECT job_id, {_DIST} AS distributed FROM {_HN}")
_add("cls_distributed_view", lambda t: classify.distributed_view(t.jobs), f"SELECT coalesce(n, 0) AS hosts, {_DIST} AS distributed, count(*) AS jobs FROM {_HN} GROUP BY 1, 2")
_add("cls_type_features", lambda t: t.jobs.select("job_id", F.lower(F.concat_ws(" ", "command", "job_name")).alias("text"), F.coalesce(C.seconds("start_time", "end_time"), F.lit(0)).alias("duration")), f"SELECT job_id, lower(concat_ws(' ', command, job_name)) AS text, coalesce({_SECONDS}, 0) AS duration FROM jobs")
_MD = lambda x: f"substring(md5(coalesce({x}, '')), 1, 8)"
_NUMS = f"""coalesce(cpu_num, 0)::DOUBLE AS cpus, coalesce(mem_gb, 0)::DOUBLE AS mem, coalesce(gpu_num, 0)::DOUBLE AS gpus, coalesce(hour(submit_time), 12)::DOUBLE AS hour, coalesce(isodow(submit_time) - 1, 1)::DOUBLE AS weekday, coalesce({_SECONDS}, 300)::DOUBLE AS duration, coalesce((exit_status = 0)::INT, 0)::DOUBLE AS success"""
_BASE = "regexp_replace(job_name, '_?[0-9]+$', '')"
_VIEWS["prints"] = f"SELECT job_id, user_id, {_MD('command')} AS command, {_MD(_BASE)} AS base, {_MD('from_host')} AS origin, {_MD('queue')} AS queue, {_NUMS} FROM anon"
_add("inf_fingerprint", lambda t: inference.fingerprints(t.anon), "SELECT * FROM prints")
_add("dq_importance", lambda t: cleaning.field_scores(t.jobs).select("name", "importance"), "SELECT name, round(least(1.0::DOUBLE, w / 5 + 0.3::DOUBLE * p), 6) AS importance FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, {v} AS w, count({k}) / count(*) AS p FROM jobs" for k, v in cleaning.IMPORTANCE.items()) + ")")
_add("dq_overview", lambda t: classify.overview(t.jobs), f"SELECT count(*) AS jobs, count_if({_SECONDS} <= 0) AS bad_duration, count_if(date_diff('second', submit_time, start_time) < 0) AS bad_queue, count(DISTINCT month(submit_time)) AS months, count(DISTINCT isodow(submit_time)) AS weekdays, count(DISTINCT hour(submit_time)) AS hours FROM jobs")
_add("smp_quality", lambda t: _log(t).groupBy("user").agg(F.count("*").alias("n")).agg(F.round(F.max("n") / F.sum("n"), 9).alias("top_share"), F.count("*").alias("users")), """SELECT round(max(n) / sum(n), 9) AS top_share, count(*) AS users FROM (SELECT "user", count(*) AS n FROM log GROUP BY 1)""")
_add("dup_groups", lambda t: t.jobs.groupBy("user_id", "job_name", "cpu_num").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("jobs")), "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS jobs FROM (SELECT count(*) AS n FROM jobs GROUP BY user_id, job_name, cpu_num HAVING count(*) > 1)")
_add("day_report", lambda t: sampling.peak_day(_burst(t)).groupBy(F.hour("submit_time").cast("long").alias("hour")).agg(F.count("*").alias("jobs"), F.count_distinct("user_id").alias("users")), "SELECT CAST(hour(submit_time) AS BIGINT) AS hour, count(*) AS jobs, count(DISTINCT user_id) AS users FROM burst WHERE CAST(submit_time AS DATE) = (SELECT day FROM days ORDER BY n DESC, day LIMIT 1) GROUP BY 1")
_add("day_recommend", lambda t: _burst(t).agg(F.count_if(C.seconds("start_time", "end_time") < 10).alias("short"), F.count_if(F.expr("user_id is null")).alias("no_user"), F.count_if(F.expr("cpu_num = 0 and gpu_num = 0")).alias("no_resources")).select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("removes")) for c in ("short", "no_user", "no_resources")])).alias("r")).select("r.*"), f"SELECT 'short' AS rule, count_if({_SECONDS} < 10) AS removes FROM burst UNION ALL SELECT 'no_user', count_if(user_id IS NULL) FROM burst UNION ALL SELECT 'no_resources', count_if(cpu_num = 0 AND gpu_num = 0) FROM burst")

# Traces, telemetry, comparison
_add("trc_monthly_util", lambda t: traces.month_capacity(_log(t).where("job_id % 2 = 0")).withColumn("part", F.lit("a")).unionByName(traces.month_capacity(_log(t).where("job_id % 2 = 1")).withColumn("part", F.lit("b"))), "SELECT strftime(m, '%Y-%m') AS month, gpu_seconds, round(gpu_seconds / (day(last_day(m)) * 86400.0 * 64), 9) AS share, part FROM (SELECT date_trunc('month', start_time) AS m, CASE WHEN job_id % 2 = 0 THEN 'a' ELSE 'b' END AS part, CAST(sum(gpu_num * duration) AS BIGINT) AS gpu_seconds FROM log GROUP BY 1, 2)")
_add("pat_util_series", lambda t: traces.sequence(_log(t)).agg(F.round(F.avg("jobs"), 6).alias("mean_jobs"), F.max("jobs").alias("peak_jobs"), F.round(F.avg("gpus"), 6).alias("mean_gpus"), F.max("gpus").alias("peak_gpus")), "SELECT round(avg(coalesce(jobs, 0)), 6) AS mean_jobs, max(jobs) AS peak_jobs, round(avg(coalesce(gpus, 0)), 6) AS mean_gpus, max(gpus) AS peak_gpus FROM grid LEFT JOIN (SELECT date_trunc('hour', submit_time) AS hour, count(*) AS jobs, CAST(sum(gpu_num) AS BIGINT) AS gpus FROM log GROUP BY 1) USING (hour)")
_add("pat_util_time", lambda t: _log(t).groupBy(F.to_date("start_time").alias("day")).agg(F.round(F.sum(F.col("node_num") * F.col("duration")) / 3600, 6).alias("node_hours"), F.sum("node_num").alias("nodes")), "SELECT CAST(start_time AS DATE) AS day, round(sum(node_num * duration) / 3600, 6) AS node_hours, CAST(sum(node_num) AS BIGINT) AS nodes FROM log GROUP BY 1")
_add("tel_month_of_year", lambda t: t.table("orders").groupBy(F.month("o_orderdate").cast("long").alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n")), "SELECT CAST(month(o_orderdate) AS BIGINT) AS month, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")
_add("tel_power_voltage", lambda t: telemetry.resample(_tel(t).where("metric = 'power'"), "day"), "SELECT metric, date_trunc('day', ts)::TIMESTAMP AS at, round(avg(value), 6) AS mean, count(*) AS n FROM tel WHERE metric = 'power' GROUP BY 1, 2")
_add("tel_sheet_profile", lambda t: t.telemetry.groupBy("server").agg(F.count("*").alias("rows"), F.count("value").alias("values"), F.count_distinct("metric").alias("metrics")), """SELECT server, count(*) AS "rows", count(value) AS "values", count(DISTINCT metric) AS metrics FROM raw GROUP BY 1""")
_add("tel_group_pattern", lambda t: _tel(t).groupBy(C.subcluster(F.col("server")).alias("grp"), F.weekday("ts").cast("long").alias("weekday"), F.hour("ts").cast("long").alias("hour")).agg(F.round(F.avg("value"), 6).alias("mean")), f"SELECT grp, {_WD.format('ts')} AS weekday, CAST(hour(ts) AS BIGINT) AS hour, round(avg(value), 6) AS mean FROM grp GROUP BY 1, 2, 3")
_add("cmp_standardize", lambda t: _log(t).where("gpu_num > 0").select("user", "gpu_num", "duration", (F.col("gpu_num") * F.col("duration")).alias("gpu_time"), "state"), """SELECT "user", gpu_num, duration, gpu_num * duration AS gpu_time, state FROM log WHERE gpu_num > 0""")
_add("cmp_job_types", lambda t: _log(t).groupBy(F.when(F.col("job_id") % 2 == 0, "local").otherwise("external").alias("dataset")).agg(F.round(100 * F.count_if(F.expr("gpu_num > 0")) / F.count("*"), 6).alias("gpu"), F.round(100 * F.count_if(F.expr("gpu_num = 0")) / F.count("*"), 6).alias("cpu")), "SELECT CASE WHEN job_id % 2 = 0 THEN 'local' ELSE 'external' END AS dataset, round(100 * count_if(gpu_num > 0) / count(*), 6) AS gpu, round(100 * count_if(gpu_num = 0) / count(*), 6) AS cpu FROM log GROUP BY 1")

# Streaming forms, on closed tables
_add("str_hourly", lambda t: series.hourly(t.jobs), "SELECT date_trunc('hour', submit_time) AS hour, count(*) AS jobs, CAST(sum(gpu_num) AS BIGINT) AS gpus FROM jobs WHERE submit_time IS NOT NULL GROUP BY 1")
_add("str_minute_burst", lambda t: series.bursts(_burst(t), 1), "SELECT date_trunc('minute', submit_time) AS minute, count(*) AS n FROM burst WHERE submit_time IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
_add("str_dedupe", lambda t: series.once(t.telemetry), "SELECT DISTINCT server, metric, ts FROM raw")
_add("str_high_sessions", lambda t: series.high_sessions(_tel(t)), """SELECT server, min(ts) AS first, max(ts) AS last, count(*) AS n, max(value) AS most FROM (SELECT *, sum(new) OVER (PARTITION BY server ORDER BY ts, metric ROWS UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN date_diff('second', lag(ts) OVER w, ts) <= 12 * 3600 THEN 0 ELSE 1 END AS new FROM tel WHERE value > 60 WINDOW w AS (PARTITION BY server ORDER BY ts, metric))) GROUP BY server, island HAVING date_diff('second', min(ts), max(ts)) >= 3600""")

# Strategies by level: all rows of normal days, fixed shares of the others
_RATES = {"normal": 1.0, "moderate": 0.8, "severe": 0.5, "extreme": 0.2}


def by_level(jobs: DataFrame) -> DataFrame:
    """Exactly max(1, floor(rate * size)) rows of each day, by its level's rate."""
    day = jobs.where("submit_time is not null").withColumn("day", F.to_date("submit_time"))
    x = day.join(sampling.daily_levels(jobs).select("day", "level"), "day").withColumn("_k", F.concat_ws("|", "level", F.col("day").cast("string")))
    rate = F.element_at(F.create_map(*[F.lit(v) for kv in _RATES.items() for v in kv]), F.substring_index("_k", "|", 1))
    return exact.rank_select(sampling._hashed(x, "l1-"), ["_k"], "_h", "job_id", F.greatest(F.lit(1), F.floor(rate * F.col("_size")))).select("job_id", "day", "level")


_LEVELS = """SELECT day, n, CASE WHEN n >= e THEN 'extreme' WHEN n >= s THEN 'severe' WHEN n >= 340 THEN 'moderate' ELSE 'normal' END AS level FROM days, (SELECT greatest(1000, 10 * q2, m + 5 * sd) AS e, greatest(400, q2 + 3 * (q3 - q1), m + 3 * sd) AS s FROM (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, avg(n) AS m, stddev_samp(n) AS sd FROM days))"""
_add("smp_strategy", lambda t: by_level(_burst(t)), f"""SELECT job_id, day, level FROM (SELECT job_id, l.day, level, n, row_number() OVER (PARTITION BY l.day ORDER BY md5('l1-' || job_id), job_id) AS r FROM burst b JOIN ({_LEVELS}) l ON CAST(b.submit_time AS DATE) = l.day)
    WHERE r <= greatest(1, floor(CASE level WHEN 'normal' THEN 1.0::DOUBLE WHEN 'moderate' THEN 0.8::DOUBLE WHEN 'severe' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END * n))""")


_add("tim_est_sequence", lambda t: cleaning.by_sequence(t.jobs), """SELECT job_id, make_timestamp(CAST((ps + floor((ns - ps) * (job_id - pj) / (nj - pj))) * 1000000 AS BIGINT)) AS submit_time FROM (SELECT job_id, submit_time, last_value(k IGNORE NULLS) OVER p AS pj, last_value(s IGNORE NULLS) OVER p AS ps, first_value(k IGNORE NULLS) OVER n AS nj, first_value(s IGNORE NULLS) OVER n AS ns
    FROM (SELECT job_id, submit_time, CASE WHEN submit_time IS NOT NULL THEN job_id END AS k, CAST(epoch(submit_time) AS BIGINT) AS s FROM jobs) WINDOW p AS (ORDER BY job_id ROWS UNBOUNDED PRECEDING), n AS (ORDER BY job_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE submit_time IS NULL AND pj IS NOT NULL AND nj IS NOT NULL""")

_VIEWS["dist"] = f"SELECT job_id, regexp_replace(job_name, '_?[0-9]+$', '') AS base, user_id, submit_time AS t, gpu_num, cpu_num FROM {_HN} WHERE submit_time IS NOT NULL AND ({_DIST})"
_add("cls_group_distributed", lambda t: classify.groups(t.jobs), """SELECT * FROM (WITH RECURSIVE anchors(base, a) AS (SELECT base, min(t) FROM dist GROUP BY 1
    UNION SELECT base, nxt FROM (SELECT x.base, (SELECT min(d.t) FROM dist d WHERE d.base = x.base AND d.t > x.a + INTERVAL 300 SECOND) AS nxt FROM anchors x) WHERE nxt IS NOT NULL),
    placed AS (SELECT d.*, x.a AS first FROM dist d ASOF JOIN anchors x ON d.base = x.base AND d.t >= x.a),
    named AS (SELECT base, first, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM placed JOIN hosts USING (job_id) WHERE host IS NOT NULL GROUP BY 1, 2)
    SELECT p.base, count(*) AS jobs, count(DISTINCT user_id) AS users, p.first, max(t) AS last, max(gpu_num) AS gpus, max(cpu_num) AS cpus, min(job_id) AS head, string_agg(job_id::VARCHAR, ',' ORDER BY job_id) AS ids, coalesce(any_value(n.hosts), '') AS hosts
    FROM placed p LEFT JOIN named n ON n.base = p.base AND n.first = p.first GROUP BY p.base, p.first)""")
_add("cls_kw_affinity", lambda t: classify.word_affinity(t.jobs), "SELECT word, CAST(sum(s) AS BIGINT) AS net, round(greatest(0, least(1, 0.5::DOUBLE + 0.1::DOUBLE * sum(s))), 6) AS affinity FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(command), '[a-z0-9_-]{3,}'))) AS word, CASE WHEN gpu_num > 0 THEN 1 ELSE -1 END AS s FROM jobs) GROUP BY 1")

_Z = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS z{i}" for i, c in enumerate(inference.NUMBERS))
_APART = " + ".join(f"(a.z{i} - b.z{i}) ** 2" for i in range(len(inference.NUMBERS)))
_VIEWS["x"] = f"SELECT *, rank() OVER (ORDER BY command, base, origin, queue) AS kind, {_Z} FROM prints WHERE user_id IS NULL"
_VIEWS["close"] = f"SELECT a.job_id AS a, b.job_id AS b FROM x a JOIN x b ON a.kind = b.kind WHERE {_APART} <= 0.3::DOUBLE * 0.3::DOUBLE"
_VIEWS["core"] = "SELECT a AS k FROM close GROUP BY a HAVING count(*) >= 3"
_VIEWS["edges"] = "SELECT a, b FROM close SEMI JOIN core ON core.k = a"
_CLUSTERED = """WITH RECURSIVE reach(k, r) AS (SELECT k, k FROM core UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.k SEMI JOIN core ON core.k = e.b),
    named AS (SELECT k, min(r) AS c FROM reach GROUP BY 1), rim AS (SELECT b, min(c) AS c FROM edges JOIN named ON named.k = a GROUP BY 1)
    SELECT x.job_id, coalesce(n.c, rim.c) AS cluster FROM x LEFT JOIN named n ON n.k = x.job_id LEFT JOIN rim ON rim.b = x.job_id"""
_add("inf_cluster", lambda t: inference.clusters(t.anon), f"SELECT * FROM ({_CLUSTERED})")
_add("inf_confidence", lambda t: inference.confidence(t.anon), f"""SELECT cluster, n, names, consistency, level, CASE level WHEN 'high' THEN 'inferred_high_' WHEN 'medium' THEN 'inferred_medium_' WHEN 'low' THEN 'inferred_low_' ELSE 'singleton_' END || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END AS inferred_user_id
    FROM (SELECT *, row_number() OVER (ORDER BY cluster) AS number, CASE WHEN n >= 10 AND consistency >= 0.8 THEN 'high' WHEN n >= 5 AND consistency >= 0.6 THEN 'medium' WHEN n >= 2 THEN 'low' ELSE 'singleton' END AS level
    FROM (SELECT cluster, count(*) AS n, count(DISTINCT job_name) AS names, round((1 / greatest(1, count(DISTINCT job_name)) + 1 / (1 + coalesce(stddev_samp(coalesce(cpu_num, 0)), 0)) + 1 / (1 + coalesce(stddev_samp(coalesce(hour(submit_time), 12)), 0) / 24)) / 3, 6) AS consistency
    FROM ({_CLUSTERED}) c JOIN anon USING (job_id) WHERE cluster IS NOT NULL GROUP BY 1))""")
