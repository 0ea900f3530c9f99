"""Job and telemetry views over the given tables, and the same views as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``jobs``: a batch-job log made from orders; ``{ts}`` is the engine's name of a timestamp without time zone.
JOBS = """
SELECT k AS job_id,
       CASE WHEN c % 13 = 0 THEN NULL ELSE CONCAT('u', CAST(c % 97 AS STRING)) END AS user_id,
       CONCAT('job_', CAST(c % 50 AS STRING), '_', CAST(k % 4 AS STRING)) AS job_name,
       CASE k % 5 WHEN 0 THEN '#BSUB -q normal' WHEN 1 THEN 'sbatch --gres gpu train.py'
                  WHEN 2 THEN 'python finetune_llama.py --lora' WHEN 3 THEN 'mpirun lammps -n 4' END AS command,
       pr AS queue,
       CASE WHEN k % 29 = 0 THEN 'excluded' ELSE 'main' END AS cluster_name,
       CASE k % 6 WHEN 0 THEN CONCAT('cpu1-', CAST(n AS STRING))
                  WHEN 1 THEN CONCAT('cpu1-[', CAST(n AS STRING), '-', CAST(n + 2 AS STRING), ']')
                  WHEN 2 THEN CONCAT('cpu2-', CAST(n AS STRING), ',cpu2-', CAST(n + 1 AS STRING))
                  WHEN 3 THEN CONCAT('gpu1-', CAST(n AS STRING), '+gpu1-[', CAST(n + 1 AS STRING), ',', CAST(n + 3 AS STRING), ']')
                  WHEN 4 THEN CONCAT('{{"nodes":["cpu3-', CAST(n AS STRING), '","bigmem-1"]}}') END AS exec_hosts,
       CAST(CASE WHEN k % 6 = 3 THEN 1 + v % 16 ELSE 0 END AS BIGINT) AS gpu_num,
       CAST(1 + k % 64 AS BIGINT) AS cpu_num,
       CAST(1 + k % 3 AS BIGINT) AS node_num,
       CASE st WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'EXIT' END AS job_status_str,
       CASE st WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 130 END AS exit_status,
       CASE WHEN k % 19 = 0 THEN NULL ELSE sub END AS submit_time,
       CASE WHEN k % 17 = 0 THEN NULL ELSE sub + INTERVAL '1' SECOND * (v % 7200) END AS start_time,
       CASE WHEN k % 23 = 0 THEN NULL ELSE sub + INTERVAL '1' SECOND * (v % 7200 + v % 50000 - 500) END AS end_time
FROM (SELECT *, 1 + v % 20 AS n, {ts} '2024-01-01 00:00:00' + INTERVAL '1' SECOND * ((v * 37 + k * 101) % 2505600) AS sub
      FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr, CAST(FLOOR(o_totalprice) AS BIGINT) AS v FROM orders) s) t
"""

#: ``telemetry``: readings of twelve servers made from events; every tenth reading is there twice.
TELEMETRY = """
SELECT CONCAT(CASE user_id % 3 WHEN 0 THEN 'cpu1-' WHEN 1 THEN 'gpu1-' ELSE 'bigmem-' END, CAST(1 + user_id % 4 AS STRING)) AS server,
       CASE event_type WHEN 'click' THEN 'cpu_total' WHEN 'view' THEN 'gpu_util' WHEN 'purchase' THEN 'power' WHEN 'error' THEN 'load_1min' ELSE 'mem_percent' END AS metric,
       CAST(ts AS {ts}) AS ts, value
FROM (SELECT *, UNNEST(CASE WHEN event_id % 10 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM events) e
"""

#: Commands and host lists that the classification queries see, by job: each separates some rules from the others.
COMMANDS = [
    "#BSUB -q normal -n 8", '#BSUB -R "span[hosts=1]" ./run', "bsub -q long -n 16 ./a.out", "jsub -q short ./b.out", "echo $LSF_JOBID", "unischeduler --submit job.xml", "source /opt/jhinno/profile.unischeduler",
    "#SBATCH --partition=i64m512u", "sbatch --gres=gpu:4 train.py", "srun --ntasks=64 --mem=10G lammps -in x.in", "echo $SLURM_JOB_NODELIST", "#SBATCH --cpus-per-task=8 bsub -q x", "python finetune_llama.py --lora",
    "torchrun pretrain.py --model gpt-4 --tokenizer bpe", "deepspeed train.py --model llama-2 --embedding", "python serve.py --model mistral-7b vllm", "mpirun -np 64 vasp", "mpirun lammps -n 4 molecular dynamics",
    "python train.py resnet imagenet epoch batch optimizer", "yolo detection train coco batch 16", "psql select sql query postgres database", "node backend express http", "ansys fluent simulation mesh", "python rag.py retriever langchain llm claude",
    "msrun npu ascend mindspore train.py huawei atlas", None, "", "bash run.sh", "gemini transformer flask sql redis",
]
HOSTS = ["node001", "cn012+cn013", "mgmt01", "supermicro-3,gpu7", "c-node7", "g-node4", "compute-9", "fat3+mem2", "training-2", "old-5", None, ""]
ORIGINS = ["login1", "ws-17", "gpu-dev", "old-3", None]
CLUSTERS = ["jhcluster", "ASCEND-AI", "main", None]


def _listed(values: list, at: str) -> str:
    """SQL of the value at a place, for both engines."""
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


#: ``work``: the jobs with those commands and hosts, and with the columns that only the classification reads. ``{extract}`` is the engine's first match.
WORK = f"""
SELECT job_id, user_id, job_name, queue, gpu_num, cpu_num, node_num, job_status_str, exit_status, submit_time, start_time, end_time,
       {_listed(COMMANDS, f"(job_id + cpu_num) % {len(COMMANDS)}")} AS command, hosts AS exec_hosts, CASE WHEN job_id % 4 = 1 THEN {{extract}} END AS first_exec_host,
       {_listed(ORIGINS, "(job_id + node_num) % 9")} AS from_host, {_listed(CLUSTERS, "job_id % 5")} AS cluster_name, CAST(cpu_num * 4 AS BIGINT) AS mem_gb, CAST(CASE WHEN gpu_num > 0 THEN 8 * (1 + job_id % 5) END AS BIGINT) AS gpu_mem_gb
FROM (SELECT *, CASE WHEN job_id % 17 < {len(HOSTS)} THEN {_listed(HOSTS, "job_id % 17")} ELSE exec_hosts END AS hosts FROM jobs) w
"""

#: ``anon``: jobs of which two in three have no user, with few categories: commands that share a beginning, two base names, two hosts of origin.
ANON = """
SELECT job_id, CASE WHEN job_id % 3 = 0 THEN user_id END AS user_id, CONCAT(CASE WHEN (job_id + cpu_num) % 4 = 0 THEN 'fit_' ELSE 'sim_' END, CAST(node_num AS STRING)) AS job_name,
       CASE WHEN job_id % 4 = 0 THEN 'python train.py' WHEN job_id % 4 = 1 THEN 'python test.py' ELSE 'python train.py --all' END AS command, CASE WHEN job_id % 5 = 0 THEN NULL ELSE 'ws-1' END AS from_host, 'q' AS queue,
       CAST(8 * (1 + cpu_num % 2) AS BIGINT) AS cpu_num, gpu_num, CAST(64 * (1 + cpu_num % 2) AS BIGINT) AS mem_gb, exit_status, submit_time, start_time, end_time
FROM jobs
"""


class Tables:
    """The given tables and views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def jobs(self) -> DataFrame:
        return self._sql(JOBS, orders=self.table("orders"))

    @cached_property
    def work(self) -> DataFrame:
        sql = WORK.replace("{extract}", "regexp_extract(hosts, '^[a-z0-9-]+', 0)").replace("\\", "\\\\")
        return self.spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM jobs)", "FROM {jobs})"), jobs=self.jobs)

    @cached_property
    def anon(self) -> DataFrame:
        return self._sql(ANON, jobs=self.jobs)

    @cached_property
    def telemetry(self) -> DataFrame:
        e = self.table("events")
        copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        kind = F.when(F.col("user_id") % 3 == 0, "cpu1-").when(F.col("user_id") % 3 == 1, "gpu1-").otherwise("bigmem-")
        metric = F.lit("mem_percent")
        for k, m in (("click", "cpu_total"), ("view", "gpu_util"), ("purchase", "power"), ("error", "load_1min")):
            metric = F.when(F.col("event_type") == k, m).otherwise(metric)
        return e.withColumn("copy", F.explode(copies)).select(
            F.concat(kind, (1 + F.col("user_id") % 4).cast("string")).alias("server"), metric.alias("metric"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value"
        )

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL over frames that are named by ``{name}`` arguments of ``spark.sql``."""
        text = text.replace("{{", "\x01").replace("}}", "\x02").format(ts="TIMESTAMP_NTZ").replace("\x01", "{{").replace("\x02", "}}")
        for name in frames:
            text = text.replace(f"FROM {name}", "FROM {" + name + "}")
        return self.spark.sql(text, **frames)
