"""Rule tables, quality, resolved names, parsed text and user profiles on hand-made rows, nulls and empty tables among them."""

import pytest
from pyspark.sql import functions as F

from tests.test_operators import JOB, job
from tracelens.functions import columns as C
from tracelens.operators import capacity, cleaning, inference, quality, rules, sampling, users
from tracelens.operators.traces import log
from tracelens.sources import csv_text


def commands(spark, rows, schema="job_id long, command string, exec_hosts string, first_exec_host string, from_host string"):
    return spark.createDataFrame([(i, *r, *[None] * (4 - len(r))) for i, r in enumerate(rows)], schema)


def test_kinds_weigh_by_the_first_hit():
    weight = {r.pattern: r.weight for r in rules.script_rules({**rules.FIRST_SCRIPTS, **rules.SECOND_SCRIPTS})}
    assert weight == {
        "#BSUB": 3.0, "jsub": 2.5, "bsub": 2.5, "LSF_": 1.5, "UNISCHEDULER": 1.0, r"-q\s+\w+": 1.0, r"-n\s+\d+": 2.0, r'-R\s+".*"': 2.0,
        "#SBATCH": 3.0, "sbatch": 2.5, "srun": 2.5, "SLURM_": 1.5, "--partition": 1.0, "--ntasks": 2.0, "--cpus-per-task": 1.0, "--mem": 2.0, "--gres": 1.0,
    }


@pytest.mark.parametrize(
    ("row", "want", "confidence"),
    [
        (("#BSUB -n 4", "node001"), "first_generation", 1.0),
        (("x", "cpu1-7"), "second_generation_high", 0.95),
        (("bsub", "cpu1-7", None, "login1"), "management_nodes", 1.0),
        (("sbatch --gres=x", "old-1"), "first_generation", round(6 / (9.5 + 1e-6), 6)),
        (("sbatch", None, "old-1"), "first_generation", round(4.5 / (7 + 1e-6), 6)),
        (("sbatch -n 4 -q x", "fat1"), "second_generation_medium", round(8.5 / (11.5 + 1e-6), 6)),
        (("bsub srun",), "mixed_features", 0.5),
        ((None,), "unknown_category", 0.0),
        (("",), "unknown_category", 0.0),
    ],
)
def test_generations(spark, row, want, confidence):
    got = rules.generations(commands(spark, [row])).first()
    assert (got["generation"], got["confidence"]) == (want, confidence)


def test_every_anchor_is_in_what_its_pattern_matches(spark):
    """A rule without its anchor finds nothing more."""
    texts = ["#BSUB -q normal -n 8 -R \"span\" jsub LSF_X UNIscheduler", "#SBATCH --partition=i64m512u --ntasks=3 --ntasks-per-node --cpus-per-task --mem --gres=gpu srun sbatch SLURM_ -p x", "$MPI_HOSTFILE $OMPI_HOSTFILE $JH_HOSTFILE profile.unischeduler /opt/jhinno gpu01 cnode-3",
             "$SLURM_STEP_NUM_TASKS $SLURM_NTASKS $SLURM_JOB_NODELIST train3-4 ascend npu mindspore atlas", "gpt-4 llama-2 claude-v mistral7b chatglm gemma-7b gemini mistral-instruct philosopher falcon-7 starcoder mpt-7", "mgmt login master head cpu1-2 gpu3-4 bigmem1-2 bigmen1-2 bigmem-1 supermicro c-node old-3 node1 cn2 g-node gpux compute fat mem hpc"]
    tables = [*rules.GEN1, *rules.GEN2, *rules.MODEL_NAMES, *rules.script_rules({**rules.FIRST_SCRIPTS, **rules.SECOND_SCRIPTS}), *rules.host_rules({**rules.MANAGEMENT, **rules.DECISIVE, **rules.FIRST_HOSTS, **rules.SECOND_HOSTS})]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = df.agg(*[F.struct(F.count_if(rules.hit(F.col("t"), r)).alias("a"), F.count_if(F.col("t").rlike(f"(?i){r.pattern}")).alias("b")).alias(str(i)) for i, r in enumerate(tables)]).first()
    assert all(x["a"] == x["b"] > 0 for x in row), [(r.pattern, x) for r, x in zip(tables, row, strict=True) if not x["a"] == x["b"] > 0]


def test_language_model_verdicts(spark):
    shared = [("llama lora finetune",)] * 5 + [("vasp",)] * 5
    df = commands(spark, [*shared, ("python run.py --model gpt-4",), ("bloom",), (None,), ("llama vasp vasp lammps",)])
    got = {r["job_id"]: r for r in rules.language_model_jobs(df.withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("start_time", "end_time")})).collect()}
    assert (got[0]["llm_score"], got[0]["by_words"], got[0]["word_confidence"]) == (8, "LLM", 1.0)
    assert (got[5]["other_score"], got[5]["by_words"], got[5]["how"]) == (1, "Non_LLM", "words")
    assert (got[10]["llm_score"], got[10]["kind"]) == (5, "LLM")  # the model's name; gpt-4 as a word is used once only
    assert (got[11]["by_words"], got[11]["kind"], got[11]["how"]) == (None, "Non_LLM", "resources") and got[12]["kind"] == "Non_LLM"
    assert (got[13]["llm_score"], got[13]["other_score"]) == (3, 1)


def test_empty_log_of_rules(spark):
    empty = spark.createDataFrame([], JOB)
    for f in (rules.generations, rules.pattern_counts, rules.job_types, rules.language_model_jobs, cleaning.majority, inference.confidence, inference.inferred, sampling.user_scores, users.all_facts):
        assert f(empty).collect() == [], f
    assert users.aggregates(log(empty)).collect() == []


def test_seven_numbers_decide_a_cluster(spark):
    rows = [job(i, None, sub="2024-01-01T03:00:00", start="2024-01-01T04:00:00", end=f"2024-01-01T0{5 + i % 2 * 4}:00:00") for i in range(8)] + [job(50, None, sub="2024-01-01T03:00:00", gpus=9), job(60, "known", sub="2024-01-01T03:00:00")]
    got = {r["job_id"]: (r["user_id"], r["confidence"]) for r in inference.inferred(spark.createDataFrame(rows, JOB)).collect()}
    assert {got[i][0] for i in range(0, 8, 2)} == {"inferred_low_001"} and {got[i][0] for i in range(1, 8, 2)} == {"inferred_low_002"}
    assert got[50] == (None, None) and got[60] == ("known", "existing")


def test_quality_by_hand(spark):
    types = {"job_id": "long", "user_id": "string", "exit_status": "long", "submit_time": "timestamp_ntz", "start_time": "timestamp_ntz", "end_time": "timestamp_ntz"}
    ok = ("2024-01-01 00:00:00", "2024-01-01 00:01:00", "2024-01-01 00:02:00")
    rows = [("1", "u", "0", *ok), ("1", "u", "0", *ok), ("2", "", "x", *ok[::-1]), (None, None, None, "soon", None, None)]
    got = quality.assess(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in types)), types, now="2024-01-01 00:02:00").first().asDict()
    assert got["completeness"] == round(19 / 24, 9) and got["uniqueness"] == 0.75 and got["key_uniqueness"] == round(2 / 3, 9) and got["time_logic"] == round(2 / 3, 9)
    assert got["validity"] == round((1 + 2 / 3 + 2 / 3) / 3, 9) and got["consistency"] == round((1 + 1 + 2 / 3 + 3 / 4 + 1 + 1) / 6, 9) and got["freshness"] == 1.0
    assert got["grade"] == "B" and got["within_ranges"] == 1.0
    none = quality.assess(spark.createDataFrame([], ", ".join(f"{c} string" for c in types)), types).first().asDict()
    assert none["rows"] == 0 and none["score"] is None and none["grade"] is None


def test_names_one_edit_apart_are_found(spark):
    tel = spark.createDataFrame([(s,) for s in ("zed-12", "zed-21", "cpu1-1")], "server string")
    hosts = ["zed-12", "ZED_12.local", "zed-1", "zzed-21", "zet-21", "cpu1-9", "zde-12", "", "q"]
    got = {r["host"]: (r["server"], r["how"]) for r in capacity.resolved(spark.createDataFrame([(h,) for h in hosts], "host string"), tel).collect()}
    assert got == {
        "zed-12": ("zed-12", "same"), "ZED_12.local": ("zed-12", "name"), "zed-1": ("zed-12", "name"), "zzed-21": ("zed-21", "name"), "zet-21": ("zed-21", "name"), "cpu1-9": ("cpu1-1", "group"), "zde-12": (None, "none"), "": (None, "none"), "q": (None, "none"),
    }


def test_csv_text(spark):
    lines = ['1,"a ""q"" b",3,2024-01-01 00:00:00,NA,', '2,"two\nlines, x",4,NA,NA,NA', "3,plain,many,NA,NA,NA", "4,short", "5,e,4,NA,NA,NA,more", "", None, '6,"open,4,NA,NA,NA', "7,e,4,no time,NA,NA"]
    got = [(r["job_id"], r["job_name"], r["cpu_num"], r["status"], r["bad"] is None) for r in csv_text.parsed(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got[:3] == [(1, 'a "q" b', 3, "good", True), (2, "two\nlines, x", 4, "good", True), (3, "plain", None, "coerced", False)]
    assert [(x[0], x[3]) for x in got[3:]] == [(4, "corrupt"), (5, "corrupt"), (6, "corrupt"), (7, "coerced")]


def test_amounts(spark):
    forms = [("512 MB", 0.5), ("3gb", 3.0), ("2 TB", 2048.0), ("20480", 20.0), ("16", 16.0), ("none", None), (None, None), ("1048576k", 1.0)]
    got = spark.createDataFrame(forms, "x string, want double").select(C.gigabytes("x"), "want").collect()
    assert all(a == b for a, b in got)
    times = [("1:30:00", 1.5), ("90:00", 1.5), ("2 days", 48.0), ("3h", 3.0), ("30 min", 0.5), ("36000", 10.0), ("5", 5.0), ("soon", None), (None, None), ("7200 s", 2.0)]
    got = spark.createDataFrame(times, "x string, want double").select(C.run_hours("x"), "want").collect()
    assert all(a == b for a, b in got), got


def test_suspicious_users(spark):
    rows = [job(i, "even", sub=f"2024-01-01T{i % 24:02d}:{i % 60:02d}:00", start="2024-01-01T00:00:00", end="2024-01-01T01:00:00") for i in range(1200)]
    rows += [job(10_000 + i, "crowd", sub="2024-01-01T10:00:00") for i in range(101)] + [job(20_000 + i, "few", sub="2024-01-01T10:00:00") for i in range(100)]
    rows = [(r[0], r[1], "same" if r[1] == "even" else r[2], *r[3:]) for r in rows]
    got = {r["user_id"]: (r["score"], r["reasons"]) for r in sampling.user_scores(spark.createDataFrame(rows, JOB)).collect()}
    assert got == {"even": (4, "few names,even durations"), "crowd": (3, "burst")}
