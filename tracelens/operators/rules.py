"""Rules as tables: patterns with anchor, kind and weight, matched in one projection, with the matches as evidence.

A pattern is tried only where its anchor, a text that every match holds, occurs in the lower-cased field; words of fixed lists are met by their
tokens (``array_intersect``, a hash lookup). Nothing is joined: a row's verdict needs that row and the tables. Columns that a table asks for and
the log has not are null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import columns as C


@dataclass(frozen=True)
class Rule:
    """A pattern (case ignored), the text that every match holds, and what a match weighs."""

    pattern: str
    anchor: str
    weight: float = 1.0


# Script patterns of both generations, with their anchors.
FIRST_SCRIPTS = {"#BSUB": "#bsub", "jsub": "jsub", "bsub": "bsub", "LSF_": "lsf_", "UNISCHEDULER": "unischeduler", r"-q\s+\w+": "-q", r"-n\s+\d+": "-n", r'-R\s+".*"': "-r"}
SECOND_SCRIPTS = {"#SBATCH": "#sbatch", "sbatch": "sbatch", "srun": "srun", "SLURM_": "slurm_", "--partition": "--partition", "--ntasks": "--ntasks", "--cpus-per-task": "--cpus-per-task", "--mem": "--mem", "--gres": "--gres"}
# Weights by the kind of a script pattern. The first kind whose text the pattern holds decides; the rest weigh 1.
KINDS = [(("#",), 3.0), (("jsub", "bsub", "sbatch", "srun"), 2.5), (("-n", "-R", "--ntasks", "--mem"), 2.0), (("LSF_", "SLURM_"), 1.5)]
# Host patterns with their anchors.
MANAGEMENT = {"mgmt.*": "mgmt", "login.*": "login", "master.*": "master", "head.*": "head"}
DECISIVE = {r"cpu\d+-.*": "cpu", r"gpu\d+-.*": "gpu", r"bigmem\d+-.*": "bigmem", r"bigmen\d+-.*": "bigmen", "bigmem-.*": "bigmem-"}
FIRST_HOSTS = {"supermicro.*": "supermicro", "c-node.*": "c-node", "old-.*": "old-", r"node\d+.*": "node", r"cn\d+.*": "cn"}
SECOND_HOSTS = {"g-node.*": "g-node", "gpu.*": "gpu", "compute.*": "compute", "fat.*": "fat", "mem.*": "mem", "hpc.*": "hpc"}
# Weights of the host fields, of hosts against scripts, and the confidence levels.
FIELDS = {"exec_hosts": 2.0, "first_exec_host": 1.5, "from_host": 1.0}
HOST_WEIGHT, DECISIVE_CONFIDENCE, HIGH_CONFIDENCE, MEDIUM_CONFIDENCE = 3.0, 0.95, 0.8, 0.5
# Patterns of the other rule set; a missing look-ahead is written as "no hyphen or the end".
GEN1 = [
    Rule(r"#BSUB\b", "#bsub"), Rule(r"\bjsub\b", "jsub"), Rule(r"\bbsub\b", "bsub"), Rule(r"-q\s+\w+", "-q"), Rule(r"\$MPI_HOSTFILE\b", "$mpi_hostfile"), Rule(r"\$OMPI_HOSTFILE\b", "$ompi_hostfile"),
    Rule(r"\$JH_HOSTFILE\b", "$jh_hostfile"), Rule(r"profile\.unischeduler\b", "profile.unischeduler"), Rule("/opt/jhinno", "/opt/jhinno"), Rule("(cpu|gpu)[0-9]{2}([^-]|$)", "pu"), Rule(r"\b(gnode-|cnode-)[0-9]+\b", "node-"),
]
GEN2 = [
    Rule(r"#SBATCH\b", "#sbatch"), Rule(r"\bsbatch\b", "sbatch"), Rule(r"\bsrun\b", "srun"), Rule(r"-p\s+\w+", "-p"), Rule(r"--partition=\w+", "--partition="), Rule("--gres=gpu", "--gres=gpu"), Rule("--ntasks-per-node", "--ntasks-per-node"),
    Rule(r"\$SLURM_STEP_NUM_TASKS\b", "$slurm_step_num_tasks"), Rule(r"\$SLURM_NTASKS\b", "$slurm_ntasks"), Rule(r"\$SLURM_JOB_NODELIST\b", "$slurm_job_nodelist"), Rule(r"\b(i64m512[ur]|a128m512u|i96m3tu|i64m1tg)\b", "m"),
    Rule("(cpu|gpu|train)[0-9]+-[0-9]+", "-"), Rule("ascend", "ascend"), Rule("npu", "npu"), Rule("mindspore", "mindspore"), Rule("atlas", "atlas"),
]
GEN_COLUMNS = ["res_req", "exec_hosts", "first_exec_host", "from_host", "job_name", "application", "queue", "command"]
# Clusters with rules of their own: patterns, generation. The rule holds where three tenths of the patterns' number of columns match.
SPECIAL = {
    "jhcluster": ([Rule("#BSUB", "#bsub"), Rule("jsub", "jsub"), Rule("bsub", "bsub"), Rule("/opt/jhinno", "/opt/jhinno"), Rule("unischeduler", "unischeduler"), Rule(r"\$JH_HOSTFILE", "$jh_hostfile")], "first"),
    "ASCEND-AI": ([Rule("ascend", "ascend"), Rule("npu", "npu"), Rule("mindspore", "mindspore"), Rule("huawei", "huawei"), Rule("atlas", "atlas")], "second"),
}
SPECIAL_SHARE = 0.3
# Words of language-model work and what each weighs, of other domains, and patterns of model names.
LLM_WORDS = {
    3: "llm llms gpt gpt-3 gpt-4 gpt3 gpt4 chatgpt claude llama vicuna mistral mixtral transformer transformers bert roberta openai t5 flan-t5 qlora lora falcon phi phi-2 gemma gemini palm anthropic huggingface".split(),
    2: "tokenizer tokenize token tokens embedding embeddings prompt prompts context_length pretrained pre-trained finetune fine-tune attention language-model language_model decoder diffusion stable-diffusion generative generate inference".split(),
    1: "deepspeed megatron accelerate peft rag bitsandbytes retrieval retriever langchain llamaindex vllm tgi text-generation-inference flash-attention flashattention".split(),
}
OTHER_WORDS = {
    "hpc": "mpi openmpi mpich openmp infiniband scalapack petsc slurm flux fluent ansys hpc fortran vasp lammps hdf5 checkpoint wrf pbspro pbs".split(),
    "scientific": "molecular dynamics simulation physics chemistry fluid genomics bioinformatics monte-carlo montecarlo cfd molecular-dynamics gaussian".split(),
    "database": "postgresql mongodb mysql mariadb database sql nosql query postgres redis sqlite".split(),
    "web": "django flask fastapi node nodejs express react vue angular nginx apache http frontend backend fullstack".split(),
}
MODEL_NAMES = [
    Rule(r"\bgpt-[234]\b", "gpt-"), Rule(r"\bllama-?[23]\b", "llama"), Rule(r"\bclaude-?[2v]\b", "claude"), Rule(r"\bmistral-?7b\b", "mistral"), Rule(r"\bchatglm\b", "chatglm"), Rule(r"\bgemma-?[27]b\b", "gemma"),
    Rule(r"\bgemini\b", "gemini"), Rule(r"\bmistral-?instruct\b", "mistral"), Rule(r"\bphilosopher\b", "philosopher"), Rule(r"\bfalcon-?[1740]\b", "falcon"), Rule(r"\bstarcoder\b", "starcoder"), Rule(r"\bmpt-[357]\b", "mpt-"),
]
MODEL_WEIGHT, LEAST_SCORE, LEAST_CONFIDENCE = 5, 3, 0.65
# What the resources of language-model work are at least (name: GPUs, GB a GPU, GB, cores, hours), and the confidence.
LLM_RESOURCES = [
    ("large training", {"gpu_num": 8, "gpu_mem_gb": 32, "mem_gb": 256, "cpu_num": 32, "hours": 24}, 0.95),
    ("medium training", {"gpu_num": 4, "gpu_mem_gb": 16, "mem_gb": 128, "cpu_num": 16, "hours": 12}, 0.85),
    ("small training", {"gpu_num": 1, "gpu_mem_gb": 24, "mem_gb": 64, "cpu_num": 8, "hours": 4}, 0.75),
    ("large inference", {"gpu_num": 2, "gpu_mem_gb": 24, "mem_gb": 64, "hours": 6}, 0.8),
    ("inference", {"gpu_num": 1, "gpu_mem_gb": 16, "mem_gb": 32}, 0.7),
]
# Tasks and their words; the first whose word is contained.
TASKS = {
    "training": ["train", "finetune", "pretrain", "optimize"],
    "inference": ["infer", "predict", "generate", "eval", "serve"],
    "data_processing": ["process", "prepare", "clean", "format"],
    "evaluation": ["evaluate", "benchmark", "test", "validate"],
}
# Job types: words, resources (least, most), queues.
JOB_TYPES = {
    "DL_Training": (
        "pytorch tensorflow caffe mindspore paddlepaddle mxnet keras cnn resnet vgg yolo densenet efficientnet mobilenet detection segmentation classification recognition tracking train finetune pretrain backbone epoch batch optimizer coco imagenet voc cifar mnist".split(),
        {"gpu_num": (1, None), "cpu_num": (4, None), "duration": (1800, 86400)},
        ["gpu", "dgx", "ml", "ai", "vision"],
    ),
    "LLM_Task": (
        "llm gpt bert transformer t5 palm llama bloom roberta bart opt chatgpt claude alpaca vicuna attention decoder encoder multihead embedding tokenizer language token text prompt completion generation translation summarization qa dialogue chat pretrain finetune lora peft quantization int8 int4 pile c4 bookcorpus wikipedia".split(),
        {"gpu_num": (2, None), "cpu_num": (8, None), "duration": (3600, 604800)},
        ["gpu", "dgx", "ml", "llm", "nlp"],
    ),
}
TYPE_WEIGHTS = {"text": 0.40, "resources": 0.35, "queue": 0.15, "status": 0.10}
_TOKEN = r"([a-z0-9_-]{2,})"


def script_rules(patterns: dict[str, str]) -> list[Rule]:
    """Script patterns with the weight of their kind."""
    weight = lambda p: next((w for texts, w in KINDS if (p.startswith(texts[0]) if texts == ("#",) else any(t in p for t in texts))), 1.0)
    return [Rule(p, a, weight(p)) for p, a in patterns.items()]


def host_rules(patterns: dict[str, str]) -> list[Rule]:
    return [Rule(p, a) for p, a in patterns.items()]


def text_of(df: DataFrame, column: str) -> Column:
    """A column as text, empty for null and where the log has no such column."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in df.columns else F.lit("")


def number_of(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("double") if column in df.columns else F.lit(None).cast("double")


def hit(text: Column, rule: Rule) -> Column:
    """Whether a rule matches: its anchor first, the pattern to confirm."""
    return F.lower(text).contains(rule.anchor) & text.rlike(f"(?i){rule.pattern}")


def total(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def weights(text: Column, rules: list[Rule], factor: float = 1.0) -> Column:
    """Sum of the weights of the rules that match."""
    return total([F.when(hit(text, r), r.weight * factor).otherwise(0.0) for r in rules])


def evidence(text: Column, rules: list[Rule]) -> Column:
    """The patterns that match, in the table's order."""
    return F.array_compact(F.array(*[F.when(hit(text, r), F.lit(r.pattern)) for r in rules]))


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once a row, however often later expressions and filters use them.

    They come from a generator of one row, through which the optimiser pushes no filter that would hold their expressions again.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def host_score(df: DataFrame, patterns: dict[str, str]) -> Column:
    return total([weights(text_of(df, c), host_rules(patterns), w) for c, w in FIELDS.items()])


def is_management(df: DataFrame) -> Column:
    out = F.lit(False)
    for c in FIELDS:
        for r in host_rules(MANAGEMENT):
            out = out | hit(text_of(df, c), r)
    return out


def generations(jobs: DataFrame) -> DataFrame:
    """``jobs`` with script, host and management scores, ``generation`` and ``confidence``, in one projection.

    Management rows first; then rows with a decisive host of the second generation; the others by weighted totals of hosts (3) and scripts (1).
    Totals that are both 0 are unknown.
    """
    script = F.concat(text_of(jobs, "command"), F.lit(" "), text_of(jobs, "job_name"))
    first, second = script_rules(FIRST_SCRIPTS), script_rules(SECOND_SCRIPTS)
    x = once(
        jobs,
        {
            "first_script": weights(script, first),
            "second_script": weights(script, second),
            "script_evidence": F.concat(evidence(script, first), evidence(script, second)),
            "management": is_management(jobs),
            "decisive": host_score(jobs, DECISIVE),
            "first_host": host_score(jobs, FIRST_HOSTS),
            "second_host": host_score(jobs, SECOND_HOSTS),
        },
    )
    # Hosts are scored further only where none is decisive, and not at all for management rows.
    x = x.withColumn("decisive", F.when(F.col("management"), 0.0).otherwise(F.col("decisive")))
    open_ = ~F.col("management") & (F.col("decisive") == 0)
    x = x.withColumns({c: F.when(open_, F.col(c)).otherwise(0.0) for c in ("first_host", "second_host")})
    a = HOST_WEIGHT * F.col("first_host") + F.col("first_script")
    b = HOST_WEIGHT * F.col("second_host") + F.col("second_script")
    sure = F.greatest(a, b) / (a + b + 1e-6)
    level = F.when(sure >= HIGH_CONFIDENCE, "second_generation_high").when(sure >= MEDIUM_CONFIDENCE, "second_generation_medium").otherwise("second_generation_low")
    kind = F.when(F.col("management"), "management_nodes").when(F.col("decisive") > 0, "second_generation_high").when(b > a, level).when(a > b, "first_generation").when(a > 0, "mixed_features").otherwise("unknown_category")
    confidence = F.when(F.col("management"), 1.0).when(F.col("decisive") > 0, DECISIVE_CONFIDENCE).when(a != b, sure).when(a > 0, 0.5).otherwise(0.0)
    return once(x, {"generation": kind, "confidence": F.round(confidence, 6)})


def pattern_counts(jobs: DataFrame) -> DataFrame:
    """(job_id, first, second, special, generation): matches of the other rule set over eight columns; clusters with rules of their own first."""
    texts = [text_of(jobs, c) for c in GEN_COLUMNS]
    count = lambda rules: total([F.when(hit(t, r), 1.0).otherwise(0.0) for t in texts for r in rules]).cast("long")
    x = jobs.select("job_id", text_of(jobs, "cluster_name").alias("_c"), count(GEN1).alias("a"), count(GEN2).alias("b"), *[_columns_hit(texts, rules).alias(f"_s{i}") for i, (rules, _) in enumerate(SPECIAL.values())])
    special = F.lit(None).cast("string")
    for i, (name, (rules, generation)) in enumerate(SPECIAL.items()):
        special = F.when((F.col("_c") == name) & (F.col(f"_s{i}") / len(rules) >= SPECIAL_SHARE), generation).otherwise(special)
    x = x.withColumn("special", special)
    plain = F.when((F.col("a") == 0) & (F.col("b") == 0), "unknown").when(F.col("a") > F.col("b"), "first").when(F.col("a") < F.col("b"), "second").otherwise("both")
    return x.select("job_id", F.col("a").alias("first"), F.col("b").alias("second"), "special", F.coalesce("special", plain).alias("generation"))


def _columns_hit(texts: list[Column], rules: list[Rule]) -> Column:
    """Number of columns in which any rule matches."""
    out = F.lit(0)
    for t in texts:
        one = F.lit(False)
        for r in rules:
            one = one | hit(t, r)
        out = out + one.cast("int")
    return out


def job_types(jobs: DataFrame) -> DataFrame:
    """(job_id, type, score, words, resources, queues): the best type by text (0.40), resources (0.35), queue (0.15) and status (0.10), with its evidence.

    A resource field that a row has not is left out of its share; of equal scores the first type counts; a score of 0 is Unknown.
    """
    x = jobs.withColumn("duration", C.seconds("start_time", "end_time")) if "duration" not in jobs.columns else jobs
    command, queue = F.lower(text_of(x, "command")), text_of(x, "queue")
    found = lambda text, words: F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words]))
    parts = []
    for i, (name, (words, needs, queues)) in enumerate(JOB_TYPES.items()):
        text_hits, queue_hits = found(command, words), found(queue, queues)
        there = [F.when(number_of(x, c).isNotNull(), 1).otherwise(0) for c in needs]
        inside = lambda c, low, high: (number_of(x, c) >= low) & (number_of(x, c) <= high if high else F.lit(True))
        met = F.array_compact(F.array(*[F.when(inside(c, *span), F.lit(c)) for c, span in needs.items()]))
        known = sum(there[1:], there[0])
        score = (
            TYPE_WEIGHTS["text"] * F.least(F.lit(1.0), F.size(text_hits) / max(1.0, len(words) * 0.1))
            + TYPE_WEIGHTS["resources"] * F.when(known > 0, F.size(met) / known).otherwise(0.0)
            + TYPE_WEIGHTS["queue"] * F.size(queue_hits) / len(queues)
            + TYPE_WEIGHTS["status"] * F.when(number_of(x, "exit_status") == 0, 1.0).otherwise(0.0)
        )
        parts.append(F.struct(F.round(score, 6).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("type"), text_hits.alias("words"), met.alias("resources"), queue_hits.alias("queues")))
    best = F.greatest(*parts)
    got = x.select("job_id", best.alias("t"))
    joined = [F.array_join(F.when(F.col("t.score") > 0, F.col(f"t.{c}")).otherwise(F.array()), ",").alias(c) for c in ("words", "resources", "queues")]
    return got.select("job_id", F.when(F.col("t.score") > 0, F.col("t.type")).otherwise("Unknown").alias("type"), F.col("t.score").alias("score"), *joined)


def tokens(jobs: DataFrame) -> Column:
    """Distinct words of command and name."""
    text = F.lower(F.concat_ws(" ", text_of(jobs, "command"), text_of(jobs, "job_name")))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)))


def learned_words(jobs: DataFrame, least: int = 5) -> list[str]:
    """Words of the fixed lists that ``least`` or more jobs of the log use: at most as many as the lists have."""
    lists = sorted({w for ws in [*LLM_WORDS.values(), *OTHER_WORDS.values()] for w in ws})
    met = jobs.select(F.explode(F.array_intersect(tokens(jobs), F.array(*map(F.lit, lists)))).alias("word"))
    return sorted(r["word"] for r in met.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect())


def language_model_jobs(jobs: DataFrame, least: int = 5) -> DataFrame:
    """``jobs`` with the verdict by words (``llm_score``, ``other_score``, ``word_confidence``, ``by_words``, ``word_evidence``), by resources
    (``pattern``, ``resource_confidence``) and both (``kind``, ``how``), in one projection.

    Words count only if the log uses them ``least`` times; model names count 5. A row is LLM by words from score 3 and confidence 0.65 on, Non_LLM
    by words from a confidence over 0.5 on without being LLM; the rest go by the first resource pattern of which half is met.
    """
    known = learned_words(jobs, least)
    x = jobs.withColumn("_words", tokens(jobs)).withColumn("hours", C.seconds("start_time", "end_time") / 3600)
    text = F.concat_ws(" ", text_of(jobs, "command"), text_of(jobs, "job_name"))
    met = lambda ws: F.array_intersect("_words", F.array(*[F.lit(w) for w in ws if w in known]).cast("array<string>"))
    models = [F.when(hit(text, r), MODEL_WEIGHT).otherwise(0) for r in MODEL_NAMES]
    llm = sum((w * F.size(met(ws)) for w, ws in LLM_WORDS.items()), F.lit(0)) + sum(models[1:], models[0])
    other = sum((F.size(met(ws)) for ws in OTHER_WORDS.values()), F.lit(0))
    x = once(x, {"llm_score": llm.cast("long"), "other_score": other.cast("long"), "word_evidence": F.concat(*[met(ws) for ws in LLM_WORDS.values()], evidence(text, MODEL_NAMES))})
    share = F.col("llm_score") / F.greatest(F.lit(1), F.col("llm_score") + F.col("other_score"))
    confidence = F.when(F.col("llm_score") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + (share - 0.5) * 1.2))).when(F.col("other_score") > 0, F.least(F.lit(1.0), 0.5 + 0.1 * F.col("other_score"))).otherwise(0.0)
    x = x.withColumn("word_confidence", F.round(confidence, 6))
    is_llm = (F.col("llm_score") >= LEAST_SCORE) & (F.col("word_confidence") >= LEAST_CONFIDENCE)
    x = x.withColumn("by_words", F.when(is_llm, "LLM").when(F.col("word_confidence") > 0.5, "Non_LLM"))
    best = F.lit(None).cast("struct<pattern:string,confidence:double>")
    for name, needs, sure in reversed(LLM_RESOURCES):
        hits = [F.when(F.coalesce(number_of(x, c) >= v, F.lit(False)), 1).otherwise(0) for c, v in needs.items()]
        ratio = sum(hits[1:], hits[0]) / len(needs)
        best = F.when(ratio >= 0.5, F.struct(F.lit(name).alias("pattern"), (sure * ratio).alias("confidence"))).otherwise(best)
    x = once(x, {"_r": best}).withColumns({"pattern": F.col("_r.pattern"), "resource_confidence": F.round(F.col("_r.confidence"), 6)})
    by_resources = F.when(F.col("pattern").isNotNull(), "LLM").otherwise("Non_LLM")
    x = x.withColumns({"kind": F.coalesce("by_words", by_resources), "how": F.when(F.col("by_words").isNotNull(), "words").otherwise("resources")})
    return x.drop("_words", "_r", "hours")


def task(text: Column) -> Column:
    """First task one of whose words the text holds."""
    out = F.lit("unknown")
    for name, words in reversed(TASKS.items()):
        one = F.lit(False)
        for w in words:
            one = one | F.lower(text).contains(w)
        out = F.when(one, name).otherwise(out)
    return out
