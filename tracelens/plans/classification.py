"""Queries of the rule tables, each with DuckDB SQL made from the same tables and evaluated over the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.operators import classify, cleaning, exact, rules
from tracelens.plans.registry import _SECONDS, _VIEWS, _add, _mean

_text = lambda v: "'" + v.replace("'", "''") + "'"


def _hit(text: str, rule: rules.Rule) -> str:
    return f"regexp_matches({text}, {_text('(?i)' + rule.pattern)})"


def _sum(text: str, table: list[rules.Rule], factor: float = 1.0) -> str:
    return "(" + " + ".join(f"CASE WHEN {_hit(text, r)} THEN {r.weight * factor}::DOUBLE ELSE 0 END" for r in table) + ")"


def _hosts(patterns: dict) -> str:
    return " + ".join(_sum(f"coalesce({c}, '')", rules.host_rules(patterns), w) for c, w in rules.FIELDS.items())


def _found(text: str, table: list[rules.Rule]) -> str:
    return ", ".join(f"CASE WHEN {_hit(text, r)} THEN {_text(r.pattern)} END" for r in table)


_FIRST, _SECOND = rules.script_rules(rules.FIRST_SCRIPTS), rules.script_rules(rules.SECOND_SCRIPTS)
_ANY = " OR ".join(_hit(f"coalesce({c}, '')", r) for c in rules.FIELDS for r in rules.host_rules(rules.MANAGEMENT))
_VIEWS["scored"] = f"""SELECT *, {_sum('s', _FIRST)} AS first_script, {_sum('s', _SECOND)} AS second_script, concat_ws(',', {_found('s', _FIRST + _SECOND)}) AS evidence, ({_ANY}) AS management,
    CASE WHEN {_ANY} THEN 0.0::DOUBLE ELSE {_hosts(rules.DECISIVE)} END AS decisive, {_hosts(rules.FIRST_HOSTS)} AS f, {_hosts(rules.SECOND_HOSTS)} AS g FROM (SELECT *, coalesce(command, '') || ' ' || coalesce(job_name, '') AS s FROM work)"""
_VIEWS["gen"] = """SELECT *, CASE WHEN management THEN 'management_nodes' WHEN decisive > 0 THEN 'second_generation_high' WHEN b > a THEN 'second_generation_' || CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END WHEN a > b THEN 'first_generation' WHEN a > 0 THEN 'mixed_features' ELSE 'unknown_category' END AS generation,
    round(CASE WHEN management THEN 1.0::DOUBLE WHEN decisive > 0 THEN 0.95::DOUBLE WHEN a <> b THEN c WHEN a > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS confidence
    FROM (SELECT *, greatest(a, b) / (a + b + 1e-6) AS c FROM (SELECT *, 3 * first_host + first_script AS a, 3 * second_host + second_script AS b FROM (SELECT *, CASE WHEN NOT management AND decisive = 0 THEN f ELSE 0 END AS first_host, CASE WHEN NOT management AND decisive = 0 THEN g ELSE 0 END AS second_host FROM scored)))"""
_gen = lambda t: rules.generations(t.work)
_add("cls_script_score", lambda t: _gen(t).select("job_id", "first_script", "second_script", F.array_join("script_evidence", ",").alias("evidence")), "SELECT job_id, first_script, second_script, evidence FROM scored")
_add("cls_node_score", lambda t: _gen(t).select("job_id", "decisive", "first_host", "second_host"), "SELECT job_id, decisive, first_host::DOUBLE AS first_host, second_host::DOUBLE AS second_host FROM gen")
_add("cls_mgmt", lambda t: _gen(t).select("job_id", "management"), "SELECT job_id, management FROM scored")
_add("cls_generation", lambda t: _gen(t).select("job_id", "generation", "confidence"), "SELECT job_id, generation, confidence FROM gen")
_add("ag_class_summary", lambda t: _gen(t).groupBy("generation").agg(F.count("*").alias("n"), exact.exact_mean(F.col("confidence")).alias("mean_confidence")), f"SELECT generation, count(*) AS n, {_mean('confidence')} AS mean_confidence FROM gen GROUP BY 1")
_add("cls_majority_anomaly", lambda t: cleaning.majority(t.work), "SELECT cluster_name, arg_min(generation, (-n, generation)) AS generation, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) - max(n) AS BIGINT) AS others FROM (SELECT cluster_name, generation, count(*) AS n FROM gen GROUP BY 1, 2) GROUP BY 1")
_add("jn_anti_range", lambda t: t.work.select("job_id").join(_gen(t).where("generation <> 'unknown_category'").select("job_id"), "job_id", "left_anti"), "SELECT job_id FROM gen WHERE generation = 'unknown_category'")
_add("jn_majority_back", lambda t: _gen(t).join(cleaning.majority(t.work).select("cluster_name", F.col("generation").alias("most")), "cluster_name").select("job_id", (F.col("generation") != F.col("most")).alias("odd")),
     "SELECT job_id, generation <> most AS odd FROM gen JOIN (SELECT cluster_name, arg_min(generation, (-n, generation)) AS most FROM (SELECT cluster_name, generation, count(*) AS n FROM gen GROUP BY 1, 2) GROUP BY 1) USING (cluster_name)")

_HELD = [c for c in rules.GEN_COLUMNS if c not in ("res_req", "application")]
_COUNT = lambda table: " + ".join(f"{_hit(f'coalesce({c}, {chr(39) * 2})', r)}::BIGINT" for c in _HELD for r in table)
_SPECIAL = " ".join(
    f"WHEN cluster_name = '{name}' AND ({' + '.join('(' + ' OR '.join(_hit(f'coalesce({c}, {chr(39) * 2})', r) for r in table) + ')::INT' for c in _HELD)}) / {len(table)}.0::DOUBLE >= {rules.SPECIAL_SHARE}::DOUBLE THEN '{generation}'"
    for name, (table, generation) in rules.SPECIAL.items()
)
_add("cls_generation2", lambda t: rules.pattern_counts(t.work), f"""SELECT job_id, a AS first, b AS second, special, coalesce(special, CASE WHEN a = 0 AND b = 0 THEN 'unknown' WHEN a > b THEN 'first' WHEN a < b THEN 'second' ELSE 'both' END) AS generation
    FROM (SELECT job_id, {_COUNT(rules.GEN1)} AS a, {_COUNT(rules.GEN2)} AS b, CASE {_SPECIAL} END AS special FROM work)""")


def _type(name: str) -> str:
    """Score and evidence of one job type."""
    words, needs, queues = rules.JOB_TYPES[name]
    contains = lambda x, ws: [f"CASE WHEN contains({x}, '{w}') THEN '{w}' END" for w in ws]
    inside = [f"CASE WHEN {c} >= {low}" + (f" AND {c} <= {high}" if high else "") + f" THEN '{c}' END" for c, (low, high) in needs.items()]
    lists = [f"list_filter([{', '.join(x)}], lambda w: w IS NOT NULL)" for x in (contains("c", words), inside, contains("q", queues))]
    known = " + ".join(f"({c} IS NOT NULL)::INT" for c in needs)
    return f"""SELECT job_id, '{name}' AS type, {list(rules.JOB_TYPES).index(name)} AS place, round(0.4::DOUBLE * least(1.0::DOUBLE, len(w) / {max(1.0, len(words) * 0.1)}::DOUBLE) + 0.35::DOUBLE * CASE WHEN k > 0 THEN len(r) / k ELSE 0 END + 0.15::DOUBLE * len(u) / {len(queues)} + 0.1::DOUBLE * (coalesce(exit_status = 0, false))::INT, 6) AS score, w, r, u
    FROM (SELECT *, {lists[0]} AS w, {lists[1]} AS r, {lists[2]} AS u, {known} AS k FROM (SELECT *, lower(coalesce(command, '')) AS c, coalesce(queue, '') AS q, {_SECONDS} AS duration FROM work))"""


_VIEWS["typed"] = f"""SELECT job_id, CASE WHEN score > 0 THEN type ELSE 'Unknown' END AS type, score, CASE WHEN score > 0 THEN array_to_string(w, ',') ELSE '' END AS words, CASE WHEN score > 0 THEN array_to_string(r, ',') ELSE '' END AS resources, CASE WHEN score > 0 THEN array_to_string(u, ',') ELSE '' END AS queues
    FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, place) AS nth FROM ({' UNION ALL '.join(map(_type, rules.JOB_TYPES))})) WHERE nth = 1"""
_add("cls_type_score", lambda t: rules.job_types(t.work), "SELECT * FROM typed")
_add("cls_type_distribution", lambda t: classify.type_distribution(t.work), f"SELECT type, count(*) AS n, {_mean('score')} AS mean_score, count_if(score >= 0.7) AS sure FROM typed GROUP BY 1")

_LEXICON = ", ".join([f"('{w}', {n}, 0)" for n, ws in rules.LLM_WORDS.items() for w in ws] + [f"('{w}', 0, 1)" for ws in rules.OTHER_WORDS.values() for w in ws])
_VIEWS["lexicon"] = f"SELECT * FROM (VALUES {_LEXICON}) l(word, w, o)"
_VIEWS["used"] = "SELECT DISTINCT job_id, unnest(regexp_extract_all(lower(coalesce(command, '') || ' ' || coalesce(job_name, '')), '[a-z0-9_-]{2,}')) AS word FROM work"
_VIEWS["learned"] = "SELECT lexicon.* FROM lexicon JOIN (SELECT word FROM used GROUP BY 1 HAVING count(*) >= 5) USING (word)"
_VIEWS["wordy"] = "SELECT job_id, sum(w) AS w, sum(o) AS o, list(word) FILTER (w > 0) AS ws FROM used JOIN learned USING (word) GROUP BY 1"
_MODELS = [f"CASE WHEN {_hit('x', r)} THEN {_text(r.pattern)} END" for r in rules.MODEL_NAMES]
_PATTERN = lambda needs: "(" + " + ".join(f"coalesce({c} >= {v}, false)::INT" for c, v in needs.items()) + f") / {len(needs)}::DOUBLE"
_FITS = " ".join(f"WHEN {_PATTERN(needs)} >= 0.5 THEN '{name}'" for name, needs, _ in rules.LLM_RESOURCES)
_SURE = " ".join(f"WHEN {_PATTERN(needs)} >= 0.5 THEN {sure}::DOUBLE * ({_PATTERN(needs)})" for _, needs, sure in rules.LLM_RESOURCES)
_VIEWS["llm"] = f"""SELECT *, coalesce(by_words, CASE WHEN pattern IS NOT NULL THEN 'LLM' ELSE 'Non_LLM' END) AS kind, CASE WHEN by_words IS NOT NULL THEN 'words' ELSE 'resources' END AS how
    FROM (SELECT *, CASE WHEN llm_score >= 3 AND word_confidence >= 0.65 THEN 'LLM' WHEN word_confidence > 0.5 THEN 'Non_LLM' END AS by_words
    FROM (SELECT *, round(CASE WHEN llm_score > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + (llm_score / greatest(1, llm_score + other_score) - 0.5::DOUBLE) * 1.2::DOUBLE)) WHEN other_score > 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * other_score) ELSE 0 END, 6) AS word_confidence
    FROM (SELECT *, CAST(coalesce(w, 0) + 5 * len(models) AS BIGINT) AS llm_score, CAST(coalesce(o, 0) AS BIGINT) AS other_score, CASE {_FITS} END AS pattern, round(CASE {_SURE} END, 6) AS resource_confidence
    FROM (SELECT *, list_filter([{', '.join(_MODELS)}], lambda m: m IS NOT NULL) AS models, {_SECONDS} / 3600 AS hours FROM (SELECT *, coalesce(command, '') || ' ' || coalesce(job_name, '') AS x FROM work LEFT JOIN wordy USING (job_id))))))"""
_llm = lambda t: rules.language_model_jobs(t.work)
_add("cls_llm_keywords", lambda t: _llm(t).select("job_id", "llm_score", "other_score", "word_confidence", "by_words", F.array_join(F.array_sort("word_evidence"), ",").alias("evidence")),
     "SELECT job_id, llm_score, other_score, word_confidence::DOUBLE AS word_confidence, by_words, array_to_string(list_sort(list_concat(coalesce(ws, []), models)), ',') AS evidence FROM llm")
_add("cls_llm_resources", lambda t: _llm(t).where("how = 'resources'").select("job_id", "kind", "pattern", "resource_confidence"), "SELECT job_id, kind, pattern, resource_confidence FROM llm WHERE how = 'resources'")
_add("cls_llm_pipeline", lambda t: _llm(t).select("job_id", "kind", "how"), "SELECT job_id, kind, how FROM llm")
_TASK = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(c, {_text(w)})' for w in ws)} THEN '{k}'" for k, ws in rules.TASKS.items()) + " ELSE 'unknown' END"
_VIEWS["tasks"] = f"SELECT job_id, {_TASK} AS task FROM (SELECT job_id, lower(coalesce(command, '')) AS c FROM work)"
_add("cls_llm_split", lambda t: classify.llm_split(t.work), "SELECT *, round(100 * n / sum(n) OVER (PARTITION BY kind), 6) AS percent FROM (SELECT kind, how, task, count(*) AS n, count_if(gpu_num > 0) AS gpu_jobs FROM llm JOIN tasks USING (job_id) GROUP BY 1, 2, 3)")
_add("cls_task_type", lambda t: t.work.select("job_id", rules.task(rules.text_of(t.work, "command")).alias("task")), "SELECT job_id, task FROM tasks")
