"""Column expressions of the job log: hosts, states, times, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of the scheduler and what they become.
STATES = {"DONE": "COMPLETED", "EXIT": "FAILED", "PEND": "CANCELLED", "ZOMBI": "FAILED", "PSUSP": "CANCELLED", "USUSP": "CANCELLED", "SSUSP": "CANCELLED"}
# Subclusters by host prefix.
PREFIXES = {"gpu1-": "GPU1", "gpu2-": "GPU2", "gpu3-": "GPU3", "cpu1-": "CPU1", "cpu2-": "CPU2", "cpu3-": "CPU3", "bigmem-": "BIGMEM", "bigmen-": "BIGMEM", "bigman-": "BIGMEM"}


def seconds(a: str, b: str) -> Column:
    """Whole seconds from a to b."""
    return F.timestamp_diff("SECOND", F.col(a), F.col(b))


def hour_number(at: str) -> Column:
    """Hours since 1970 of a time without zone."""
    return F.timestamp_diff("HOUR", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col(at))


def state(code: str, exit_status: str) -> Column:
    """Job state: by scheduler name, else by exit status."""
    out = F.when(F.col(exit_status) == 0, "COMPLETED").when(F.col(exit_status) >= 128, "CANCELLED").otherwise("FAILED")
    for k, v in STATES.items():
        out = F.when(F.col(code) == k, v).otherwise(out)
    return out


def base_name(name: str) -> Column:
    """Job name without its trailing number."""
    return F.regexp_replace(F.col(name), r"_?\d+$", "")


def job_type(gpus: str) -> Column:
    return F.when(F.col(gpus) > 0, "gpu").otherwise("cpu")


def hosts(text: str) -> Column:
    """Hosts of a host list, lower-cased and once each: JSON ``nodes``, ``+`` and comma lists, brackets of numbers and ranges, also unclosed, and ``cpu1-103-104``.
    Numbers of a range are as wide as its lower bound is written.

    Every form is an expression on the row: nothing is collected and no distinct list of texts is joined back.
    """
    raw = F.col(text)
    from_json = F.from_json(F.get_json_object(raw, "$.nodes"), "array<string>")
    parts = F.when(raw.startswith("{"), from_json).otherwise(F.regexp_extract_all(raw, F.lit(r"([^\s+,\[\]]+(?:\[[^\[\]+]*\]|\[(?:[^\[\]\s+,]|,(?=\d))*)?)"), F.lit(1)))
    spread = F.flatten(F.transform(parts, _spread))
    return F.array_distinct(F.transform(F.filter(spread, lambda h: h != ""), F.lower))


def _spread(part: Column) -> Column:
    prefix = F.regexp_extract(part, r"^([^\[]*)", 1)
    inner = F.regexp_extract(part, r"\[([^\]]*)", 1)
    dashes = r"^([a-zA-Z]+\d*-)(\d+-\d+)$"

    def item(prefix: Column, x: Column) -> Column:
        low, high = F.regexp_extract(x, r"^(\d+)", 1), F.regexp_extract(x, r"(\d+)$", 1)
        a, b = low.try_cast("long"), high.try_cast("long")
        wide = lambda i: F.lpad(i.cast("string"), F.greatest(F.length(low), F.length(i.cast("string"))), F.lit("0"))
        return F.when(x.rlike(r"^\d+-\d+$") & (a <= b), F.transform(F.sequence(a, F.greatest(a, b)), lambda i: F.concat(prefix, wide(i)))).otherwise(F.array(F.concat(prefix, x)))

    listed = F.flatten(F.transform(F.split(inner, ","), lambda x: item(prefix, F.trim(x))))
    return F.when(part.contains("["), listed).when(part.rlike(dashes), item(F.regexp_extract(part, dashes, 1), F.regexp_extract(part, dashes, 2))).otherwise(F.array(part))


def subcluster(host: Column) -> Column:
    """Subcluster of a host by its prefix."""
    out = F.lit("UNKNOWN")
    for k, v in PREFIXES.items():
        out = F.when(host.startswith(k), v).otherwise(out)
    return out


def right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin (edge, next edge] of a value; null outside."""
    out = F.lit(None).cast("string")
    for a, b, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((value > a) & (value <= b), label).otherwise(out)
    return out


# States by text, by code and by exit status.
STATE_TEXTS = {"DONE": "Pass", "EXIT": "Failed", "TIMEOUT": "Killed", "FAILED": "Failed", "KILLED": "Killed", "CANCELLED": "Killed"}
STATE_CODES = {32: "Pass", 1: "Failed", 2: "Failed", 3: "Killed", 4: "Killed"}
GOOD_EXITS, BAD_EXITS = [0], [1, 2, 130, 143]


def layered_state(text: str, code: str, exit_status: str) -> Column:
    """Struct of state and confidence: by text (0.9), else by code (0.8), else by exit status (0.7), else Unknown (0)."""
    sure = lambda s, c: F.struct(s.alias("state"), F.lit(c).alias("confidence"))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    by_text, by_code = F.try_element_at(table(STATE_TEXTS), F.upper(F.col(text))), F.try_element_at(table(STATE_CODES), F.col(code).cast("int"))
    by_exit = F.when(F.col(exit_status).isin(GOOD_EXITS), "Pass").when(F.col(exit_status).isin(BAD_EXITS), "Failed")
    return F.when(by_text.isNotNull(), sure(by_text, 0.9)).when(by_code.isNotNull(), sure(by_code, 0.8)).when(by_exit.isNotNull(), sure(by_exit, 0.7)).otherwise(sure(F.lit("Unknown"), 0.0))


def _first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"([0-9]+[.]?[0-9]*)", 1).try_cast("double")


def gigabytes(amount: str) -> Column:
    """An amount of memory in GB: by its unit; without one, more than 10,000 are MB."""
    x, n = F.lower(F.trim(F.col(amount))), _first_number(F.lower(F.col(amount)))
    return F.when(x.contains("t"), n * 1024).when(x.contains("g"), n).when(x.contains("m"), n / 1024).when(x.contains("k"), n / 1048576).otherwise(F.when(n > 10000, n / 1024).otherwise(n))


def run_hours(amount: str) -> Column:
    """A run time in hours: H:M:S, M:S, a number with a unit, or a bare number, of which more than 10,000 are seconds."""
    x = F.lower(F.trim(F.col(amount)))
    part = lambda i: F.try_element_at(F.split(x, ":"), F.lit(i)).try_cast("int")
    n, unit = _first_number(x), F.regexp_extract(x, r"[0-9]+[.]?[0-9]*\s*([a-z]*)", 1)
    clock = F.when(F.size(F.split(x, ":")) == 3, part(1) + part(2) / 60 + part(3) / 3600).when(F.size(F.split(x, ":")) == 2, part(1) / 60 + part(2) / 3600)
    by_unit = F.when(unit.contains("day") | (unit == "d"), n * 24).when(unit.contains("hour") | unit.contains("hr") | (unit == "h"), n).when(unit.contains("min") | (unit == "m"), n / 60).when(unit.contains("sec") | (unit == "s"), n / 3600)
    return F.coalesce(clock, by_unit, F.when(n > 10000, n / 3600).otherwise(n))


def bare_count(amount: str) -> Column:
    """A number of cores or GPUs: all digits and points of the text as one number."""
    return F.regexp_replace(F.col(amount), r"[^0-9.]", "").try_cast("double")
