"""A job log as CSV text: fields read by a declared schema, what does not read kept and marked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelens.operators.rules import once

SCHEMA = "job_id long, job_name string, cpu_num long, submit_time timestamp_ntz, start_time timestamp_ntz, end_time timestamp_ntz"
#: Quotes are doubled inside quotes; line breaks and commas may stand inside them. ``NA`` and nothing are null.
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "escape": '"', "nullValue": "NA", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def _as_text(schema: str) -> str:
    return ", ".join(f"{f.split()[0]} string" for f in schema.split(", "))


def parsed(lines: DataFrame, column: str = "line", schema: str = SCHEMA) -> DataFrame:
    """One row a record: its fields by ``schema``, ``status`` and the record itself (``bad``) where it is not good.

    ``corrupt``: another number of fields than the schema's, or a quote left open. ``coerced``: a field that does not read as its type; it
    is null, the others stand. Null and empty records have no row.
    """
    records = lines.where(F.length(column) > 0)
    fields = F.from_csv(F.col(column), f"{schema}, bad string", OPTIONS)
    texts = F.from_csv(F.col(column), f"{_as_text(schema)}, bad string", OPTIONS)
    # Read once a row, whatever filters and columns follow; as texts only what does not read by its types.
    x = once(records.select(column), {"f": fields})
    status = F.when(F.col("f.bad").isNull(), "good").when(texts["bad"].isNotNull(), "corrupt").otherwise("coerced")
    return once(x, {"f": F.col("f"), "status": status}).select("f.*", "status")


def jobs_as_text(jobs: DataFrame) -> DataFrame:
    """(line): the log's records as text, some of them with quotes, commas and line breaks in the name, and some spoilt.

    By the job's number: 3 of 11 has a number of cores that is none, 5 of 13 lacks its last field, 6 of 17 has one too many, 2 of 19 leaves a quote open.
    """
    at = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("NA"))
    name = F.concat(F.lit('"'), F.regexp_replace(odd_name(), '"', '""'), F.when(F.col("job_id") % 19 == 2, "").otherwise('"'))
    cores = F.when(F.col("job_id") % 11 == 3, "many").otherwise(F.col("cpu_num").cast("string"))
    end = F.when(F.col("job_id") % 13 == 5, F.lit(None)).otherwise(at("end_time"))
    more = F.when((F.col("job_id") % 17 == 6) & (F.col("job_id") % 13 != 5), F.lit("more"))
    return jobs.select(F.concat_ws(",", F.col("job_id").cast("string"), name, cores, at("submit_time"), at("start_time"), end, more).alias("line"))


def odd_name():
    """Names of which every third holds a quoted word, and every fifth a line break and a comma."""
    named = F.when(F.col("job_id") % 3 == 0, F.concat("job_name", F.lit(' "x"'))).otherwise(F.col("job_name"))
    return F.when(F.col("job_id") % 5 == 0, F.concat(named, F.lit("\nand, more"))).otherwise(named)
