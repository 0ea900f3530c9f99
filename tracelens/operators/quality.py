"""Quality of a log whose fields are text: parts of the score, each a column, from one profile by (column, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.operators import exact
from tracelens.operators.graph import cut

TIMES = ("submit_time", "start_time", "end_time")
# Weights of the parts and the grades' limits.
PARTS = {"completeness": 0.3, "consistency": 0.25, "validity": 0.25, "uniqueness": 0.2}
GRADES = [(0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D")]


def profile(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(name, value, n): how often each value of each column in ``types`` occurs; merged in the tasks before the shuffle."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in types]))
    return df.select(cells.alias("c")).groupBy("c.name", "c.value").agg(F.count("*").alias("n"))


def fits(types: dict[str, str]) -> Column:
    """Whether a value of the profile reads as its column's type."""
    out = F.lit(None).cast("boolean")
    for c, t in types.items():
        out = F.when(F.col("name") == c, F.col("value").try_cast(t).isNotNull()).otherwise(out)
    return out


def columns(cells: DataFrame, types: dict[str, str]) -> DataFrame:
    """Per column: values, nulls, different values, share that reads as the type, share that is not empty."""
    known = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    share = lambda ok: F.round(F.sum(F.when(ok, F.col("n")).otherwise(0)) / F.nullif(F.sum(known), F.lit(0)), 9)
    return cells.groupBy("name").agg(
        F.sum(known).alias("n"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"), F.count("value").alias("different"),
        share(fits(types)).alias("typed"), share(F.length("value") > 0).alias("filled"),
    )


def outliers(cells: DataFrame, types: dict[str, str], ranges: float = 1.5) -> DataFrame:
    """Per numeric column the share of its values outside the quartiles by ``ranges`` interquartile ranges; quartiles by radix selection."""
    numeric = [c for c, t in types.items() if t in ("long", "double")]
    x = cells.where(F.col("name").isin(numeric)).withColumn("v", F.col("value").try_cast("double")).where("v is not null")
    q = exact.quantiles(x, ["name"], "v", [0.25, 0.75], weight="n")
    q = q.groupBy("name").agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"), F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    far = (F.col("v") < F.col("q1") - ranges * (F.col("q3") - F.col("q1"))) | (F.col("v") > F.col("q3") + ranges * (F.col("q3") - F.col("q1")))
    return x.join(q, "name").groupBy("name").agg(F.round(F.sum(F.when(far, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("outside"))


def assess(df: DataFrame, types: dict[str, str], *, key: str = "job_id", keys: tuple[str, ...] = ("user_id", "job_id", "exit_status"), now: str = "2024-03-01 00:00:00") -> DataFrame:
    """One row: the parts of the quality, their weighted score and its grade.

    Completeness is the share of cells that hold a value; consistency the mean over columns of the share that reads as the column's type; validity
    the mean over ``keys`` of the share that is neither empty nor of another type; uniqueness the share of rows that are no copy. Besides: the share of
    different ``key`` values, of rows with three times in order, of numbers within the quartiles' ranges, and freshness (1 now, 0 after a year). An
    empty table gives a row of nulls.
    """
    cells = cut(profile(df, types))
    per = columns(cells, types)
    sums = per.agg(
        F.round(F.sum("n") / F.nullif(F.sum(F.col("n") + F.col("nulls")), F.lit(0)), 9).alias("completeness"), F.round(F.avg(F.coalesce("typed", F.lit(1.0))), 9).alias("consistency"),
        F.round(F.avg(F.when(F.col("name").isin(*keys), F.least("typed", "filled"))), 9).alias("validity"), F.round(F.max(F.when(F.col("name") == key, F.col("different") / F.nullif(F.col("n"), F.lit(0)))), 9).alias("key_uniqueness"),
    )
    unlike = df.select(*types).distinct().agg(F.count("*").alias("unlike"))
    at = {c: F.col(c).try_cast("timestamp_ntz") for c in TIMES}
    all_three = at["submit_time"].isNotNull() & at["start_time"].isNotNull() & at["end_time"].isNotNull()
    ordered = all_three & (at["submit_time"] <= at["start_time"]) & (at["start_time"] <= at["end_time"])
    old = F.timestamp_diff("DAY", F.greatest(*[F.max(c) for c in at.values()]), F.lit(now).cast("timestamp_ntz"))
    rows = df.agg(F.count("*").alias("rows"), F.round(F.count_if(ordered) / F.nullif(F.count_if(all_three), F.lit(0)), 9).alias("time_logic"), F.round(F.greatest(F.lit(0.0), 1 - old / 365), 9).alias("freshness"))
    within = outliers(cells, types).agg(F.round(1 - F.avg("outside"), 9).alias("within_ranges"))
    # One row each: put below one another and merged, as a join of single rows has no key.
    parts = rows.unionByName(sums, True).unionByName(unlike, True).unionByName(within, True)
    x = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    x = x.withColumn("uniqueness", F.round(F.col("unlike") / F.nullif(F.col("rows"), F.lit(0)), 9)).drop("unlike")
    score = sum((w * F.col(c) for c, w in list(PARTS.items())[1:]), PARTS["completeness"] * F.col("completeness"))
    x = x.withColumn("score", F.round(score, 6))
    grade = F.when(F.col("score").isNotNull(), "F")
    for limit, name in reversed(GRADES):
        grade = F.when(F.col("score") >= limit, name).otherwise(grade)
    return x.withColumn("grade", grade)
