"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.operators.graph import components, cut, shared_folder  # noqa: F401

#: A word: a run of code points other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null has no remainder (null)."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def over(row: str, df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The fields of struct ``row`` and the new columns; a field that has a new column's name gives way to it."""
    taken = {x.lower() for x in new}
    kept = [F.col(f"{row}.`{f.name}`").alias(f.name) for f in df.schema[row].dataType.fields if f.name.lower() not in taken]
    return df.select(*kept, *[c.alias(k) for k, c in new.items()])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def blob(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty, a lone surrogate becomes a question mark."""
    return b"" if text is None else text.encode("utf-8", "replace")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (compressed, so smaller than a checkpoint); it goes when Spark ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
