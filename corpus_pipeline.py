"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, mixing, SentencePiece encoding.

Every stage is a function of (spark, docs, folder of the given tables); its result is written to the shared folder and read again
as the next one's documents. All but the last keep the columns of ``documents``.

Nulls in any column, empty texts and repeated rows pass through as the operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import line_dedup, mixing, quality_classifier, sentencepiece_codec, simhash
from tracelens.llm.common import crc32_mod, read, written
from tracelens.llm.queries import PIECES


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more; it learns from the labels that are not held out."""
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels").where(crc32_mod("doc_id", 3) != 1))
    rows = docs.select(F.struct("*").alias("row"), quality_classifier.score(model, docs).alias("score"))
    return rows.where("score >= 0.5").select("row.*")


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks of lines that occur before; ``n_chars`` follows the text. No document goes."""
    done = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (three-word shingles, two bits, as the operator's contract has it)."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it: not at all, once or twice."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    coded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), PIECES)
    return coded.select("doc_id", "source", "n_tokens", "round_trip", "parity", "ids")


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Neither the classifier nor SimHash can be said in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
