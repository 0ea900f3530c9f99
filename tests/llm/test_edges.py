"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelens.llm import exact_topk, html_extraction, line_dedup, line_rules, mixing, ngram_lm, quality_classifier, sentencepiece_codec, simhash, url_filter
from tracelens.llm.queries import PIECES, URL_RULES

LONG = "\n".join(" ".join(f"w{(i * 37 + j) % 999}" for j in range(60)) for i in range(400))
ROWS = [
    (1, "a b c d\ne f g h", "en", "s1", 15),
    (1, "a b c d\ne f g h", "en", "s1", 15),
    (2, "", "en", None, 0),
    (3, None, None, "s1", None),
    (None, "x y z", "de", "s2", 5),
    (None, None, None, None, None),
    (4, LONG, "en", "s1", len(LONG)),
    (5, " \n\t \n", "en", "", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "h", "t", "th", "fp", "s", "size", "id", "removed_lines", "ids", "path", "host", "learn", "bundle", "k_id", "host_len", "q", "v"]


def table(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "line_dedup": lambda s, d: line_dedup.dedup_lines(d),
    "line_passages": lambda s, d: line_dedup.dedup_lines(d, passages=True),
    "quality_classifier": lambda s, d: d.select("doc_id", quality_classifier.score(quality_classifier.fit(d, labels(s)), d).alias("score")),
    "line_rules": lambda s, d: d.select("doc_id", line_rules.judge(line_rules.fit(d, labels(s)), d).alias("j")),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "sentencepiece": lambda s, d: sentencepiece_codec.encode(d, PIECES),
    "lm": lambda s, d: ngram_lm.score(d, F.col("doc_id") % 2 == 0),
    "mixing": lambda s, d: mixing.taken(p := mixing.plan(d), mixing.draw(p)),
    "html": lambda s, d: html_extraction.extract(d.withColumnRenamed("text", "html").withColumn("url", F.col("source"))),
    "url": lambda s, d: url_filter.filter_urls(d.withColumn("url", F.col("text")), url_filter.rule_table(s, URL_RULES), id_col="doc_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(spark, name):
    assert OPERATORS[name](spark, table(spark)).count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


def test_stages_keep_columns_and_stand_odd_rows(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * len(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_pipeline_runs_through(spark, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    table(spark).select(*[x.split()[0] for x in SCHEMA.split(", ")]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"


def test_vectors(spark):
    rows = [(20, [1.0, 2.0], 1), (20, [1.0, 2.0], 1), (1, [0.5], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (6, [], 1), (40, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("far", F.lit(1))
    got = sorted(tuple(r) for r in exact_topk.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(20, 1, 1, 2048), (20, 2, 6, 0), (20, 3, 40, -4096), (40, 1, 6, 0), (40, 2, 1, -2048), (40, 3, 20, -4096)]
    assert exact_topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).collect() == []
