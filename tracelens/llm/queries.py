"""The operators' queries over the given tables. Every one reads its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import exact_topk, html_extraction, language_id, line_dedup, line_rules, merkle, mixing, ngram_lm, oracles, quality_classifier, sentencepiece_codec, simhash, spelling, url_filter
from tracelens.llm.common import crc32_mod, read

#: A SentencePiece model of a public tokenizer.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Rules of the URL query: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents"), passages=True)
    return done.select("doc_id", "text", "removed_chunks", "removed_lines", "removed_chars")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels").where(crc32_mod("doc_id", 3) != 1))
    scored = docs.select("doc_id", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), quality_classifier.score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = line_rules.fit(docs, read(spark, sf_dir, "labels"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_content_lines", "content_share"]
    return docs.select("doc_id", line_rules.judge(field, docs).alias("j")).select("doc_id", *[F.col(f"j.{n}") for n in names])


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return coded.select("doc_id", "n_tokens", "n_unknown", "round_trip", "parity", "ids")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "path")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    mixed = mixing.taken(planned, mixing.draw(planned))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "shard")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(read(spark, sf_dir, "documents"), crc32_mod("doc_id", 10) == 0).withColumnRenamed("id", "doc_id")
    # Sums of logarithms depend on their order in the last digits.
    return scored.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = merkle.manifest(docs, fields=["doc_id", "source", "lang", "n_chars", "text"], tampered=crc32_mod("doc_id", 5) == 0)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out), PIECES)
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.identify(model, docs).alias("j"))
    return found.select("doc_id", "held_out", F.col("j.lang").alias("lang_pred"), F.col("j.score").alias("score"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(read(spark, sf_dir, "documents"), misspell=97)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_quality_classifier,
        op3_line_rules,
        op4_url_filters,
        op5_simhash,
        op6_sentencepiece,
        op7_html_extraction,
        op8_mixing,
        op9_exact_topk,
        op10_lm_scoring,
        op11_merkle,
        op12_language_id,
        op13_spelling,
    )
}
#: The other queries rest on hashes, models or parsers that SQL has not; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": oracles.urls(URL_RULES),
    "op9_exact_topk": oracles.TOP_K,
    "op10_lm_scoring": oracles.LANGUAGE_MODEL,
    "op11_merkle": oracles.MERKLE,
    "op13_spelling": oracles.SPELLING,
}
