"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed by full digests.

Every distinct (host, path) of the pages is expanded into all its host suffixes at label borders times the path prefixes of those
lengths that occur among the rules (a rule's path is any string prefix). An expression meets the rules by an equi-join on the first
hex digits of its SHA-256; the full digest confirms, and the longest rule wins.

Edge cases: a null url, or one without ``://``, has an empty host and path, which no rule fits. Of two rules of one length the one
with the longer host wins, of two equal rules with different verdicts ``block``. Repeated rows each get their own row. An empty table gives no
rows; without rules every verdict is ``default``. Only the id and url columns are read: other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a digest on which the join is made.
SHORT = 8


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a url; empty without ``://``."""
    u, at = F.col(url), F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Rows (id, host, path, rule, verdict) for every page."""
    host, path = host_and_path(url_col)
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))

    # One rule for each (host, path): block before allow.
    ranked = rules.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    rule = F.concat("host", "path")
    known = ranked.select(
        rule.alias("rule"), F.length("host").alias("host_len"), F.col("verdict").alias("rule_verdict"), _digest(F.concat_ws(" ", "host", "path")).alias("rule_digest")
    ).withColumn("short", F.substring("rule_digest", 1, SHORT))

    # The lengths of rule paths: at most the longest path's length, whatever the number of rules.
    lengths = sorted(r[0] for r in ranked.select(F.length("path")).distinct().collect())
    pairs = parsed.where("host != ''").select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    expanded = (
        pairs.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .select("host", "path", _digest(F.concat_ws(" ", "suffix", "prefix")).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )
    hits = expanded.join(known, "short").where(F.col("digest") == F.col("rule_digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", "rule", "rule_verdict")).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        F.col(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict")
    )
