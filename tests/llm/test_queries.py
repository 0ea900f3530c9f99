"""Queries against their SQL, and registration."""

import duckdb
import pytest

import __spark_entry__
from tracelens.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    assert want and sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLE_SQL])
def test_query_gives_every_row(spark, name):
    table = "pages" if "html" in name else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_all_are_registered():
    found = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {n.split("_")[0] + "_" for n in found if n.startswith("op")} and "pipeline" in found
