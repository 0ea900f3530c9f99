"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracelens.plans import classification, extended, profiles, registry  # noqa: F401
from tracelens.sources.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: (lambda s, d, f=f: f(Tables(s, d))) for k, (f, _) in registry._ALL.items()}
ORACLE_SQL: dict[str, str] = {k: sql for k, (_, sql) in registry._ALL.items()}
