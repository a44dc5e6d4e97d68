"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` and their oracle SQL.

Every query reads the given tables (or fixtures Spark derives from them) in
full. Column names and types match the oracle: counts BIGINT, ratios DOUBLE
rounded to 6 decimals, arrays joined into text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


QUERY_MODULES = ("q_scoring", "q_text", "q_corpus", "q_preference", "q_router", "q_metrics", "q_io")


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import importlib.util

    for mod in QUERY_MODULES:
        name = f"ferrule.plans.{mod}"
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
