"""Registered queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Every builder takes ``(spark, sf_dir)``, reads whole test tables (or DataFrames
Spark derives from them) and returns a lazy DataFrame.  Column names are
aliased identically in the builder and its SQL so results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers itself on import)."""
    from codeweave.plans import (  # noqa: F401
        q_analysis, q_generation, q_indexing, q_graph, q_search,
    )
