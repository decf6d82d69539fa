"""Registry of named queries: a Spark builder and, where SQL can say it, a DuckDB oracle.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
input tables.  Oracle SQL runs on the same parquet files registered as views
and must produce the same column names and values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
KIND: dict[str, str] = {}


def register(key: str, sql: str | None = None, kind: str = "O"):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        KIND[key] = kind
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from plotrows.plans import corpus_queries, inference_queries, source_queries, training_queries  # noqa: F401
