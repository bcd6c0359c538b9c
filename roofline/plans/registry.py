"""Registry of named queries: a Spark plan plus an independent DuckDB oracle.

``register(name, sql=...)`` decorates a function ``(tables) -> DataFrame``; the
SQL (when given) runs on DuckDB views named like the parquet tables.  Queries
without SQL get the driver's rows-only check and a brute-force test in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def as_callable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))
    run.__name__ = name
    return run


def load_all() -> None:
    """Import every query module so that its queries register."""
    from . import (q_delivery, q_extract, q_funnel, q_matching, q_pages, q_results,  # noqa: F401
                   q_runlog, q_searches, q_streaming, q_supplier)
