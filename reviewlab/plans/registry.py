"""Registry of the driver's queries: name -> (Spark builder, DuckDB oracle).

A Spark builder takes (spark, sf_dir) and returns a DataFrame. The oracle is
the same computation in DuckDB SQL over the same parquet tables, or None for
steps whose check is rows-only (their unit tests compare with brute force).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewlab.plans.oracle import fixture_sql

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw_sql: str | None = None):
    """Register a query. ``sql`` is wrapped in the fixture CTEs; ``raw_sql``
    is used as it is (for queries over the driver's tables only)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = fixture_sql(sql)
        elif raw_sql is not None:
            ORACLES[name] = raw_sql
        return fn
    return deco
