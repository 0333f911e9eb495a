"""All queries of the library with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans import corpus, files, playback, scenes, space, trade

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (corpus, trade, space, scenes, files, playback)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
