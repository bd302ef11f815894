"""Registered queries of the engine: key -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under key, with the SQL that gives the same rows."""

    def keep(run: Query) -> Query:
        CATALOG[key] = run, sql
        return run

    return keep


from meridia.plans import cohort_files, connectivity, images, learning, relational, scores, signals, statistics  # noqa: E402, F401
