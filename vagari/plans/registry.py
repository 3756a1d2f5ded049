"""Registered queries by operator id, and the DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql:
            ORACLES[key] = with_views(sql, *views) if views else sql
        return f

    return put


def load() -> None:
    """Import the catalogue, which registers its queries."""
    from . import caption_queries, chunk_queries, detection_queries, evaluation_queries, file_queries, language_queries, run_queries, training_queries, written_queries  # noqa: F401
