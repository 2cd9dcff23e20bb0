"""Name -> query. A query is a function of (spark, folder) and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    operators: tuple[str, ...]
    sql: str | None = None
    headline: bool = False


REGISTRY: dict[str, Query] = {}


def query(name: str, *operators: str, sql: str | None = None, headline: bool = False) -> Callable[[Run], Run]:
    """Register the decorated function. ``operators`` are the ids of the inventory it covers."""
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, run, operators, sql, headline)
        return run
    return register


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    from . import (  # noqa: F401
        evaluation_queries, finding_queries, ingest_queries, job_queries, patch_queries, report_queries,
        store_queries, stream_queries,
    )
    return REGISTRY
