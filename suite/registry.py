"""Query registry: one builder and, where SQL can express it, one SQL twin per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.sql_views import with_views
from suite.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its SQL twin."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def expanded_oracle() -> dict[str, str]:
    """SQL twins with the views they use in front."""
    return {name: with_views(sql) for name, sql in ORACLE.items()}
