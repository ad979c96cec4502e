"""Named queries of the engine: how to build each, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def register(build):
        QUERIES[build.__name__] = Query(build, sql)
        return build

    return register
