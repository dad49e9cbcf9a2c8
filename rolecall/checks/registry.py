"""Registered queries and, next to each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolecall.checks.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register `build(fixtures) -> DataFrame`; `sql` may name the fixture views."""

    def register(build: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return build

    return register
