"""Registry of runnable queries, each next to the SQL text that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skytable import fixtures
from skytable.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The tables and fixture views below one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in fixtures.VIEWS:
            return fixtures.view(self.spark, self.sf_dir, f"fx_{name}")
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register a query over ``Inputs``; ``sql`` is the DuckDB text with the same result."""

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Inputs(use_utc(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = fixtures.with_views(sql)
        return build

    return register
