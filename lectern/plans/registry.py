"""Registration of queries: a function over views and tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.views import duck, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Registers the function, which gets one DataFrame for each of `tables`, under `name`."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(*[view(spark, sf_dir, t) for t in tables])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = duck(sql)
        return function

    return add
