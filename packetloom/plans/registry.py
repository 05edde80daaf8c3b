"""Named operators: a decorator that records a query and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.plans.tables import Tables, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # event times without a zone are read as UTC
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def names() -> list[str]:
    return sorted(QUERIES)


def dispatch(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    if name not in QUERIES:
        raise KeyError(f"unknown query {name}; known: {', '.join(names())}")
    return QUERIES[name](spark, sf_dir)
