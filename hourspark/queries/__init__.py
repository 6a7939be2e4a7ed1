"""Registered queries: each runs a library operator over the given tables.

``QUERIES`` maps a name to ``fn(spark, sf_dir) -> DataFrame`` and ``ORACLES`` to the same result in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):  # type: ignore[no-untyped-def]
    """Register a function of ``Tables`` under its own name, with its SQL if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):  # type: ignore[no-untyped-def]
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def load() -> None:
    """Import every module that registers queries."""
    from hourspark.queries import (  # noqa: F401
        app, canonical, evaluation, expressions, graph, quality, sources, spatial, streams, time, timeseries, tracks,
    )
