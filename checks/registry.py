"""Registered queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` and its DuckDB text."""
    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round double columns so that sums added in another order compare equal."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def epoch(col: str) -> Column:
    return F.unix_timestamp(F.col(col))
