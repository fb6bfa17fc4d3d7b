"""Registered queries: each Spark callable beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlens.functions.expressions import rounded
from eventlens.session import ship_package
from registry.frames import Frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, keep_types: bool = False):
    """Register ``fn(frames) -> DataFrame`` under ``name``, with its SQL if it has one."""

    def wrap(fn: Callable[[Frames], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            df = fn(Frames(spark, folder))
            return df if keep_types else rounded(df)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load() -> None:
    from registry import (  # noqa: F401
        analytics, silver_gold, serving, bronze, learning, enrichment, jobs,
    )
