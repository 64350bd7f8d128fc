"""The registered queries of this subpackage and the SQL they must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        SPARK[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register
