"""Registry of demonstration queries: a Spark job and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnstile.session import tune

AS_OF = "2024-01-15 12:00:00"

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULE: dict[str, str] = {}


class Tables:
    """The given tables as attributes: t.orders, t.lineitem, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under a name; without SQL only its rows are checked."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in SPARK:
            raise ValueError(f"query {name} registered twice")
        SPARK[name] = run
        MODULE[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return register
