"""Per-group choices that hold up when one group has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, partition, order: list[Column]) -> DataFrame:
    """First row of every group in a total order.

    Spark plans a rank filter as a group limit on both sides of the shuffle, so a task hands on one
    row per group at most and a hot group never gathers in one place.
    """
    keys = [partition] if isinstance(partition, str) else list(partition)
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def with_group(df: DataFrame, partition, aggs: dict[str, Column]) -> DataFrame:
    """Group aggregates next to every row, by pre-aggregation and a null-safe join back.

    A window would gather each group in one task; here the partial sums shrink it first, and the
    join back is one that AQE can split.
    """
    keys = [partition] if isinstance(partition, str) else list(partition)
    totals = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
    right = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *aggs)
    condition = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        condition = same if condition is None else condition & same
    return df.join(right, condition).drop(*[f"__k_{k}" for k in keys])


def keep_group_min(df: DataFrame, partition, value: str, when: Column | None = None) -> DataFrame:
    """Rows equal to their group's minimum; rows outside `when` are neither tested nor counted."""
    keys = [partition] if isinstance(partition, str) else list(partition)
    tested = F.lit(True) if when is None else F.coalesce(when, F.lit(False))
    marked = with_group(df, keys, {"__min": F.min(F.when(tested, F.col(value)))})
    return marked.filter(~tested | (F.col(value) == F.col("__min"))).drop("__min")


def with_any(df: DataFrame, partition, flag: Column, name: str) -> DataFrame:
    """Whether any row of the group carries the flag."""
    return with_group(df, partition, {name: F.coalesce(F.bool_or(flag), F.lit(False))})
