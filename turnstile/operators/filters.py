"""Row filters that are built from optional arguments or need a pushdown-friendly form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.functions import scalars as X


def optional_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Filter on a value only when one is given; no predicate reaches the plan otherwise."""
    return df if value is None else df.filter(F.col(col) == F.lit(value))


def toggled(df: DataFrame, enabled: bool, predicate: Column) -> DataFrame:
    return df.filter(predicate) if enabled else df


def between_dates(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Inclusive dates as a half-open range on the raw column, so that Parquet can skip row groups."""
    low = X.day(start).cast("timestamp_ntz")
    high = F.date_add(X.day(end), 1).cast("timestamp_ntz")
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high))


def between_local_dates(df: DataFrame, ts: str, zone, start, end) -> DataFrame:
    """Inclusive dates in each row's own zone.

    The conversion itself cannot be pushed down, so a bracket of 14 hours on the raw column goes in
    front of it: no zone is further from UTC.
    """
    low = X.day(start).cast("timestamp_ntz") - F.expr("INTERVAL 14 HOURS")
    high = F.date_add(X.day(end), 1).cast("timestamp_ntz") + F.expr("INTERVAL 14 HOURS")
    return df.filter((F.col(ts) >= low) & (F.col(ts) < high)).filter(
        X.local_date(ts, zone).between(X.day(start), X.day(end))
    )


def active(df: DataFrame, *stamps: str) -> DataFrame:
    """Rows none of whose soft-delete stamps is set."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(s).isNull() for s in stamps]))


def not_mine(df: DataFrame, owner: str, me, keep_unowned: bool) -> DataFrame:
    """Rows of other owners; rows without an owner stay only on request."""
    other = F.col(owner) != me
    return df.filter(F.col(owner).isNull() | other if keep_unowned else other)


def any_nonzero(df: DataFrame, *cols: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in cols]))


def split_rejects(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with the code of the first rule they break)."""
    reason = F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules])
    tagged = df.withColumn("reject_reason", reason)
    return (
        tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        tagged.filter(F.col("reject_reason").isNotNull()),
    )
