"""Unions of typed branches and the two-way difference used to prove rewrites equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StructType


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project to a target schema: columns cast, missing ones null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def union_branches(branches: list[DataFrame], schema: StructType) -> DataFrame:
    return reduce(DataFrame.unionByName, [conform(b, schema) for b in branches])


#: Buckets of row digests: two tables of so many rows at most are compared before any row is.
DIGEST_BUCKETS = 4096


def _row_hash(df: DataFrame, seed: int = 1) -> Column:
    """64 bits of a row. A null leaves a hash as it was, so its place goes in as well; nested values are hashed as text, which shows their nulls."""
    nested = lambda f: F.to_json(F.struct(F.col(f.name)), {"ignoreNullFields": "false"})
    cells = [F.col(f.name) if isinstance(f.dataType, AtomicType) else nested(f) for f in df.schema.fields]
    return F.xxhash64(F.lit(seed), *[x for c in cells for x in (c, c.isNull())])


def rowset_digests(df: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """bucket, rows, total, mix: an order-free digest of the rows of each hash bucket.

    Equal row sets have equal digests. Different ones differ but for a chance of about 2 ** -128 a bucket.
    """
    first, second = _row_hash(df), _row_hash(df, 2)
    return df.select(F.pmod(first, F.lit(buckets)).alias("bucket"), first.alias("first"), second.cast("decimal(20,0)").alias("second")).groupBy("bucket").agg(
        F.count("*").alias("rows"), F.sum("second").alias("total"), F.bit_xor("first").alias("mix")
    )


def differing_buckets(a: DataFrame, b: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Buckets whose rows differ."""
    x, y = rowset_digests(a, buckets).alias("x"), rowset_digests(b, buckets).alias("y")
    same = reduce(lambda p, q: p & q, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("rows", "total", "mix")])
    return x.join(y, "bucket", "full").filter(~same).select("bucket")


def rowset_diff(a: DataFrame, b: DataFrame, buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Rows (with multiplicity) that only one side has, tagged 'missing' (in a) or 'extra' (in b).

    Only rows of buckets whose digests differ are shuffled and compared; of equal sets nothing but digests is.
    """
    columns = a.columns
    b = b.select(*columns)
    # One row for each differing bucket: no more than `buckets`, whatever the data.
    suspect = F.broadcast(differing_buckets(a, b, buckets))
    name = "__bucket"
    key = lambda df: F.pmod(_row_hash(df), F.lit(buckets)).alias(name)
    part = lambda df, sign: df.select("*", key(df), F.lit(sign).alias("__n")).join(suspect.withColumnRenamed("bucket", name), name, "left_semi").drop(name)
    net = part(a, 1).unionByName(part(b, -1)).groupBy(*columns).agg(F.sum("__n").alias("__n")).filter(F.col("__n") != 0)
    return net.select(
        *columns,
        F.when(F.col("__n") > 0, F.lit("missing")).otherwise(F.lit("extra")).alias("side"),
        F.abs("__n").alias("copies"),
    )
