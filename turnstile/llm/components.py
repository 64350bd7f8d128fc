"""Distributed connected components: every node gets the least node it is linked with, directly or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.common import staged


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (of long ids); root is the least node of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges no longer change: each node's
    neighbours are linked to its least neighbour, so a hub is reduced by a minimum and never gathered. Each step is
    staged; an edge sum tells when the fixed point is reached.
    """
    links = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "component-edges")
    mark = _mark(links)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        # Large star: neighbours above a node go to its least neighbour or itself.
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "component-large")
        # Small star: a node's lower neighbours and the node itself go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        links = staged(small, "component-small")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple:
    """Number and order-free digest of the edges: two numbers, whatever their count."""
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]
