"""Row changes as set operators: (target, changes) -> new version of the target.

Plain Parquet has no MERGE, so every operator returns the new table for the caller to write as the
next version; see sources.sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnstile import codes
from turnstile.functions import scalars as X
from turnstile.operators.windows import keep_first


def _latest(changes: DataFrame, keys: list[str], sequence: str | None) -> DataFrame:
    if sequence is None:
        return changes
    return keep_first(changes, keys, [F.col(sequence).desc()]).drop(sequence)


def upsert(
    target: DataFrame,
    changes: DataFrame,
    keys: list[str],
    keep_when_null: list[str] = (),
    overwrite: list[str] = (),
    insert_defaults: dict[str, Column] | None = None,
    stamp: dict[str, Column] | None = None,
    sequence: str | None = None,
    insert: bool = True,
) -> DataFrame:
    """Update matched rows and insert the rest.

    `keep_when_null` columns take the change unless it is null; `overwrite` columns take it as it is.
    `stamp` columns are set on every touched row. Of several changes to one key the last in
    `sequence` wins.
    """
    mapped = [*keep_when_null, *overwrite]
    stamp = stamp or {}
    defaults = {**(insert_defaults or {}), **stamp}
    src = _latest(changes, keys, sequence).select(
        *keys, *[F.col(c).alias(f"__s_{c}") for c in mapped], F.lit(True).alias("__hit")
    )
    old = target.withColumn("__old", F.lit(True))
    joined = old.join(src, keys, "full" if insert else "left")
    hit, known = F.col("__hit").isNotNull(), F.col("__old").isNotNull()
    columns = []
    for c in target.columns:
        dtype = target.schema[c].dataType
        if c in keys:
            value = F.col(c)
        elif c in keep_when_null:
            value = F.coalesce(F.col(f"__s_{c}").cast(dtype), F.col(c))
        elif c in overwrite:
            value = F.when(hit, F.col(f"__s_{c}").cast(dtype)).otherwise(F.col(c))
        elif c in stamp:
            value = F.when(hit, stamp[c].cast(dtype)).otherwise(F.col(c))
        else:
            value = F.col(c)
        if c in defaults and c not in stamp:
            value = F.when(known, value).otherwise(defaults[c].cast(dtype))
        columns.append(value.alias(c))
    return joined.select(*columns)


def insert_if_absent(target: DataFrame, changes: DataFrame, keys: list[str], present: Column | None = None) -> DataFrame:
    """Target plus the changes whose key has no (live) row yet."""
    existing = target if present is None else target.filter(present)
    new = changes.join(existing.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(new, allowMissingColumns=True).select(*target.columns)


def mark(target: DataFrame, ids: DataFrame, key, changes: dict[str, Column], when: Column | None = None) -> DataFrame:
    """Set columns on the rows whose key is in `ids` (and that pass `when`)."""
    keys = [key] if isinstance(key, str) else list(key)
    hits = ids.select(*keys).distinct().withColumn("__hit", F.lit(True))
    joined = target.join(hits, keys, "left")
    chosen = F.col("__hit").isNotNull() & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    return joined.select(
        *[
            (F.when(chosen, changes[c].cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in changes else F.col(c))
            for c in target.columns
        ]
    )


def void(target: DataFrame, ids: DataFrame, key, status_col: str, as_of: Column, user: str, when: Column | None = None) -> DataFrame:
    """Set the status of the named rows to voided and stamp them."""
    changes = {status_col: F.lit(codes.STATUS_VOIDED)}
    if "modified_by" in target.columns:
        changes |= {"modified_by": F.lit(user), "modified_date": as_of}
    return mark(target, ids, key, changes, when)


def soft_delete(target: DataFrame, ids: DataFrame, key, as_of: Column, user: str, when: Column | None = None) -> DataFrame:
    changes = {"deleted": as_of}
    if "modified_by" in target.columns:
        changes |= {"modified_by": F.lit(user), "modified_date": as_of}
    return mark(target, ids, key, changes, when)


def replace_children(target: DataFrame, new: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Drop the children of the named parents and put the new ones in their place."""
    kept = target.join(parents.select(parent_key).distinct(), parent_key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).select(*target.columns)


def raise_only(df: DataFrame, col: str, computed: str) -> DataFrame:
    """Lift a stored total to the computed one; never lower it, never fill an unknown one."""
    return df.withColumn(col, F.when(F.col(col) < F.col(computed), F.col(computed)).otherwise(F.col(col)))


#: Buckets that new ids are numbered in; another number gives other ids.
ID_BUCKETS = 16_384


def assign_ids(df: DataFrame, order: list[str], as_: str, start=0, bucket: Column | None = None, buckets: int = ID_BUCKETS) -> DataFrame:
    """Dense ids start+1, start+2, ... over a natural key, without one global sort.

    Rows are filed in buckets, numbered inside each, and shifted by the count of all earlier buckets.
    The default bucket is a hash of the natural key into a fixed number of buckets, so that the ids follow from
    the rows alone and not from the cluster's settings; a bucket
    expression that grows with the first order column makes the ids follow the order. `start` is a
    number or a one-row DataFrame.
    """
    filed = bucket if bucket is not None else F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.withColumn("__bucket", filed.cast("long"))
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("__size"))
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket: this is the only place that sees all of them together.
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    numbered = rows.withColumn("__n", inside).join(offsets, "__bucket")
    base = start.scalar() if isinstance(start, DataFrame) else F.lit(start)
    return numbered.select(*df.columns, (base + F.col("__offset") + F.col("__n")).cast("long").alias(as_))


def max_id(df: DataFrame, col: str = "id") -> DataFrame:
    return df.agg(F.coalesce(F.max(col), F.lit(0)).alias("max_id"))


def with_new_ids(new: DataFrame, target: DataFrame, natural: list[str], col: str = "id") -> DataFrame:
    """Ids for rows about to be inserted: the next numbers, or derived ones where the target's are text."""
    if target.schema[col].dataType.simpleString() == "string":
        return new.withColumn(col, X.derived_uuid(*natural))
    return assign_ids(new.drop(col), natural, col, max_id(target, col))


def relink(rows: DataFrame, row_id: str, link_col: str, links: DataFrame) -> DataFrame:
    """Point rows at the parent named for them in `links` (row_id, parent); others keep theirs."""
    found = links.select(row_id, F.col("parent").alias("__parent"), F.lit(True).alias("__hit"))
    return rows.join(found, row_id, "left").select(
        *[
            F.when(F.col("__hit"), F.col("__parent")).otherwise(F.col(c)).alias(c) if c == link_col else F.col(c)
            for c in rows.columns
        ]
    )


def fan_out(df: DataFrame, keep: list[str], variants: list[dict[str, Column]]) -> DataFrame:
    """One row per variant: an entity's typed children from a single pass over it."""
    names = list(variants[0])
    options = F.array(*[F.struct(*[v[n].alias(n) for n in names]) for v in variants])
    return df.select(*keep, F.explode(options).alias("__v")).select(*keep, *[F.col(f"__v.{n}").alias(n) for n in names])
