"""Nested documents: objects without empty members, sorted child arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def nested(mapping: dict) -> Column:
    """Object from {member: column | dict}; an object whose leaves are all null is null itself."""
    return _object(mapping)[0]


def _object(mapping: dict) -> tuple[Column, Column]:
    members, present = [], []
    for name, value in mapping.items():
        if isinstance(value, dict):
            column, filled = _object(value)
        else:
            column = value if isinstance(value, Column) else F.col(value)
            filled = column.isNotNull()
        members.append(column.alias(name))
        present.append(filled)
    any_present = reduce(lambda a, b: a | b, present)
    return F.when(any_present, F.struct(*members)), any_present


def nest_paths(df: DataFrame, paths: dict[str, Column | str], keep: list[str] = ()) -> DataFrame:
    """Columns named by dotted paths as nested objects, in order of first mention."""
    tree: dict = {}
    for path, value in paths.items():
        *parents, leaf = path.split(".")
        node = tree
        for parent in parents:
            node = node.setdefault(parent, {})
        node[leaf] = value
    columns = []
    for name, value in tree.items():
        column = nested(value) if isinstance(value, dict) else (value if isinstance(value, Column) else F.col(value))
        columns.append(column.alias(name))
    return df.select(*keep, *columns)


def child_arrays(child: DataFrame, key, fields: dict | list, order: list[str | Column], as_: str) -> DataFrame:
    """(key, array of child objects), one row per parent, each array sorted by `order`.

    The result has one form whatever the number of children: a parent's document names all of them, so the
    parents must be such as bound their children (an invoice's lines, a payment's allocations).
    """
    keys = [key] if isinstance(key, str) else list(key)
    mapping = fields if isinstance(fields, dict) else {f: f for f in fields}
    sort_key = F.struct(*[(o if isinstance(o, Column) else F.col(o)).alias(f"o{i}") for i, o in enumerate(order)])
    rows = child.select(*keys, sort_key.alias("__o"), nested(mapping).alias("__e"))
    packed = F.sort_array(F.collect_list(F.struct("__o", "__e")))
    return rows.groupBy(*keys).agg(F.transform(packed, lambda x: x["__e"]).alias(as_))


def attach_children(parent: DataFrame, key, arrays: list[DataFrame]) -> DataFrame:
    """Parent rows with their child arrays; a parent without children of a kind has null there."""
    keys = [key] if isinstance(key, str) else list(key)
    return reduce(lambda df, array: df.join(array, keys, "left"), arrays, parent)


def collect_children(parent: DataFrame, child: DataFrame, key, fields, order, as_: str) -> DataFrame:
    return attach_children(parent, key, [child_arrays(child, key, fields, order, as_)])


def as_json(df: DataFrame, keys: list[str], as_: str = "document") -> DataFrame:
    """One JSON text per row; null members are left out."""
    body = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*body)).alias(as_))
