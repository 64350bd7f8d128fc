"""All registered queries."""

from __future__ import annotations

import importlib

from turnstile.queries import base

MODULES = [
    "rows_and_filters", "joining", "aggregating", "scalar_rules", "nesting", "changing", "streams",
    "reports", "availability", "people", "records", "batches",
]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"turnstile.queries.{module}")


def queries():
    _load()
    return dict(base.SPARK)


def oracle_sql():
    _load()
    return dict(base.ORACLE)
