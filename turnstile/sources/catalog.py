"""Names such as 'invoice.Payment' resolved to DataFrames with snake_case columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def snake(name: str) -> str:
    """'InvoiceHeaderId' -> 'invoice_header_id'; names in snake case stay as they are."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name)
    return spaced.lower()


class Catalog:
    """Base tables by schema-qualified name, read from a folder, a metastore or given frames.

    Subclasses override `read`; `table` keeps only the columns a job names, so that Parquet reads
    nothing else, and fails early when one is missing.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        raise NotImplementedError

    def table(self, name: str, *columns: str) -> DataFrame:
        if name not in self._tables:
            raw = self.read(name)
            renamed = [snake(c) for c in raw.columns]
            self._tables[name] = raw if renamed == raw.columns else raw.toDF(*renamed)
        df = self._tables[name]
        if not columns:
            return df
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise KeyError(f"{name} lacks column(s) {', '.join(missing)}")
        return df.select(*columns)


class ParquetCatalog(Catalog):
    """<root>/<schema>_<Table> folders of Parquet, for example <root>/invoice_Payment."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark)
        self.root = root.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name.replace('.', '_')}")


class MetastoreCatalog(Catalog):
    """Tables registered in the session catalog under the same qualified names."""

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name)


class FrameCatalog(Catalog):
    """Given DataFrames; what a batch job returns can be layered over the tables it started from."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], base: Catalog | None = None):
        super().__init__(spark)
        self.frames = dict(frames)
        self.base = base

    def read(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self.base is None:
            raise KeyError(f"no table {name}")
        return self.base.table(name)


def load(catalog: Catalog, name: str, *columns: str) -> DataFrame:
    return catalog.table(name, *columns)
