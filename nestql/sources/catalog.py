"""Catalogs: tables by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from nestql.errors import Conflict
from nestql.sources.scratch import scratch_root


class ParquetCatalog:
    """A folder with ``<table>.parquet`` for each table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._schemas: dict[str, object] = {}

    def table(self, name: str) -> DataFrame:
        path = f"{self.path}/{name}.parquet"
        if name not in self._schemas:  # read footers once
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)


class FrameCatalog:
    """Tables held as DataFrames; writable, for tests and for views over other tables."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = dict(tables)
        self.next_ids: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def snapshot(self) -> FrameCatalog:
        out = FrameCatalog(self.tables)
        out.next_ids = dict(self.next_ids)
        return out

    def begin(self) -> FrameTransaction:
        return FrameTransaction(self)


class FrameTransaction(FrameCatalog):
    """Changes of a FrameCatalog that appear together."""

    def __init__(self, catalog: FrameCatalog):
        super().__init__(catalog.tables)
        self.catalog, self.next_ids, self.read = catalog, dict(catalog.next_ids), dict(catalog.tables)
        self.gone: dict[str, list[DataFrame]] = {}
        self.added: dict[str, list[DataFrame]] = {}

    def append(self, name: str, rows: DataFrame) -> None:
        self.added.setdefault(name, []).append(rows)

    def delete(self, name: str, keys: DataFrame) -> DataFrame:
        scratch_root(keys.sparkSession)
        keys = keys.checkpoint()
        self.gone.setdefault(name, []).append(keys)
        return keys

    def update(self, name: str, rows: DataFrame, keys: Sequence[str], changed: Sequence[str]) -> None:
        """``rows``, with the changed values, take the place of those with their keys."""
        self.append(name, rows)
        self.delete(name, rows.select(*[f"`{c}`" for c in keys]).distinct())

    def commit(self, next_ids: dict[str, int] | None = None) -> None:
        if any(self.catalog.tables.get(n) is not self.read.get(n) for n in {*self.gone, *self.added}):
            raise Conflict
        for name in {*self.gone, *self.added}:
            df = self.tables[name]
            columns = df.columns
            for keys in self.gone.get(name, []):
                df = df.join(keys, keys.columns, "left_anti").select(*[f"`{c}`" for c in columns])
            for rows in self.added.get(name, []):
                df = df.unionByName(rows)
            self.catalog.tables[name] = df
        self.catalog.next_ids |= next_ids or {}

    def rollback(self) -> None:
        self.gone, self.added = {}, {}


class DerivedCatalog:
    """Another catalog with some tables replaced by views of it."""

    def __init__(self, base, views: dict[str, Callable[[DataFrame], DataFrame]]):
        self.base, self.views = base, views

    def table(self, name: str) -> DataFrame:
        df = self.base.table(name)
        return self.views[name](df) if name in self.views else df

    def snapshot(self) -> DerivedCatalog:
        return DerivedCatalog(pinned(self.base), self.views)


def pinned(catalog):
    """A catalog as it is now, for one document; catalogs without versions are read as they are."""
    return catalog.snapshot() if hasattr(catalog, "snapshot") else catalog
