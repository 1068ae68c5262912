"""A versioned table store.

A table is a list of parts, Parquet folders of rows or of keys: a key part
deletes the rows before it that hold one of its keys. So an insert adds a part
and a delete or update writes keys and changed rows, whatever the table's size;
after ``COMPACT`` parts the next transaction writes the table anew.

A manifest lists the parts of all tables. A transaction reads the manifest once,
at its begin, and commits by renaming a new one to the next number, which fails
if that number is taken: of two that began at one version, the second to commit
gets ``Conflict`` and has to begin again. Readers pin a manifest with
``snapshot`` and see one version throughout. Folders of a failed transaction are
removed, those of old versions by ``vacuum``. Works on any file system that Spark reads.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from nestql.errors import Conflict, EngineError

#: Parts of a table at which a transaction that changes it writes it anew.
COMPACT = 24


@dataclass
class Manifest:
    number: int = 0
    #: Table -> parts: {"path": folder} of rows, {"path": folder, "keys": columns} of keys.
    tables: dict[str, list[dict]] = field(default_factory=dict)
    #: Table -> its schema as JSON; that of a key part by its path.
    schemas: dict[str, str] = field(default_factory=dict)
    next_ids: dict[str, int] = field(default_factory=dict)


class Snapshot:
    """The tables of one version."""

    def __init__(self, store: VersionedStore, manifest: Manifest):
        self.store, self.manifest = store, manifest

    @property
    def next_ids(self) -> dict[str, int]:
        return self.manifest.next_ids

    def snapshot(self) -> Snapshot:
        return self

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.store.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*map(self.store.place, paths))

    def table(self, name: str) -> DataFrame:
        parts = self.manifest.tables.get(name)
        if parts is None:
            raise EngineError(f"Unknown table {name}")
        schema = self.manifest.schemas[name]
        out: DataFrame | None = None
        # neighbours of one kind are read at once
        for keys, group in groupby(parts, key=lambda p: tuple(p.get("keys", ()))):
            paths = [p["path"] for p in group]
            if not keys:
                rows = self._read(paths, schema)
                out = rows if out is None else out.unionByName(rows)
            elif out is not None:
                columns = [f"`{c}`" for c in out.columns]
                out = out.join(self._read(paths, self.manifest.schemas[paths[0]]), list(keys), "left_anti").select(*columns)
        return self.store.spark.createDataFrame([], StructType.fromJson(json.loads(schema))) if out is None else out


class Transaction(Snapshot):
    """Changes that are committed together; ``table`` goes on giving the version read at the begin."""

    def __init__(self, store: VersionedStore, manifest: Manifest):
        super().__init__(store, manifest)
        self.changes: dict[str, list[dict]] = {}
        self.schemas: dict[str, str] = {}
        self.replaced: set[str] = set()
        self.made: list[str] = []

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{name}/v{self.manifest.number + 1}-{uuid.uuid4().hex[:8]}"
        self.made.append(path)
        df.write.parquet(self.store.place(path))
        return path

    def append(self, name: str, rows: DataFrame) -> None:
        schema = self.manifest.schemas.get(name) or self.schemas.setdefault(name, rows.schema.json())
        types = StructType.fromJson(json.loads(schema))
        rows = rows.select(*[rows[f"`{f.name}`"].cast(f.dataType).alias(f.name) for f in types])
        self.changes.setdefault(name, []).append({"path": self._write(name, rows)})

    def delete(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of the table at the begin that hold one of ``keys``, by its columns, go. Gives the keys as they are written."""
        path = self._write(name, keys)
        self.schemas[path] = keys.schema.json()
        self.changes.setdefault(name, []).append({"path": path, "keys": keys.columns})
        return self.store.spark.read.schema(keys.schema).parquet(self.store.place(path))

    def update(self, name: str, rows: DataFrame, keys: Sequence[str], changed: Sequence[str]) -> None:
        """``rows``, with the changed values, take the place of those with their keys."""
        self.append(name, rows)
        self.delete(name, rows.select(*[f"`{c}`" for c in keys]).distinct())

    def replace(self, name: str, rows: DataFrame) -> None:
        """The table is ``rows``, whatever it was."""
        self.schemas[name] = rows.schema.json()
        self.replaced.add(name)
        self.changes[name] = [{"path": self._write(name, rows)}]

    def attach(self, name: str, path: str) -> None:
        """The table is what lies at ``path``, a Parquet folder or file elsewhere, which stays there."""
        self.schemas[name] = self.store.spark.read.parquet(path).schema.json()
        self.replaced.add(name)
        self.changes[name] = [{"path": self.store.qualified(path)}]

    def commit(self, next_ids: dict[str, int] | None = None) -> None:
        old = self.manifest
        tables, schemas = dict(old.tables), old.schemas | self.schemas
        try:
            for name, parts in self.changes.items():
                # keys come first: they are of rows that were there at the begin
                ordered = [p for p in parts if "keys" in p] + [p for p in parts if "keys" not in p]
                tables[name] = ordered if name in self.replaced else [*old.tables.get(name, []), *ordered]
                if len(tables[name]) > COMPACT:
                    whole = Snapshot(self.store, Manifest(old.number, tables, schemas)).table(name)
                    tables[name] = [{"path": self._write(name, whole)}]
            listed = {p["path"] for parts in tables.values() for p in parts}
            schemas = {k: v for k, v in schemas.items() if k in tables or k in listed}
            self.store.publish(Manifest(old.number + 1, tables, schemas, old.next_ids | (next_ids or {})))
        except BaseException:
            self.rollback()
            raise

    def rollback(self) -> None:
        """Remove what was written; the transaction is over."""
        for path in self.made:
            self.store.remove(path)
        self.made = []


class VersionedStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._Path(self.path).getFileSystem(conf)
        self._fs.mkdirs(self._Path(f"{self.path}/_manifests"))
        self._root = self._fs.makeQualified(self._Path(self.path)).toUri()
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root, conf)
        self._options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)

    def place(self, path: str) -> str:
        """A part's folder: within the store, but for attached ones."""
        return path if path.startswith("/") or ":/" in path else f"{self.path}/{path}"

    def qualified(self, path: str) -> str:
        p = self._Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()

    def remove(self, path: str) -> None:
        self._fs.delete(self._Path(self.place(path)), True)

    def _latest(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(f"{self.path}/_manifests"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, number: int | None = None) -> Manifest:
        """Of a version, or the last one."""
        n = self._latest() if number is None else number
        if not n:
            return Manifest()
        stream = self._fs.open(self._Path(f"{self.path}/_manifests/{n:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(n, **json.loads(text))

    def publish(self, m: Manifest) -> None:
        body = json.dumps({"tables": m.tables, "schemas": m.schemas, "next_ids": m.next_ids})
        draft = self._Path(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(body.encode()))
        out.close()
        target = self._Path(f"{self.path}/_manifests/{m.number:012d}.json")
        try:
            self._context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), self._options)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._latest() >= m.number:
                raise Conflict from e
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Remove the versions before the last ``keep`` and the folders that none of these lists; gives how many folders went.

        Snapshots of removed versions can't be read any more. Folders of transactions
        that may still commit are of newer versions and stay.
        """
        manifests = self._Path(f"{self.path}/_manifests")
        numbers = sorted(int(n[:-5]) for s in self._fs.listStatus(manifests) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("."))
        kept, old = numbers[-keep:], numbers[:-keep]
        if not old:
            return 0
        listed = {p["path"] for n in kept for parts in self.manifest(n).tables.values() for p in parts}
        gone = 0
        for table in self._fs.listStatus(self._Path(self.path)):
            name = table.getPath().getName()
            for part in self._fs.listStatus(table.getPath()) if table.isDirectory() and name != "_manifests" else []:
                path = f"{name}/{part.getPath().getName()}"
                made = re.match(r"v(\d+)-", part.getPath().getName())
                if path not in listed and made and int(made[1]) <= kept[0]:
                    self.remove(path)
                    gone += 1
        for n in old:
            self._fs.delete(self._Path(f"{self.path}/_manifests/{n:012d}.json"), False)
        return gone

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.manifest())

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    @property
    def next_ids(self) -> dict[str, int]:
        return self.manifest().next_ids

    def commit(self, changes: dict[str, DataFrame], next_ids: dict[str, int] | None = None) -> None:
        """Replace whole tables, in one transaction."""
        tx = self.begin()
        try:
            for name, df in changes.items():
                tx.replace(name, df)
        except BaseException:
            tx.rollback()
            raise
        tx.commit(next_ids)

