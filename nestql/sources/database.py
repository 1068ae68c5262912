"""Tables of databases: by JDBC, and SQLite files without a driver.

By JDBC, filters and column choices of queries are pushed down to the database. A
mutation's changes are made in one transaction of the database at its commit.
"""

from __future__ import annotations

import datetime
import decimal
import sqlite3
from collections.abc import Iterator, Sequence
from contextlib import closing
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DateType, StructType, TimestampNTZType

from nestql.errors import Conflict, EngineError
from nestql.functions.scalars import SPARK
from nestql.sources.scratch import scratch_path

#: Rows of a statement that are sent at once.
BATCH = 1000


def quoted(name: str, mark: str = '"') -> str:
    return ".".join(mark + part.replace(mark, mark * 2) + mark for part in name.split("."))


class DatabaseTransaction:
    """Changes of a database's tables, held until ``commit``; meanwhile ``table`` gives them as they are."""

    next_ids: dict[str, int] = {}

    def __init__(self, catalog):
        self.catalog = catalog
        self.gone: list[tuple[str, DataFrame]] = []
        self.added: list[tuple[str, DataFrame]] = []
        self.changed: list[tuple[str, DataFrame, int]] = []

    def table(self, name: str) -> DataFrame:
        return self.catalog.table(name)

    def append(self, name: str, rows: DataFrame) -> None:
        self.added.append((name, self._held(rows)))

    def delete(self, name: str, keys: DataFrame) -> DataFrame:
        keys = self._held(keys)
        self.gone.append((name, keys))
        return keys

    def update(self, name: str, rows: DataFrame, keys: Sequence[str], changed: Sequence[str]) -> None:
        columns = [f"`{c}`" for c in (*changed, *keys)]
        self.changed.append((name, self._held(rows.select(*columns).distinct()), len(changed)))

    def _held(self, df: DataFrame) -> DataFrame:
        """As a table of its own: what it was computed from changes at the commit."""
        path = scratch_path(df.sparkSession, "change")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def statements(self, mark: str) -> Iterator[tuple[str, DataFrame]]:
        """SQL with a parameter for each column of the rows it is for: deletes first, those of deep levels before their parents."""
        for name, keys in reversed(self.gone):
            yield f"DELETE FROM {quoted(name, mark)} WHERE {' AND '.join(f'{quoted(c, mark)} = ?' for c in keys.columns)}", keys
        for name, rows, n in self.changed:
            parts = [f"{quoted(c, mark)} = ?" for c in rows.columns]
            yield f"UPDATE {quoted(name, mark)} SET {', '.join(parts[:n])} WHERE {' AND '.join(parts[n:])}", rows
        for name, rows in self.added:
            yield f"INSERT INTO {quoted(name, mark)} ({', '.join(quoted(c, mark) for c in rows.columns)}) VALUES ({', '.join('?' * len(rows.columns))})", rows

    def rollback(self) -> None:
        self.gone, self.added, self.changed = [], [], []


def batches(rows: DataFrame) -> Iterator[list[tuple]]:
    """Rows of a small frame in lists; nothing beyond one list and one partition is held."""
    out: list[tuple] = []
    for r in rows.toLocalIterator():
        out.append(tuple(r))
        if len(out) == BATCH:
            yield out
            out = []
    if out:
        yield out


# -- JDBC ------------------------------------------------------------------------


#: Names of java.sql.Types by Spark's type names, for nulls.
JDBC_TYPES = {"short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "REAL", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "binary": "VARBINARY"}


class JdbcCatalog:
    """Tables of a database by its JDBC driver.

    ``partitions`` names for a table the numeric column, bounds and number of
    parallel reads: (column, lower, upper, n).
    """

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None, partitions: dict[str, tuple[str, int, int, int]] | None = None):
        self.spark, self.url, self.properties, self.partitions = spark, url, properties or {}, partitions or {}
        dialect = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
        self.mark = dialect.quoteIdentifier("x")[0]

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=quoted(name, self.mark), **self.properties)
        if name in self.partitions:
            column, lower, upper, n = self.partitions[name]
            reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=n)
        return reader.load()

    def begin(self) -> JdbcTransaction:
        return JdbcTransaction(self)


class JdbcTransaction(DatabaseTransaction):
    def commit(self, next_ids: dict[str, int] | None = None) -> None:
        jvm = self.catalog.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.catalog.properties.items():
            properties.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.catalog.url, properties)
        try:
            connection.setAutoCommit(False)
            for sql, rows in self.statements(self.catalog.mark):
                statement = connection.prepareStatement(sql)
                types = [JDBC_TYPES.get(f.dataType.typeName(), "VARCHAR") for f in rows.schema]
                for batch in batches(rows):
                    for row in batch:
                        for i, v in enumerate(row, 1):
                            if v is None:
                                statement.setNull(i, getattr(jvm.java.sql.Types, types[i - 1]))
                            else:
                                statement.setObject(i, self._java(v))
                        statement.addBatch()
                    statement.executeBatch()
                statement.close()
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _java(self, v: Any) -> Any:
        sql = self.catalog.spark.sparkContext._jvm.java.sql
        if isinstance(v, datetime.datetime):
            return sql.Timestamp.valueOf(v.strftime("%Y-%m-%d %H:%M:%S.%f"))
        if isinstance(v, datetime.date):
            return sql.Date.valueOf(v.isoformat())
        if isinstance(v, decimal.Decimal):
            return self.catalog.spark.sparkContext._jvm.java.math.BigDecimal(str(v))
        return v


# -- SQLite ----------------------------------------------------------------------


class SqliteSource(DataSource):
    """``spark.read.format("nestql_sqlite")``: options path, table, schema (DDL) and partitions."""

    @classmethod
    def name(cls) -> str:
        return "nestql_sqlite"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


class RowRange(InputPartition):
    def __init__(self, first: int | None, last: int | None):
        self.first, self.last = first, last


class SqliteReader(DataSourceReader):
    """Ranges of row ids.

    Spark applies the filters: those pushed to a reader of this kind would also
    narrow other scans of the same DataFrame.
    """

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.name, self.n = options["path"], options["table"], int(options.get("partitions", "4"))
        self.schema = schema

    def partitions(self) -> list[RowRange]:
        with closing(sqlite3.connect(self.path)) as con:
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.name)}").fetchone()
            except sqlite3.OperationalError:  # a table without row ids is read at once
                return [RowRange(None, None)]
        if low is None:
            return [RowRange(0, -1)]
        step = -(-(high - low + 1) // self.n)
        return [RowRange(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: RowRange) -> Iterator[tuple]:
        kinds = [f.dataType for f in self.schema]
        columns = ", ".join(quoted(f.name) for f in self.schema) or "1"
        with closing(sqlite3.connect(self.path)) as con:
            within = ("", ()) if part.first is None else (" WHERE rowid BETWEEN ? AND ?", (part.first, part.last))
            for row in con.execute(f"SELECT {columns} FROM {quoted(self.name)}{within[0]}", within[1]):
                out = []
                for v, kind in zip(row, kinds, strict=True):
                    if v is not None and isinstance(kind, BooleanType):
                        v = bool(v)
                    elif v is not None and isinstance(kind, TimestampNTZType):
                        v = datetime.datetime.fromisoformat(v)
                    elif v is not None and isinstance(kind, DateType):
                        v = datetime.date.fromisoformat(v)
                    out.append(v)
                yield tuple(out)


class SqliteCatalog:
    """Tables of an SQLite file, which executors read in parallel: it must lie where they all see it."""

    def __init__(self, spark: SparkSession, path: str, partitions: int = 4):
        from nestql.sources.infer import read_sqlite

        self.spark, self.path, self.partitions = spark, path, partitions
        tables, _ = read_sqlite(path)
        self.columns = {t.name: ", ".join(f"`{c.name}` {SPARK[c.type].simpleString() if c.type in SPARK else 'binary'}" for c in t.columns) for t in tables.values()}
        spark.dataSource.register(SqliteSource)

    def table(self, name: str) -> DataFrame:
        if name not in self.columns:
            raise EngineError(f"Unknown table {name}")
        reader = self.spark.read.format("nestql_sqlite")
        return reader.options(path=self.path, table=name, columns=self.columns[name], partitions=self.partitions).load()

    def begin(self) -> SqliteTransaction:
        return SqliteTransaction(self)


class SqliteTransaction(DatabaseTransaction):
    def __init__(self, catalog: SqliteCatalog):
        super().__init__(catalog)
        self.connection = sqlite3.connect(catalog.path, isolation_level=None)
        self.connection.execute("PRAGMA foreign_keys = ON")
        self.version = self._version()

    @staticmethod
    def _stored(v: Any) -> Any:
        if isinstance(v, datetime.datetime):
            return v.isoformat(" ")
        if isinstance(v, datetime.date):
            return v.isoformat()
        return bytes(v) if isinstance(v, bytearray) else v

    def _version(self) -> int:
        """A number that changes when another connection has committed."""
        return self.connection.execute("PRAGMA data_version").fetchone()[0]

    def commit(self, next_ids: dict[str, int] | None = None) -> None:
        con = self.connection
        try:
            con.execute("BEGIN IMMEDIATE")
            if self._version() != self.version:
                raise Conflict
            for sql, rows in self.statements('"'):
                for batch in batches(rows):
                    con.executemany(sql, [tuple(map(self._stored, row)) for row in batch])
            con.execute("COMMIT")
        except sqlite3.Error as e:
            self.rollback()
            raise EngineError(str(e)) from e
        except BaseException:
            self.rollback()
            raise
        self.connection = None
        con.close()

    def rollback(self) -> None:
        super().rollback()
        con, self.connection = self.connection, None
        if con is not None:
            if con.in_transaction:
                con.execute("ROLLBACK")
            con.close()
