"""Inference of entities from existing tables, and their declarations as text.

``python -m nestql.sources.infer <source> [schema]`` prints them. A source is a
folder of Parquet tables, the path of an SQLite file, or a postgres:// or
mysql:// URL, which is read by JDBC where a driver is at hand.

Parquet has neither keys nor links. They are taken from a configuration, or
guessed: a table's key is its first column if its values are unique and named
like a key, else its shortest unique prefix of columns; a column links to a
table if its name ends like that table's key.
"""

from __future__ import annotations

import re
import sqlite3
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from nestql.functions.naming import camel, entity_name, safe
from nestql.functions.scalars import scalar_of
from nestql.model import Column, Entity, HasMany, HasOne


class InferenceError(Exception):
    pass


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    type: str
    nullable: bool = False
    has_default: bool = False


@dataclass(frozen=True)
class TableInfo:
    name: str
    columns: tuple[ColumnInfo, ...]
    primary_key: tuple[str, ...]

    def __post_init__(self):
        if not self.primary_key:
            raise InferenceError(f"Table {self.name} has no primary key")


@dataclass(frozen=True, order=True)
class ForeignKey:
    child: str
    parent: str
    column: str
    key: str
    composite: bool = False

    @property
    def tables(self) -> frozenset[str]:
        return frozenset((self.child, self.parent))


def backend(source: str) -> str:
    if re.match(r"postgres(ql)?://", source):
        return "postgres"
    if re.match(r"(mysql|mariadb)://", source):
        return "mysql"
    return "sqlite" if re.search(r"\.(db|sqlite3?)$|^sqlite:", source) else "parquet"


def usable_links(links: Iterable[ForeignKey], tables: dict[str, TableInfo]) -> list[ForeignKey]:
    """Links that entities can show: to another known table, by its one key column, the only one of the two tables."""
    links = sorted(links)
    return [
        k
        for k in links
        if k.child != k.parent
        and k.parent in tables
        and k.child in tables
        and not k.composite
        and tables[k.parent].primary_key == (k.key,)
        and sum(x.tables == k.tables for x in links) == 1
    ]


# -- types of databases ----------------------------------------------------------


#: SQLite's rule of affinity. A declared type that holds one of a row's words has its affinity; earlier rows go first.
AFFINITIES = {"INTEGER": ("int",), "TEXT": ("char", "clob", "text"), "BLOB": ("blob",), "REAL": ("real", "floa", "doub")}
#: Words that tell an integer's width, and names of types that SQLite keeps as numbers or text of its choice.
WIDTHS = {"tiny": "Boolean", "small": "SmallInt", "int2": "SmallInt", "big": "BigInt", "int8": "BigInt"}
NAMED = {"boolean": "Boolean", "datetime": "NaiveDateTime", "timestamp": "NaiveDateTime", "date": "Date", "time": "Time"}


def affinity(declared: str) -> str:
    """The affinity that SQLite gives a declared type."""
    if not declared.strip():
        return "BLOB"
    return next((a for a, words in AFFINITIES.items() if any(w in declared.lower() for w in words)), "NUMERIC")


def sqlite_type(declared: str) -> str:
    """The scalar of a declared type: its affinity's, by width where that is told."""
    kind, text = affinity(declared), declared.lower()
    if kind == "INTEGER":
        return next((scalar for word, scalar in WIDTHS.items() if word in text), "Int")
    if kind == "REAL":
        return "Double" if "doub" in text else "Float"
    if kind == "TEXT":
        return "String"
    if kind == "BLOB" or "binary" in text:
        return "Binary"
    if "num" in text or "dec" in text:
        return "Double"
    name = text.split("(")[0].strip()
    if name not in NAMED:
        raise InferenceError(f"Unsupported type: {declared}")
    return NAMED[name]


#: Types of PostgreSQL by their short names.
POSTGRES_TYPES = {"int2": "SmallInt", "int4": "Int", "int8": "BigInt", "bool": "Boolean", "float4": "Float", "float8": "Double", "text": "String", "varchar": "String", "bpchar": "String", "timestamp": "NaiveDateTime", "timestamptz": "DateTime", "date": "Date", "uuid": "Uuid", "numeric": "Numeric", "bytea": "Binary"}


def postgres_type(udt: str) -> str:
    """A leading underscore marks an array; other types keep their name, capitalised."""
    if udt.startswith("_"):
        return f"[{postgres_type(udt[1:])}]"
    return POSTGRES_TYPES.get(udt, udt[:1].upper() + udt[1:])


def mysql_type(declared: str) -> tuple[str, bool]:
    """The scalar and whether it is unsigned."""
    t = declared.lower()
    unsigned = "unsigned" in t
    t = t.replace("unsigned", "").strip()
    if t == "tinyint(1)":
        return "Boolean", unsigned
    base = re.split(r"[ (]", t)[0]
    known = {"tinyint": "SmallInt", "smallint": "SmallInt", "mediumint": "Int", "int": "Int", "integer": "Int", "bigint": "BigInt", "float": "Float", "double": "Double", "decimal": "Numeric", "bit": "Binary", "datetime": "NaiveDateTime", "timestamp": "NaiveDateTime", "date": "Date"}
    if base in known:
        return known[base], unsigned
    if "char" in base or "text" in base or base in ("enum", "set"):
        return "String", unsigned
    if "blob" in base or "binary" in base:
        return "Binary", unsigned
    return base[:1].upper() + base[1:], unsigned


# -- sources ---------------------------------------------------------------------


def read_sqlite(path: str) -> tuple[dict[str, TableInfo], list[ForeignKey]]:
    con = sqlite3.connect(path.removeprefix("sqlite:").removeprefix("//"))
    try:
        names = [r[0] for r in con.execute(r"SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE '\_\_%' ESCAPE '\' AND name NOT LIKE 'sqlite%' ORDER BY name")]
        tables, links = {}, []
        for n in names:
            rows = con.execute(f'PRAGMA table_info("{n}")').fetchall()
            key = tuple(r[1] for r in sorted((r for r in rows if r[5]), key=lambda r: r[5]))
            tables[n] = TableInfo(n, tuple(ColumnInfo(r[1], sqlite_type(r[2]), not r[3] and not r[5], r[4] is not None) for r in rows), key)
            found = con.execute(f'PRAGMA foreign_key_list("{n}")').fetchall()
            for r in found:
                links.append(ForeignKey(n, r[2], r[3], r[4] or "", sum(x[0] == r[0] for x in found) > 1))
        links = [k if k.key else ForeignKey(k.child, k.parent, k.column, tables[k.parent].primary_key[0] if k.parent in tables else "", k.composite) for k in links]
        return tables, sorted(links)
    finally:
        con.close()


def read_parquet(spark: SparkSession, path: str, names: list[str] | None = None, keys: dict[str, tuple[str, ...]] | None = None, links: list[ForeignKey] | None = None) -> tuple[dict[str, TableInfo], list[ForeignKey]]:
    if names is None:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        names = sorted(s.getPath().getName()[:-8] for s in found if s.getPath().getName().endswith(".parquet") and not s.getPath().getName().startswith("__"))
    tables = {}
    for n in names:
        df = spark.read.parquet(f"{path}/{n}.parquet")
        key = (keys or {}).get(n) or _guess_key(df)
        columns = tuple(ColumnInfo(f.name, scalar_of(f.dataType), f.name not in key) for f in df.schema)
        try:
            tables[n] = TableInfo(n, columns, key)
        except InferenceError:
            if names is not None and keys is not None:
                raise
    return tables, sorted(links if links is not None else _guess_links(tables))


def _guess_key(df) -> tuple[str, ...]:
    plain = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "string", "date")]
    for width in (1, 2, 3):
        prefix = plain[:width]
        if len(prefix) < width:
            break
        r = df.agg(F.count("*").alias("n"), F.count_distinct(*prefix).alias("d")).first()
        if r.n == r.d and r.n:
            return tuple(prefix)
    return ()


def _guess_links(tables: dict[str, TableInfo]) -> list[ForeignKey]:
    def stem(name: str) -> str:
        return re.sub(r"^[a-z]{1,2}_", "", name)

    out = []
    for t in tables.values():
        for c in t.columns:
            for p in tables.values():
                key = p.primary_key[0]
                kind = next(x.type for x in p.columns if x.name == key)
                if p.name != t.name and len(p.primary_key) == 1 and c.name != t.primary_key[0] and c.type == kind and stem(c.name) == stem(key) and stem(key) not in ("id", "name"):
                    out.append(ForeignKey(t.name, p.name, c.name, key))
    return out


Rows = Callable[[str], list]


def jdbc_rows(spark: SparkSession, url: str) -> Rows:
    """A function from a query to its rows, by JDBC."""
    jdbc = "jdbc:" + re.sub(r"^postgres(ql)?:", "postgresql:", url)
    return lambda sql: spark.read.format("jdbc").options(url=jdbc, query=sql).load().collect()


def assembled(names: list[str], columns: list[tuple[str, ColumnInfo]], keys: list[tuple[str, str]], links: list[tuple[str, str, str, str, str]]) -> tuple[dict[str, TableInfo], list[ForeignKey]]:
    """links: (child, parent, column, key, name of the constraint)."""
    tables = {n: TableInfo(n, tuple(c for t, c in columns if t == n), tuple(c for t, c in keys if t == n)) for n in names}
    return tables, sorted(ForeignKey(*r[:4], sum(x[4] == r[4] and x[0] == r[0] for x in links) > 1) for r in links)


def _tables(rows: Rows, schema: str) -> list[str]:
    found = rows(f"SELECT table_name AS t FROM information_schema.tables WHERE table_schema = '{schema}' AND table_type = 'BASE TABLE' ORDER BY table_name")
    return [r[0] for r in found if not r[0].startswith("__")]


def read_postgres(rows: Rows, schema: str = "public") -> tuple[dict[str, TableInfo], list[ForeignKey]]:
    """Tables of a PostgreSQL schema from its information_schema."""
    columns = rows(f"SELECT table_name AS t, column_name AS c, udt_name AS u, is_nullable AS n, CASE WHEN column_default IS NULL THEN 0 ELSE 1 END AS d FROM information_schema.columns WHERE table_schema = '{schema}' ORDER BY ordinal_position")
    usage = "information_schema.table_constraints c JOIN information_schema.key_column_usage k ON c.constraint_schema = k.constraint_schema AND c.constraint_name = k.constraint_name AND c.table_name = k.table_name"
    keys = rows(f"SELECT k.table_name AS t, k.column_name AS c FROM {usage} WHERE c.constraint_type = 'PRIMARY KEY' AND c.constraint_schema = '{schema}' ORDER BY k.ordinal_position")
    links = rows(f"SELECT k.table_name AS t, u.table_name AS p, k.column_name AS c, u.column_name AS k, k.constraint_name AS n FROM {usage} JOIN information_schema.constraint_column_usage u ON c.constraint_schema = u.constraint_schema AND c.constraint_name = u.constraint_name WHERE c.constraint_type = 'FOREIGN KEY' AND c.constraint_schema = '{schema}'")
    return assembled(_tables(rows, schema), [(r[0], ColumnInfo(r[1], postgres_type(r[2]), r[3] == "YES", bool(r[4]))) for r in columns], [tuple(r) for r in keys], [tuple(r) for r in links])


def read_mysql(rows: Rows, schema: str) -> tuple[dict[str, TableInfo], list[ForeignKey]]:
    """Tables of a MySQL database from its information_schema. Unsigned integers take the next wider scalar."""
    columns = rows(f"SELECT table_name AS t, column_name AS c, column_type AS u, is_nullable AS n, CASE WHEN column_default IS NULL AND extra <> 'auto_increment' THEN 0 ELSE 1 END AS d FROM information_schema.columns WHERE table_schema = '{schema}' ORDER BY ordinal_position")
    usage = f"SELECT table_name AS t, column_name AS c, referenced_table_name AS p, referenced_column_name AS k, constraint_name AS n FROM information_schema.key_column_usage WHERE table_schema = '{schema}' ORDER BY ordinal_position"
    wider = {"SmallInt": "Int", "Int": "BigInt"}

    def info(r) -> ColumnInfo:
        scalar, unsigned = mysql_type(r[2])
        return ColumnInfo(r[1], wider.get(scalar, scalar) if unsigned else scalar, r[3] == "YES", bool(r[4]))

    found = rows(usage)
    keys = [(r[0], r[1]) for r in found if r[4] == "PRIMARY"]
    links = [(r[0], r[2], r[1], r[3], r[4]) for r in found if r[2] is not None]
    return assembled(_tables(rows, schema), [(r[0], info(r)) for r in columns], keys, links)


# -- entities --------------------------------------------------------------------


def entities_of(tables: dict[str, TableInfo], links: Iterable[ForeignKey]) -> list[Entity]:
    """An entity for each table; columns that link become HasOne, their targets get HasMany."""
    used = usable_links(links, tables)
    by_column = {(k.child, k.column): k for k in used}
    out = []
    for t in sorted(tables.values(), key=lambda t: t.name):
        fields: list = []
        for c in t.columns:
            link = by_column.get((t.name, c.name))
            if link is not None:
                fields.append(HasOne(c.name, entity_name(link.parent), c.type, nullable=c.nullable))
            else:
                fields.append(Column(c.name, c.type, nullable=c.nullable))
        taken = {f.name for f in fields}
        for k in sorted(k for k in used if k.parent == t.name):
            name = k.child if k.child not in taken else f"{k.child}_by_{k.column}"
            fields.append(HasMany(name, entity_name(k.child), k.column))
        out.append(Entity(entity_name(t.name), t.name, tuple(fields), t.primary_key))
    return out


def printed(tables: dict[str, TableInfo], links: Iterable[ForeignKey]) -> str:
    """Declarations as Python text, with mutations for tables that have more than key columns."""
    entities = entities_of(tables, links)
    out = ["from nestql.model import Column, Entity, HasMany, HasOne, InputField, Mutation", "from nestql.schema import Schema", ""]
    names = []
    for e in entities:
        name = safe(e.table.replace(".", "_")).upper()
        names.append(name)
        out.append(f"{name} = Entity(\n    {e.name!r},\n    {e.table!r},\n    (")
        for f in e.fields:
            if isinstance(f, HasMany):
                out.append(f"        HasMany({f.name!r}, {f.target!r}, {f.fk!r}),")
            else:
                kind = f"{f.target!r}, {f.type!r}" if isinstance(f, HasOne) else repr(f.type)
                out.append(f"        {type(f).__name__}({f.name!r}, {kind}{', nullable=True' if f.nullable else ''}),")
        out.append(f"    ),\n    {e.primary_key!r},\n)\n")
    out.append("MUTATIONS = (")
    for e in entities:
        t = tables[e.table]
        if all(c.name in t.primary_key for c in t.columns):
            continue
        new = [c for c in t.columns if c.name not in t.primary_key and not c.has_default] if len(t.primary_key) == 1 else [c for c in t.columns if not c.has_default]
        out.append(f"    Mutation(\n        {e.name!r},")
        for label, cs, needed in (("insert", new, lambda c: not c.nullable), ("update", t.columns, lambda c: c.name in t.primary_key)):
            out.append(f"        {label}=(")
            for c in cs:
                out.append(f"            InputField({camel(c.name)!r}, {c.name!r}, {c.type!r}, required={needed(c)}),")
            out.append("        ),")
        out.append("    ),")
    out.append(f")\n\nSCHEMA = Schema(({', '.join(names)}{',' if len(names) == 1 else ''}), mutations=MUTATIONS)\n")
    return "\n".join(out)


def infer(source: str, schema: str | None = None, spark: SparkSession | None = None) -> tuple[dict[str, TableInfo], list[ForeignKey]]:
    """``schema``: of PostgreSQL, public if none is given; of MySQL, the URL's database."""
    kind = backend(source)
    if kind == "sqlite":
        return read_sqlite(source)
    spark = spark or SparkSession.builder.getOrCreate()
    if kind == "parquet":
        return read_parquet(spark, source)
    rows = jdbc_rows(spark, source)
    return read_postgres(rows, schema or "public") if kind == "postgres" else read_mysql(rows, schema or source.split("?")[0].rsplit("/", 1)[-1])


def main(args: list[str]) -> int:
    if not args or args[0] in ("-h", "--help"):
        print("usage: python -m nestql.sources.infer <folder | sqlite file | postgres or mysql url> [schema]")
        return 2
    print(printed(*infer(*args[:2])), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
