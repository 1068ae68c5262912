"""The engine over databases: SQLite files, and JDBC by the driver that Spark brings along."""

import sqlite3

import pytest

from nestql.engine import Engine
from nestql.errors import Conflict
from nestql.model import Column, Entity, EnumType, HasMany, HasOne, Mutation, RootField
from nestql.schema import Schema, inputs_of
from nestql.sources import infer as I
from nestql.sources.catalog import FrameCatalog
from nestql.sources.database import JdbcCatalog, SqliteCatalog, quoted

Kind = EnumType("Kind", (("HARDBACK", 1), ("PAPER", 2)))
AUTHOR = Entity("Author", "authors", (Column("id", "Int"), Column("name", "String"), Column("born", "NaiveDateTime", nullable=True), HasMany("books", "Book", "author", on_delete="cascade")))
BOOK = Entity("Book", "books", (Column("id", "Int"), HasOne("author", "Author", nullable=True), Column("title", "String"), Column("price", "Double", nullable=True), Column("kind", Kind), HasMany("copies", "Copy", "book", on_delete="cascade")))
COPY = Entity("Copy", "copies", (HasOne("book", "Book"), Column("no", "Int"), Column("lent", "Boolean")), ("book", "no"))
SCHEMA = Schema((AUTHOR, BOOK, COPY), [RootField("Author"), RootField("Book"), RootField("Copy", "Copies")], [Mutation(e.name, inputs_of(e, keys=False), None, inputs_of(e, keys=True)) for e in (AUTHOR, BOOK, COPY)])

ROWS = {
    "authors": [(1, "Ann", "1970-01-02 03:04:05"), (2, "Bo", None), (3, "Cy", None)],
    "books": [(1, 1, "One", 9.5, 1), (2, 1, "Two", None, 2), (3, 2, "Three", 3.25, 2), (4, None, "Four", 1.0, 1)],
    "copies": [(b, n, n == 2) for b in (1, 2, 4) for n in (1, 2, 3)],
}
DDL = {
    "sqlite": ["CREATE TABLE authors (id INTEGER PRIMARY KEY, name TEXT NOT NULL, born TIMESTAMP)", "CREATE TABLE books (id INTEGER PRIMARY KEY, author INTEGER REFERENCES authors (id), title TEXT NOT NULL, price DOUBLE, kind SMALLINT NOT NULL)", "CREATE TABLE copies (book INTEGER NOT NULL REFERENCES books (id), no INTEGER NOT NULL, lent BOOLEAN NOT NULL, PRIMARY KEY (book, no))"],
    "derby": ['CREATE TABLE "authors" ("id" INT PRIMARY KEY, "name" VARCHAR(99) NOT NULL, "born" TIMESTAMP)', 'CREATE TABLE "books" ("id" INT PRIMARY KEY, "author" INT REFERENCES "authors" ("id"), "title" VARCHAR(99) NOT NULL, "price" DOUBLE, "kind" SMALLINT NOT NULL)', 'CREATE TABLE "copies" ("book" INT NOT NULL REFERENCES "books" ("id"), "no" INT NOT NULL, "lent" BOOLEAN NOT NULL, PRIMARY KEY ("book", "no"))'],
}


def sqlite_file(path):
    con = sqlite3.connect(path)
    for ddl in DDL["sqlite"]:
        con.execute(ddl)
    for t, rows in ROWS.items():
        con.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.commit()
    con.close()
    return path


def derby(spark, name):
    url = f"jdbc:derby:memory:{name};create=true"
    con = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    statement = con.createStatement()
    for ddl in DDL["derby"]:
        statement.execute(ddl)
    shown = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else f"'{v}'"
    for t, rows in ROWS.items():
        for r in rows:
            statement.execute(f'INSERT INTO "{t}" VALUES ({", ".join(map(shown, r))})')
    con.close()
    return JdbcCatalog(spark, url)


def frames(spark):
    types = {"authors": "id int, name string, born timestamp_ntz", "books": "id int, author int, title string, price double, kind smallint", "copies": "book int, no int, lent boolean"}
    from datetime import datetime

    return FrameCatalog({t: spark.createDataFrame([tuple(datetime.fromisoformat(v) if isinstance(v, str) and v[:2] == "19" else v for v in r) for r in rows], types[t]).coalesce(1) for t, rows in ROWS.items()})


@pytest.fixture(params=["sqlite", "derby"])
def engines(request, spark, tmp_path):
    """An engine over a database, and one over the same rows in memory."""
    catalog = SqliteCatalog(spark, sqlite_file(str(tmp_path / "b.db"))) if request.param == "sqlite" else derby(spark, "t" + tmp_path.name.replace("-", "_"))
    return Engine(catalog, SCHEMA), Engine(frames(spark), SCHEMA)


QUERIES = [
    "{ Authors { id name born books { title price kind copies { no lent } } } }",
    '{ Books(filter: {author: {name: {eq: "Ann"}}}) { title author { name books { id } } } }',
    "{ Books(filter: {price: {is_null: true}}) { id } b: Books(filter: {kind: {eq_any: [PAPER]}}, order: [{column: title, direction: DESC}]) { title } }",
    "{ Authors(filter: {not: {books: {copies: {lent: {eq: true}}}}}) { name } }",
    '{ Books(filter: {title: {like: "T%"}}, order: [{column: price}], limit: 1, offset: 1) { title copies { no } } }',
    "{ Book(primaryKey: {id: 3}) { title author { born } } Copy(primaryKey: {book: 2, no: 3}) { lent } Author(primaryKey: {id: 9}) { name } }",
    "{ Copies(filter: {book: {author: {id: {eq: 1}}}, no: {eq_any: [1, 2]}}) { no book { title } } }",
]


def test_queries(engines):
    database, memory = engines
    for text in QUERIES:
        got = database.execute(text)
        assert "errors" not in got and got == memory.execute(text), text


MUTATIONS = [
    'mutation { CreateAuthor(NewAuthor: {name: "Di", born: "2001-02-03T04:05:06"}) { id name born } }',
    'mutation { CreateBooks(NewBooks: [{author: 3, title: "Five", kind: PAPER}, {title: "Six", price: 2.5, kind: HARDBACK}]) { id title author { name } } }',
    'mutation { UpdateBook(UpdateBook: {id: 1, title: "Uno", price: 7.0}) { title price copies { no } } }',
    "mutation { CreateCopy(NewCopy: {book: 3, no: 1, lent: false}) { no book { title } } }",
    "mutation { DeleteCopy(DeleteCopy: {book: 2, no: 2}) { count } }",
    "mutation { DeleteAuthor(DeleteAuthor: {id: 1}) { count } }",
]


def test_mutations(engines):
    database, memory = engines
    for text in MUTATIONS:
        got = database.execute(text)
        assert "errors" not in got and got == memory.execute(text), text
        state = "{ Authors { id name born } Books { id title price kind author { id } } Copies { book { id } no lent } }"
        assert database.execute(state) == memory.execute(state)


def test_constraints_are_field_errors(engines):
    out = engines[0].execute("mutation { CreateCopy(NewCopy: {book: 99, no: 1, lent: false}) { no } }")
    assert out["data"] == {"CreateCopy": None} and out["errors"][0]["path"] == ["CreateCopy"]


def test_filters_reach_the_database(engines):
    df = engines[0].dataframe("{ Books(filter: {id: {eq: 3}}) { title } }")
    if isinstance(engines[0].catalog, JdbcCatalog):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(id,3)" in plan and "price" not in plan
    assert [r.title for r in df.collect()] == ["Three"]


def test_sqlite_is_read_by_ranges(spark, tmp_path):
    from nestql.sources.database import SqliteReader

    path = sqlite_file(str(tmp_path / "b.db"))
    books = SqliteCatalog(spark, path, partitions=3).table("books")
    reader = SqliteReader({"path": path, "table": "books", "partitions": "3"}, books.schema)
    assert [(p.first, p.last) for p in reader.partitions()] == [(1, 2), (3, 4)]
    assert [r for p in reader.partitions() for r in reader.read(p)] == ROWS["books"]
    # scans of one DataFrame don't narrow each other
    assert books.filter("id = 1").unionAll(books).count() == 5
    with sqlite3.connect(path) as con:
        con.execute("DELETE FROM copies")
        con.execute("CREATE TABLE tags (name TEXT PRIMARY KEY) WITHOUT ROWID")
        con.execute("INSERT INTO tags VALUES ('a'), ('b')")
    assert SqliteCatalog(spark, path).table("copies").count() == 0
    assert [r.name for r in SqliteCatalog(spark, path).table("tags").collect()] == ["a", "b"]


def test_sqlite_conflicts(spark, tmp_path):
    path = sqlite_file(str(tmp_path / "b.db"))
    catalog = SqliteCatalog(spark, path)
    tx = catalog.begin()
    tx.delete("copies", catalog.table("copies").filter("book = 4").select("book", "no"))
    with sqlite3.connect(path) as con:
        con.execute("INSERT INTO authors VALUES (7, 'Eve', NULL)")
    with pytest.raises(Conflict):
        tx.commit()
    assert catalog.table("copies").count() == 9
    assert quoted('a.b"c') == '"a"."b""c"' and quoted("x", "`") == "`x`"


def test_printed_schemas_run_on_their_database(spark, tmp_path, capsys):
    path = sqlite_file(str(tmp_path / "b.db"))
    assert I.main([path]) == 0
    scope: dict = {}
    exec(capsys.readouterr().out, scope)
    e = Engine(SqliteCatalog(spark, path), scope["SCHEMA"])
    out = e.execute('{ Books(filter: {author: {name: {eq: "Ann"}}}, order: [{column: id}]) { title price author { name } copies { no lent } } }')
    assert [b["title"] for b in out["data"]["Books"]] == ["One", "Two"] and out["data"]["Books"][0]["copies"][1] == {"no": 2, "lent": True}
    out = e.execute('mutation { CreateBook(NewBook: {author: 2, title: "New", kind: 1}) { id author { name } } UpdateAuthor(UpdateAuthor: {id: 2, name: "Bob"}) { name books { title } } }')
    assert out["data"] == {"CreateBook": {"id": 5, "author": {"name": "Bo"}}, "UpdateAuthor": {"name": "Bob", "books": [{"title": "Three"}, {"title": "New"}]}}


def catalogs(tables):
    """A function from SQL to rows over tables of an information_schema."""
    con = sqlite3.connect(":memory:")
    con.execute("ATTACH ':memory:' AS information_schema")
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE information_schema.{name} ({columns})")
        con.executemany(f"INSERT INTO information_schema.{name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return lambda sql: con.execute(sql).fetchall()


def test_postgres_catalog():
    rows = catalogs(
        {
            "tables": ("table_schema, table_name, table_type", [("public", "users", "BASE TABLE"), ("public", "posts", "BASE TABLE"), ("public", "__hidden", "BASE TABLE"), ("public", "v", "VIEW"), ("other", "x", "BASE TABLE")]),
            "columns": ("table_schema, table_name, column_name, udt_name, is_nullable, column_default, ordinal_position", [("public", "users", "id", "int4", "NO", "nextval('s')", 1), ("public", "users", "tags", "_text", "YES", None, 2), ("public", "posts", "id", "int8", "NO", None, 1), ("public", "posts", "author", "int4", "YES", None, 2), ("other", "x", "id", "int4", "NO", None, 1)]),
            "table_constraints": ("constraint_schema, constraint_name, table_name, constraint_type", [("public", "u_pk", "users", "PRIMARY KEY"), ("public", "p_pk", "posts", "PRIMARY KEY"), ("public", "p_fk", "posts", "FOREIGN KEY")]),
            "key_column_usage": ("constraint_schema, constraint_name, table_name, column_name, ordinal_position", [("public", "u_pk", "users", "id", 1), ("public", "p_pk", "posts", "id", 1), ("public", "p_fk", "posts", "author", 1)]),
            "constraint_column_usage": ("constraint_schema, constraint_name, table_name, column_name", [("public", "u_pk", "users", "id"), ("public", "p_pk", "posts", "id"), ("public", "p_fk", "users", "id")]),
        }
    )
    tables, links = I.read_postgres(rows)
    assert list(tables) == ["posts", "users"] and links == [I.ForeignKey("posts", "users", "author", "id")]
    assert tables["users"].columns == (I.ColumnInfo("id", "Int", False, True), I.ColumnInfo("tags", "[String]", True)) and tables["posts"].primary_key == ("id",)
    assert {e.name: [f.name for f in e.fields] for e in I.entities_of(tables, links)} == {"Post": ["id", "author"], "User": ["id", "tags", "posts"]}


def test_mysql_catalog():
    rows = catalogs(
        {
            "tables": ("table_schema, table_name, table_type", [("shop", "users", "BASE TABLE"), ("shop", "posts", "BASE TABLE"), ("mysql", "x", "BASE TABLE")]),
            "columns": ("table_schema, table_name, column_name, column_type, is_nullable, column_default, extra, ordinal_position", [("shop", "users", "id", "int(10) unsigned", "NO", None, "auto_increment", 1), ("shop", "users", "ok", "tinyint(1)", "NO", "1", "", 2), ("shop", "posts", "user", "int(10) unsigned", "NO", None, "", 1), ("shop", "posts", "no", "smallint(6)", "NO", None, "", 2), ("shop", "posts", "text", "mediumtext", "YES", None, "", 3)]),
            "key_column_usage": ("table_schema, table_name, column_name, referenced_table_name, referenced_column_name, constraint_name, ordinal_position", [("shop", "users", "id", None, None, "PRIMARY", 1), ("shop", "posts", "no", None, None, "PRIMARY", 2), ("shop", "posts", "user", None, None, "PRIMARY", 1), ("shop", "posts", "user", "users", "id", "posts_fk", 1)]),
        }
    )
    tables, links = I.read_mysql(rows, "shop")
    assert tables["users"].columns == (I.ColumnInfo("id", "BigInt", False, True), I.ColumnInfo("ok", "Boolean", False, True))
    assert tables["posts"].primary_key == ("user", "no") and tables["posts"].columns[2] == I.ColumnInfo("text", "String", True)
    assert links == [I.ForeignKey("posts", "users", "user", "id")]
    assert [I.backend(x) for x in ("mysql://h/shop", "mariadb://h/shop")] == ["mysql"] * 2


def test_declared_types_of_sqlite():
    told = {
        "INTEGER": ["INT", "INTEGER", "MEDIUMINT", "UNSIGNED BIG INT", "INT2", "int8", "tinyint", "FLOATING POINT"],
        "TEXT": ["CHARACTER(20)", "VARCHAR(255)", "NCHAR(55)", "clob", "text"],
        "BLOB": ["blob", "", " "],
        "REAL": ["REAL", "DOUBLE PRECISION", "float"],
        "NUMERIC": ["NUMERIC", "DECIMAL(10,5)", "BOOLEAN", "DATE", "DATETIME", "varbinary(9)"],
    }
    for kind, types in told.items():
        assert [I.affinity(t) for t in types] == [kind] * len(types)
    scalars = {"UNSIGNED BIG INT": "BigInt", "INT2": "SmallInt", "MEDIUMINT": "Int", "DOUBLE PRECISION": "Double", "NUMERIC": "Double", "varbinary(9)": "Binary", "": "Binary", "timestamp": "NaiveDateTime", "TIME": "Time", "float": "Float", "clob": "String"}
    assert {t: I.sqlite_type(t) for t in scalars} == scalars
