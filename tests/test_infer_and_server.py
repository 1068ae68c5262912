import json
import sqlite3
import threading
import urllib.error
import urllib.request

import pytest

from nestql.functions import naming
from nestql.model import Column, HasMany, HasOne
from nestql.server import serve
from nestql.sources import infer as I
from tests import starwars as S

DDL = """
CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT NOT NULL);
CREATE TABLE posts (id INTEGER PRIMARY KEY, author INTEGER REFERENCES users (id), title TEXT NOT NULL, datetime TIMESTAMP, content TEXT);
CREATE TABLE comments (id INTEGER PRIMARY KEY, post INTEGER REFERENCES posts (id), commenter INTEGER REFERENCES users (id), content TEXT NOT NULL);
CREATE TABLE __hidden (id INTEGER PRIMARY KEY);
"""


@pytest.fixture
def blog(tmp_path):
    path = str(tmp_path / "blog.db")
    con = sqlite3.connect(path)
    con.executescript(DDL)
    con.close()
    return path


def test_sqlite(blog):
    tables, links = I.infer(blog)
    assert list(tables) == ["comments", "posts", "users"] and len(links) == 3
    by = {e.name: e for e in I.entities_of(tables, links)}
    assert by["Comment"].fields == (Column("id", "Int"), HasOne("post", "Post", "Int", nullable=True), HasOne("commenter", "User", "Int", nullable=True), Column("content", "String"))
    assert by["Post"].get("datetime") == Column("datetime", "NaiveDateTime", nullable=True) and by["Post"].get("comments") == HasMany("comments", "Comment", "post")
    assert {f.name for f in by["User"].fields} == {"id", "name", "comments", "posts"}


def test_printed_declarations_run(blog, capsys):
    assert I.main([blog]) == 0
    scope = {}
    exec(capsys.readouterr().out, scope)
    assert {"CreatePost", "CreatePosts", "UpdateComment", "DeleteUser"} <= set(scope["SCHEMA"].mutations)
    new = scope["SCHEMA"].input_fields("NewPost")
    assert new == {"author": "Int", "title": "String!", "datetime": "NaiveDateTime", "content": "String"}
    assert scope["SCHEMA"].input_fields("PostChangeset")["id"] == "Int!"


def test_unusable_links():
    t = {n: I.TableInfo(n, (I.ColumnInfo("id", "Int"),), key) for n, key in (("a", ("id",)), ("b", ("id",)), ("c", ("id", "k")), ("d", ("id",)))}
    links = [I.ForeignKey("a", "a", "x", "id"), I.ForeignKey("a", "z", "x", "id"), I.ForeignKey("a", "c", "x", "id"), I.ForeignKey("a", "b", "x", "other"), I.ForeignKey("b", "d", "x", "id"), I.ForeignKey("d", "b", "y", "id"), I.ForeignKey("a", "d", "x", "id"), I.ForeignKey("d", "c", "x", "id", True)]
    assert I.usable_links(links, t) == [I.ForeignKey("a", "d", "x", "id")]
    with pytest.raises(I.InferenceError):
        I.TableInfo("x", (), ())


def test_types_and_names():
    assert [I.sqlite_type(t) for t in ("BOOLEAN", "tinyint", "SMALLINT", "bigint", "integer", "varchar(9)", "blob", "real", "decimal(3)", "datetime", "date")] == ["Boolean", "Boolean", "SmallInt", "BigInt", "Int", "String", "Binary", "Float", "Double", "NaiveDateTime", "Date"]
    assert [I.postgres_type(t) for t in ("int4", "_text", "timestamptz", "tsvector")] == ["Int", "[String]", "DateTime", "Tsvector"]
    assert [I.mysql_type(t) for t in ("tinyint(1)", "int(10) unsigned", "varchar(9)", "mediumblob")] == [("Boolean", False), ("Int", True), ("String", False), ("Binary", False)]
    assert [I.backend(x) for x in ("postgres://h/d", "postgresql://h/d", "x.db", "/data/folder")] == ["postgres", "postgres", "sqlite", "parquet"]
    with pytest.raises(I.InferenceError):
        I.sqlite_type("hstore")
    assert naming.entity_name("home_worlds") == "HomeWorld" and naming.camel("hair_color") == "hairColor" and naming.variant("NewHope") == "NEW_HOPE" and naming.safe("class") == "class_"
    assert naming.key_type("a.users") == "A_usersPrimaryKey"


def test_parquet(spark, sf_dir):
    tables, links = I.read_parquet(spark, sf_dir, ["region", "nation", "customer", "orders"])
    assert tables["orders"].primary_key == ("o_orderkey",)
    used = {(k.child, k.parent, k.column) for k in I.usable_links(links, tables)}
    assert {("nation", "region", "n_regionkey"), ("customer", "nation", "c_nationkey"), ("orders", "customer", "o_custkey")} <= used
    assert "HasMany('nation'" in I.printed(tables, links)


def test_http(spark):
    server = serve(S.engine(spark), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def post(body):
        request = urllib.request.Request(base + "/graphql", data=body, headers={"Content-Type": "application/json"})
        return json.loads(urllib.request.urlopen(request, timeout=120).read())

    try:
        assert post(json.dumps({"query": "query($i: Int!) { Hero(primaryKey: {id: $i}) { heroName } }", "variables": {"i": 3}}).encode()) == {"data": {"Hero": {"heroName": "Han Solo"}}}
        url = base + "/graphql?query=%7B%20Species(primaryKey%3A%7Bid%3A2%7D)%7Bname%7D%20%7D"
        assert json.loads(urllib.request.urlopen(url, timeout=120).read()) == {"data": {"Species": {"name": "Robot"}}}
        with pytest.raises(urllib.error.HTTPError) as e:
            post(b"not json")
        assert e.value.code == 400
        assert b"<textarea" in urllib.request.urlopen(base + "/elsewhere", timeout=60).read()
    finally:
        server.shutdown()
        server.server_close()
