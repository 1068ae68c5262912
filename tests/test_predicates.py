"""Random filters: Spark's rows against DuckDB's for the SQL of the same predicate."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from nestql.functions.scalars import Unfit, coerce
from nestql.model import Column, Entity, HasMany, HasOne
from nestql.operators.filtering import Filters
from nestql.plans.language import value_of
from nestql.plans.predicate import build, to_sql
from nestql.plans.selection import Selection
from nestql.schema import Schema
from nestql.sources.catalog import FrameCatalog

A = Entity("A", "a", (Column("id", "Int"), Column("x", "Int", nullable=True), Column("s", "String", nullable=True), HasOne("b", "B", nullable=True), HasMany("bs", "B", "a")))
B = Entity("B", "b", (Column("id", "Int"), Column("y", "Int", nullable=True), HasOne("a", "A", nullable=True), HasMany("as", "A", "b")))
ENTITIES = {"A": A, "B": B}
ROWS = {
    "a": ("id int, x int, s string, b int", [(1, 1, "ab", 1), (2, None, "b", 2), (3, 2, None, None), (4, 1, "a%", 9), (5, None, None, 1), (6, 3, "", 3)]),
    "b": ("id int, y int, a int", [(1, 1, 1), (2, None, 2), (3, 2, None), (4, 1, 4), (5, None, 9)]),
}


def ops(name):
    value = st.integers(0, 3) if name != "s" else st.sampled_from(["ab", "b", "", "a%"])
    members = {"eq": value, "not_eq": value, "eq_any": st.lists(value, max_size=2), "is_null": st.booleans()}
    if name == "id":
        members.pop("is_null")
    if name == "s":
        members["like"] = st.sampled_from(["a%", "%b", "_", "a\\%"])
    return st.fixed_dictionaries({}, optional=members)


def filters(entity, depth):
    members = {"id": ops("id")} | ({"x": ops("x"), "s": ops("s")} if entity == "A" else {"y": ops("y")})
    if depth:
        same, other = filters(entity, depth - 1), filters("B" if entity == "A" else "A", depth - 1)
        one = st.tuples(other, st.none() | st.booleans()).map(lambda t: t[0] | ({} if t[1] is None else {"is_null": t[1]}))
        members |= {"and": st.lists(same, max_size=2), "or": st.lists(same, max_size=3), "not": same}
        members |= {"b": one, "bs": other} if entity == "A" else {"a": one, "as": other}
    return st.fixed_dictionaries({}, optional=members)


@pytest.fixture(scope="module")
def world(spark):
    tables = {n: spark.createDataFrame(rows, ddl).coalesce(1).cache() for n, (ddl, rows) in ROWS.items()}
    con = duckdb.connect()
    for n, (ddl, rows) in ROWS.items():
        con.execute(f"CREATE TABLE {n} ({ddl.replace('string', 'varchar')})")
        con.executemany(f"INSERT INTO {n} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return Filters(lambda e: tables[e.table]), tables, con


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(f=filters("A", 2))
def test_random_filters(world, f):
    apply, tables, con = world
    p = build(A, ENTITIES, value_of(f))
    got = sorted(r.id for r in apply.apply(tables["a"], p).collect())
    assert got == sorted(i for (i,) in con.execute(f"SELECT t.id FROM a t WHERE {to_sql(p)}").fetchall())


def test_coercion():
    assert coerce(7, "int", "SmallInt") == 7 and coerce(7, "int", "Double") == 7.0 and coerce(5, "int", "ID") == "5"
    assert str(coerce("2020-01-02T03:04:05+01:00", "string", "Date")) == "2020-01-02"
    assert coerce("2020-01-02T03:04:05Z", "string", "NaiveDateTime").tzinfo is None
    assert coerce("12345678-1234-5678-1234-567812345678", "string", "Uuid")
    for v, token, kind in ((40_000, "int", "SmallInt"), (1 << 31, "int", "Int"), (1.5, "float", "Int"), ("1", "string", "Int"), (1, "int", "String"), (1, "int", "Boolean"), ("x", "string", "Uuid"), ("x", "string", "Date"), ("a", "enum", "String")):
        with pytest.raises(Unfit):
            coerce(v, token, kind)


def test_plans(spark, sf_dir):
    from nestql.queries import QUERIES

    def plan(name):
        return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()

    assert "LeftSemi" in plan("rel_has_many") and "LeftAnti" in plan("rel_not_in") and "NestedLoop" not in plan("rel_not_in")
    scan = plan("filter_eq")
    assert "PushedFilters" in scan and "EqualTo(c_mktsegment,BUILDING)" in scan and "ReadSchema: struct<c_custkey:bigint,c_name:string,c_mktsegment:string>" in scan
    assert "EqualTo(o_orderkey,1)" in plan("lookup_pk") and "TakeOrderedAndProject" in plan("order_asc")


def test_declarations_are_checked(spark):
    with pytest.raises(ValueError):
        Schema((Entity("X", "x", (Column("id", "Int"), HasOne("y", "Y"))),))
    with pytest.raises(ValueError):
        Entity("X", "x", (Column("id", "Int"), Column("id", "Int")))
    with pytest.raises(StopIteration):
        Schema((Entity("X", "x", (Column("k", "Int"),)),))
    assert Selection("a", "b", {}).children_by_key == {} and FrameCatalog({}).tables == {}
