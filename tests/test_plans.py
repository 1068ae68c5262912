"""What plans scan, gather and join, and the switches that no query of the benchmark covers."""

import datetime
import logging
import re

import pytest

from nestql import tpch
from nestql.engine import Engine
from nestql.model import Column, Entity, RootField
from nestql.queries import engine as tpch_engine
from nestql.schema import Schema
from nestql.sources.catalog import FrameCatalog
from tests import starwars as S


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def gathered(df):
    """For each list that is gathered, the plan below it."""
    lines = optimized(df).split("\n")
    depth = [len(re.match(r"[ :+\-|]*", x)[0]) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if "Aggregate" in x and "collect_list" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


LISTS = "{ Customers%s { c_name orders { o_orderkey lineitems { l_linenumber part { p_name } supplier { s_name lineitems { l_quantity } } } } } }"


@pytest.mark.parametrize("argument", ["(filter: {nation: {n_nationkey: {eq: 7}}})", "(limit: 3)", "(filter: {c_custkey: {eq: 5}})"])
def test_lists_of_all_levels_are_narrowed(spark, sf_dir, argument):
    """Nothing is gathered from a whole table: each list's rows meet their parents' keys below the gathering."""
    plans = gathered(tpch_engine(spark, sf_dir).dataframe(LISTS % argument))
    assert len(plans) == 3
    for p in plans:
        first = p.split("\n")
        assert any("LeftSemi" in x for x in first), p
        # the semi-join comes before the nested lists and objects are joined to the rows
        joins = [x for x in first if "Join " in x]
        inner = [x for x in joins if "LeftOuter" in x]
        assert not inner or min(map(first.index, inner)) < max(first.index(x) for x in joins if "LeftSemi" in x)


def test_whole_tables_arent_narrowed(spark, sf_dir):
    assert "LeftSemi" not in optimized(tpch_engine(spark, sf_dir).dataframe(LISTS % ""))


def test_to_one_rows_of_few_parents_are_narrowed(spark, sf_dir):
    e = tpch_engine(spark, sf_dir)
    assert "LeftSemi" in optimized(e.dataframe("{ Orders(limit: 5) { o_orderkey customer { c_name } } }"))
    assert "LeftSemi" not in optimized(e.dataframe('{ Orders(filter: {o_orderstatus: {eq: "F"}}) { o_orderkey customer { c_name } } }'))


def test_not_in_plans_its_keys_twice_at_most(spark):
    e = S.engine(spark)
    df = e.dataframe("{ Heros(filter: {not: {home_world: {heros: {heroName: {like: \"L%\"}}}}}) { heroName } }")
    assert [r.heroName for r in df.collect()] == []
    text = df._jdf.queryExecution().analyzed().toString()
    assert text.count("LIKE L%") + text.count("LIKE 'L%'") <= 2


def test_switches_take_arguments_away():
    for switch in ("filter", "limit", "offset", "order"):
        s = tpch.schema()
        only = Schema(tpch.ENTITIES, [RootField("Nation", **{switch: False})])
        assert switch in s.arguments("Query", "Nations") and switch not in only.arguments("Query", "Nations")
        assert set(s.arguments("Query", "Nations")) - {switch} == set(only.arguments("Query", "Nations"))
    assert "Nation" not in Schema(tpch.ENTITIES, [RootField("Nation", lookup=False)]).roots


def test_switched_off_arguments_are_errors(spark, sf_dir):
    e = tpch_engine(spark, sf_dir)
    e.schema = Schema(tpch.ENTITIES, [RootField("Nation", limit=False)])
    out = e.execute("{ Nations(limit: 3) { n_name } }")
    assert "data" not in out and "limit" in out["errors"][0]["message"]


def test_times_as_epoch_seconds(spark):
    note = Entity("Note", "notes", (Column("id", "Int"), Column("at", "NaiveDateTime", nullable=True)))
    rows = [(1, datetime.datetime(2001, 9, 9, 1, 46, 40)), (2, None)]
    frames = FrameCatalog({"notes": spark.createDataFrame(rows, "id int, at timestamp_ntz")})
    for epoch, want in ((True, 1_000_000_000), (False, "2001-09-09T01:46:40")):
        out = Engine(frames, Schema((note,), ["Note"]), epoch_times=epoch).execute("{ Notes { id at } }")
        assert out["data"]["Notes"] == [{"id": 1, "at": want}, {"id": 2, "at": None}]


def test_debug_logs_plans(spark, caplog):
    with caplog.at_level(logging.INFO, "nestql"):
        S.engine(spark).execute("{ Heros { id } }")
        assert not caplog.records
        S.engine(spark, debug=True).execute("{ mine: Heros { id } }")
    assert [r.getMessage().split("\n")[0] for r in caplog.records] == ["mine"] and "Physical Plan" in caplog.text


def test_table_errors_are_errors_of_their_field(spark):
    frames = S.frames(spark)
    del frames["species"]
    frames["friends"] = frames["friends"].selectExpr("hero_id", "raise_error('disk gone') as friend_id")
    from nestql.sources.catalog import ParquetCatalog

    class Half(FrameCatalog):
        def table(self, name):
            return self.tables[name] if name in self.tables else ParquetCatalog(spark, "/nowhere").table(name)

        def snapshot(self):
            return self

    e = S.engine(spark, Half(frames))
    out = e.execute("{ Hero(primaryKey: {id: 1}) { heroName } Species(primaryKey: {id: 1}) { name } }")
    assert out["data"] == {"Hero": {"heroName": "Luke Skywalker"}, "Species": None}
    assert [x["path"] for x in out["errors"]] == [["Species"]] and "nowhere" in out["errors"][0]["message"] and "\n" not in out["errors"][0]["message"]
    out = e.execute("{ Heros { heroName } Friends { friend_id { id } } }")
    assert out["data"] is None and out["errors"][0]["path"] == ["Friends"] and "disk gone" in out["errors"][0]["message"]


def test_own_filters_of_any_type(spark, sf_dir):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from nestql.model import OwnFilter
    from nestql.plans.predicate import Custom

    own = {
        "key_in": OwnFilter(lambda v: Custom(lambda: F.col("n_nationkey").isin([x.value for x in v.value])), "[Int!]"),
        "span": OwnFilter(lambda v: Custom(lambda: F.col("n_nationkey").between(v.value["low"].value, v.value["high"].value)), "Span", (("low", "Int!"), ("high", "Int!"))),
    }
    entities = tuple(replace(x, extra_filters=own) if x is tpch.NATION else x for x in tpch.ENTITIES)
    e = Engine(tpch_engine(spark, sf_dir).catalog, tpch.schema(entities=entities))
    keys = lambda text, v=None: [r["n_nationkey"] for r in e.execute(text, v)["data"]["Nations"]]
    assert keys("{ Nations(filter: {key_in: [3, 5]}) { n_nationkey } }") == [3, 5]
    assert keys("query($s: Span!) { Nations(filter: {span: $s}) { n_nationkey } }", {"s": {"low": 20, "high": 22}}) == [20, 21, 22]
    for bad in ('{key_in: ["x"]}', "{span: {low: 1}}", "{span: {low: 1, high: 2, mid: 3}}", "{span: 3}"):
        assert "data" not in e.execute(f"{{ Nations(filter: {bad}) {{ n_nationkey }} }}"), bad
    assert e.schema.input_fields("Span") == {"low": "Int!", "high": "Int!"} and "input Span {" in e.schema.sdl()


def test_loading_steps_can_be_overridden(spark):
    from dataclasses import replace

    from nestql.plans.planner import Loading

    class Guarded(Loading):
        def rows(self, planner, entity, selection, root):
            return super().rows(planner, entity, selection, root).filter(f"id <> {planner.context['hidden']}")

    hero = replace(S.HERO, loading=Guarded())
    e = Engine(FrameCatalog(S.frames(spark)), Schema((S.SPECIES, S.HOME_WORLD, hero, S.APPEARS_IN, S.FRIEND)), context={"hidden": 2})
    out = e.execute("{ Heros { id } Speciess(filter: {heros: {heroName: {eq: \"Darth Vader\"}}}) { name } HomeWorlds { heros { id } } }")["data"]
    assert out == {"Heros": [{"id": i} for i in (1, 3, 4, 5)], "Speciess": [], "HomeWorlds": [{"heros": [{"id": 1}]}, {"heros": [{"id": 4}]}]}
