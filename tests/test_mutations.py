import pytest

from nestql.errors import Conflict
from nestql.mutations import RETRIES
from nestql.sources import store as store_module
from nestql.sources.store import VersionedStore
from tests import starwars as S


@pytest.fixture(params=["frames", "store"])
def engine(request, spark, tmp_path):
    if request.param == "frames":
        return S.engine(spark)
    store = VersionedStore(spark, str(tmp_path / "store"))
    store.commit(S.frames(spark), {"heros": 6})
    return S.engine(spark, store)


def names(engine):
    return [h["heroName"] for h in engine.execute("{ Heros(order: [{column: id}]) { heroName } }")["data"]["Heros"]]


def test_create(engine):
    out = engine.execute('mutation Add($who: String!) { CreateHero(NewHero: {name: $who, species: 2, homeWorld: 2}) { home_world { heros { heroName } } heroName id } }', {"who": "Tin Man"})
    assert out == {"data": {"CreateHero": {"home_world": {"heros": [{"heroName": "Leia Organa"}, {"heroName": "Tin Man"}]}, "heroName": "Tin Man", "id": 6}}}
    out = engine.execute('mutation { CreateHeros(NewHeros: [{name: "Dorothy", species: 1, hairColor: "brown"}, {name: "Scarecrow", species: 2}]) { name: heroName hair_color species { name } } }')
    assert out["data"]["CreateHeros"] == [{"name": "Dorothy", "hair_color": "brown", "species": {"name": "Human"}}, {"name": "Scarecrow", "hair_color": None, "species": {"name": "Robot"}}]
    assert names(engine)[-3:] == ["Tin Man", "Dorothy", "Scarecrow"]
    assert engine.execute("mutation { CreateHeros(NewHeros: []) { heroName } }")["data"] == {"CreateHeros": []}


def test_keys_are_not_used_again(engine):
    make = 'mutation { CreateHero(NewHero: {name: "A", species: 1}) { id } }'
    assert engine.execute(make)["data"]["CreateHero"]["id"] == 6
    engine.execute("mutation { DeleteHero(DeleteHero: {id: 6}) { count } }")
    assert engine.execute(make)["data"]["CreateHero"]["id"] == 7


def test_composite_keys(engine):
    out = engine.execute("mutation { CreateFriend(NewFriend: {heroId: 5, friendId: 1}) { hero_id friend_id { heroName } } }")
    assert out["data"]["CreateFriend"] == {"hero_id": 5, "friend_id": {"heroName": "Luke Skywalker"}}
    assert "errors" in engine.execute("mutation { CreateFriend(NewFriend: {heroId: 5, friendId: 1}) { hero_id } }")
    assert engine.execute("mutation { CreateAppearsIn(NewAppearsIn: {heroId: 5, episode: EMPIRE}) { episode } }")["data"]["CreateAppearsIn"] == {"episode": "EMPIRE"}


def test_update(engine):
    out = engine.execute('mutation { UpdateHero(UpdateHero: {id: 4, hairColor: "dark"}) { heroName hair_color } }')
    assert out["data"]["UpdateHero"] == {"heroName": "Leia Organa", "hair_color": "dark"}
    assert engine.execute('mutation { UpdateHero(UpdateHero: {id: 42, hairColor: "dark"}) { heroName } }') == {"data": {"UpdateHero": None}}
    assert engine.execute("mutation { UpdateHero(UpdateHero: {id: 4, hairColor: null}) { heroName } }")["errors"][0]["message"] == "There are no changes to save"
    rows = engine.execute("{ Heros(order: [{column: id}]) { hair_color } }")["data"]["Heros"]
    assert [r["hair_color"] for r in rows] == ["blond", None, None, "dark", None]


def test_delete(engine):
    assert engine.execute("mutation { DeleteHero(DeleteHero: {id: 42}) { count } }") == {"data": {"DeleteHero": {"count": 0}}}
    assert engine.execute("mutation { DeleteHero(DeleteHero: {id: 5}) { n: count } }") == {"data": {"DeleteHero": {"n": 1}}}
    assert names(engine) == ["Luke Skywalker", "Darth Vader", "Han Solo", "Leia Organa"]
    out = engine.execute("{ Friends { hero_id friend_id { id } } Appearances { hero_id { id } } }")["data"]
    assert all(f["friend_id"] and f["friend_id"]["id"] != 5 for f in out["Friends"])
    assert all(a["hero_id"] and a["hero_id"]["id"] != 5 for a in out["Appearances"])


def test_what_is_not_offered(engine):
    assert "data" not in engine.execute('mutation { CreateHomeWorld(NewHomeWorld: {name: "x"}) { id } }')
    assert engine.execute("mutation { CreateHero { heroName } }")["errors"][0]["message"] == 'Missing argument "NewHero"'
    assert "data" not in engine.execute('mutation { CreateHero(NewHero: {name: "x"}) { heroName } }')


def test_failed_transactions_leave_nothing(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    tables = S.frames(spark)
    store.commit({"heros": tables["heros"], "species": tables["species"]})
    broken = tables["species"].selectExpr("id", "raise_error('broken') as name")
    with pytest.raises(Exception):
        store.commit({"heros": tables["heros"].limit(1), "species": broken})
    assert store.table("heros").count() == 5
    assert len(list((tmp_path / "s" / "heros").iterdir())) == len(list((tmp_path / "s" / "species").iterdir())) == 1


ADD = 'mutation {{ CreateSpecies(NewSpecies: {{name: "{}"}}) {{ id }} }}'


def test_of_two_writers_one_begins_again(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.commit(S.frames(spark))
    # both read before either commits: the second loses, whatever the tables they change
    a, b = store.begin(), store.begin()
    rows = store.table("species").limit(0)
    a.append("species", rows.unionByName(spark.createDataFrame([(8, "Ewok")], rows.schema)))
    b.append("species", rows.unionByName(spark.createDataFrame([(9, "Wookiee")], rows.schema)))
    b.commit()
    with pytest.raises(Conflict):
        a.commit()
    assert sorted(r.id for r in store.table("species").collect()) == [1, 2, 9]

    class Rushed(VersionedStore):
        """Another writer commits right after each of the first transactions begins."""

        rivals = 2

        def begin(self):
            tx = super().begin()
            if self.rivals:
                self.rivals -= 1
                other = S.engine(spark, VersionedStore(spark, self.path))
                assert "errors" not in other.execute(ADD.format(f"rival{self.rivals}"))
            return tx

    out = S.engine(spark, Rushed(spark, store.path)).execute(ADD.format("mine"))
    assert out == {"data": {"CreateSpecies": {"id": 12}}}
    assert sorted((r.id, r.name) for r in store.table("species").collect()) == [(1, "Human"), (2, "Robot"), (9, "Wookiee"), (10, "rival1"), (11, "rival0"), (12, "mine")]
    hopeless = Rushed(spark, store.path)
    hopeless.rivals = RETRIES + 1
    assert S.engine(spark, hopeless).execute(ADD.format("late"))["errors"][0]["message"] == "Another transaction was faster"


def test_documents_see_one_version(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.commit(S.frames(spark))
    before = store.snapshot()
    e = S.engine(spark, store)
    e.execute(ADD.format("New"))
    assert before.table("species").count() == 2 and store.table("species").count() == 3
    reads, manifest = [], store.manifest
    store.manifest = lambda: reads.append(1) or manifest()
    e.execute("{ a: Speciess { name heros { heroName } } b: Heros { heroName home_world { name } } }")
    assert len(reads) == 1


def test_changes_dont_rewrite_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "COMPACT", 7)
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.commit(S.frames(spark), {"heros": 6})
    e = S.engine(spark, store)
    first = store.manifest().tables["heros"][0]
    e.execute('mutation { CreateHero(NewHero: {name: "A", species: 1}) { id } }')
    e.execute('mutation { UpdateHero(UpdateHero: {id: 1, hairColor: "grey"}) { id } }')
    e.execute("mutation { DeleteHero(DeleteHero: {id: 5}) { count } }")
    parts = store.manifest().tables["heros"]
    assert parts[0] == first and ["keys" in p for p in parts] == [False, False, True, False, True]
    want = sorted((r.id, r.hair_color) for r in store.table("heros").collect())
    assert want == [(1, "grey"), (2, None), (3, None), (4, None), (6, None)]
    for i in range(3):
        e.execute(f'mutation {{ UpdateHero(UpdateHero: {{id: 2, hairColor: "c{i}"}}) {{ id }} }}')
        assert len(store.manifest().tables["heros"]) <= 7
    assert sorted((r.id, r.hair_color) for r in store.table("heros").collect()) == [(1, "grey"), (2, f"c{i}"), *want[2:]]
    assert len(store.manifest().tables["heros"]) < 7


def test_vacuum_removes_what_no_kept_version_lists(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    store.commit(S.frames(spark))
    e = S.engine(spark, store)
    assert store.vacuum() == 0
    for i in range(3):
        e.execute(ADD.format(f"n{i}"))
        store.commit({"heros": store.table("heros")})
    late = store.begin()
    late.append("species", store.table("species").limit(0))
    assert store.vacuum(keep=2) == 2  # of the four folders of heros, the last two versions list two
    assert len(list((tmp_path / "s" / "_manifests").glob("[0-9]*.json"))) == 2
    assert store.table("heros").count() == 5 and store.table("species").count() == 5
    late.commit()
    assert store.table("species").count() == 5 and store.vacuum(keep=1) == 1


def test_tables_that_cant_be_changed(spark, sf_dir):
    from nestql import tpch
    from nestql.engine import Engine
    from nestql.model import Mutation
    from nestql.sources.catalog import ParquetCatalog

    e = Engine(ParquetCatalog(spark, sf_dir), tpch.schema([Mutation("Nation")]))
    out = e.execute("mutation { DeleteNation(DeleteNation: {n_nationkey: 3}) { count } }")
    assert out["data"] == {"DeleteNation": None} and out["errors"][0]["message"] == "These tables can't be changed"


def test_attached_tables_stay_where_they_are(spark, sf_dir, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    tx = store.begin()
    tx.attach("nation", f"{sf_dir}/nation.parquet")
    tx.commit()
    tx = store.begin()
    tx.delete("nation", tx.table("nation").filter("n_nationkey < 20").select("n_nationkey"))
    tx.commit()
    assert sorted(r.n_nationkey for r in store.table("nation").collect()) == [20, 21, 22, 23, 24]
    assert spark.read.parquet(f"{sf_dir}/nation.parquet").count() == 25


def test_handlers(spark):
    from dataclasses import replace

    from nestql.engine import Engine
    from nestql.schema import Schema
    from nestql.sources.catalog import FrameCatalog

    met = []

    def insert(engine, entity, value, context):
        met.append((engine, entity.name, value.value["name"].value, context))
        return [{"id": 2}]

    def batch(engine, entity, values, context):
        return [{"id": 2 + i} for i, _ in enumerate(values)]

    def update(engine, entity, value, context):
        return {"id": value.value["id"].value + context["shift"]}

    def delete(engine, entity, value, context):
        return value.value["id"].value * 100

    m = replace(S.MUTATIONS[0], on_insert=insert, on_batch=batch, on_update=update, on_delete=delete)
    e = Engine(FrameCatalog(S.frames(spark)), Schema((S.SPECIES, S.HOME_WORLD, S.HERO, S.APPEARS_IN, S.FRIEND), ["Hero"], (m,)), context={"shift": 1})
    assert e.execute('mutation { CreateHero(NewHero: {name: "x", species: 1}) { heroName } }')["data"]["CreateHero"] == {"heroName": "Darth Vader"}
    assert met == [(e, "Hero", "x", {"shift": 1})]
    assert [h["id"] for h in e.execute('mutation { CreateHeros(NewHeros: [{name: "x", species: 1}, {name: "y", species: 1}]) { id } }')["data"]["CreateHeros"]] == [2, 3]
    assert e.execute('mutation { UpdateHero(UpdateHero: {id: 3, name: "x"}) { id } }')["data"]["UpdateHero"] == {"id": 4}
    assert e.execute("mutation { DeleteHero(DeleteHero: {id: 1}) { count } }")["data"]["DeleteHero"] == {"count": 100}


def test_cascades_have_no_deepest_level(spark):
    from nestql.engine import Engine
    from nestql.model import Column, Entity, HasMany, HasOne, Mutation, RootField
    from nestql.schema import Schema
    from nestql.sources.catalog import FrameCatalog

    note = Entity("Note", "notes", (Column("id", "Int"), HasOne("parent", "Note", nullable=True), HasMany("replies", "Note", "parent", on_delete="cascade")))
    # a thread of 21 levels, a cycle, and one note apart
    rows = [(0, None), *[(i, i - 1) for i in range(1, 21)], (30, 32), (31, 30), (32, 31), (40, None)]
    e = Engine(FrameCatalog({"notes": spark.createDataFrame(rows, "id int, parent int").coalesce(1)}), Schema((note,), [RootField("Note")], (Mutation("Note"),)))
    for key, left in ((0, [30, 31, 32, 40]), (31, [40])):
        assert e.execute(f"mutation {{ DeleteNote(DeleteNote: {{id: {key}}}) {{ count }} }}") == {"data": {"DeleteNote": {"count": 1}}}
        assert [n["id"] for n in e.execute("{ Notes(order: [{column: id}]) { id } }")["data"]["Notes"]] == left
