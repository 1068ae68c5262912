import pytest

from nestql.errors import EngineError
from tests import starwars as S

LUKE, VADER, HAN, LEIA, TARKIN = NAMES = ["Luke Skywalker", "Darth Vader", "Han Solo", "Leia Organa", "Wilhuff Tarkin"]


@pytest.fixture(scope="module")
def engine(spark):
    return S.engine(spark)


def heroes(engine, arguments):
    out = engine.execute(f"{{ Heros({arguments}) {{ heroName }} }}")
    assert "errors" not in out, out
    return [h["heroName"] for h in out["data"]["Heros"]]


CASES = [
    ("filter: null", NAMES),
    ("filter: {id: {eq: 1}}", [LUKE]),
    ("filter: {id: {not_eq: 1}}", [VADER, HAN, LEIA, TARKIN]),
    ('filter: {heroName: {like: "Leia %"}}', [LEIA]),
    ("filter: {id: {eq_any: [1, 4]}}", [LUKE, LEIA]),
    ("filter: {id: {eq_any: []}}", []),
    ('filter: {and: [{heroName: {like: "Leia %"}}, {id: {eq: 4}}]}', [LEIA]),
    ('filter: {or: [{heroName: {like: "Leia %"}}, {id: {eq: 1}}]}', [LUKE, LEIA]),
    ("filter: {or: [{}, {id: {eq: 1}}]}", [LUKE]),
    ("filter: {hair_color: {is_null: true}}", [VADER, HAN, LEIA, TARKIN]),
    ("filter: {hair_color: {is_null: false}}", [LUKE]),
    ('filter: {hair_color: {like: "bl%"}}', [LUKE]),
    ('filter: {hair_color: {not_eq: "red"}}', [LUKE]),
    ("filter: {not: {id: {eq: 1}}}", [VADER, HAN, LEIA, TARKIN]),
    ("filter: {not: {}}", NAMES),
    ('filter: {species: {name: {eq: "Human"}}}', NAMES),
    ('filter: {home_world: {name: {eq: "Alderaan"}}}', [LEIA]),
    ("filter: {home_world: {is_null: true}}", [HAN, TARKIN]),
    ('filter: {home_world: {is_null: false, name: {like: "T%"}}}', [LUKE, VADER]),
    ('filter: {home_world: {name: {not_eq: "Tatooine"}}}', [LEIA]),
    ('filter: {home_world: {heros: {heroName: {like: "Luke%"}}}}', [LUKE, VADER]),
    ('filter: {home_world: {heros: {heroName: {not_eq: "Leia Organa"}}}}', [LUKE, VADER]),
    ('filter: {not: {home_world: {name: {eq: "Alderaan"}}}}', [LUKE, VADER]),
    ('filter: {not: {home_world: {name: {eq: "nowhere"}}}}', NAMES),
    ("filter: {appears_in: {episode: {eq: NEWHOPE}}}", [LUKE, VADER, HAN, LEIA]),
    ("order: [{column: heroName, direction: ASC}]", [VADER, HAN, LEIA, LUKE, TARKIN]),
    ("order: [{column: heroName, direction: DESC}]", [TARKIN, LUKE, LEIA, HAN, VADER]),
    ("order: [{column: home_world}, {column: heroName}]", [VADER, LUKE, LEIA, HAN, TARKIN]),
    ("order: [{column: hair_color, direction: DESC}, {column: id, direction: DESC}], limit: 2", [TARKIN, LEIA]),
    ("limit: 2", [LUKE, VADER]),
    ("limit: 0", []),
    ("offset: 2", [HAN, LEIA, TARKIN]),
    ("limit: 2, offset: 2", [HAN, LEIA]),
]


@pytest.mark.parametrize("arguments,expected", CASES)
def test_lists(engine, arguments, expected):
    got = heroes(engine, arguments)
    assert got == expected if "order" in arguments or "limit" in arguments or "offset" in arguments else sorted(got) == sorted(expected)


def test_nulls_can_sort_first(spark):
    assert heroes(S.engine(spark, nulls_first=True), "order: [{column: home_world}, {column: heroName}]") == [HAN, TARKIN, VADER, LUKE, LEIA]


def test_nesting(engine):
    out = engine.execute("{ Heros { heroName home_world { name } } Speciess { name heros(filter: {heroName: {like: \"Luke%\"}}) { heroName } } }")["data"]
    assert {h["heroName"]: h["home_world"] for h in out["Heros"]} == {LUKE: {"name": "Tatooine"}, VADER: {"name": "Tatooine"}, HAN: None, LEIA: {"name": "Alderaan"}, TARKIN: None}
    assert sorted(out["Speciess"], key=str) == [{"name": "Human", "heros": [{"heroName": LUKE}]}, {"name": "Robot", "heros": []}]


def test_many_to_many_and_cycles(engine):
    out = engine.execute("{ Hero(primaryKey: {id: 1}) { heroName friends { hero_id friend_id { heroName friends { hero_id } } } appears_in { episode hero_id { id } } } }")["data"]["Hero"]
    assert out["friends"] == [{"hero_id": h, "friend_id": {"heroName": LUKE, "friends": [{"hero_id": 3}, {"hero_id": 4}]}} for h in (3, 4)]
    assert [a["episode"] for a in out["appears_in"]] == ["NEWHOPE", "EMPIRE", "JEDI"]


def test_aliases_fragments_directives(engine):
    out = engine.execute(
        """query Q($id: Int!, $no: Boolean = false) {
             a: Hero(primaryKey: {id: $id}) { ...f twice: heroName hair_color @skip(if: true) species @include(if: $no) { name } }
             b: Hero(primaryKey: {id: 42}) { heroName }
           }
           fragment f on Hero { name: heroName world: home_world { planet: name __typename } ... on Hero { world: home_world { id } } }""",
        {"id": 4},
    )
    assert out == {"data": {"a": {"name": "Leia Organa", "world": {"planet": "Alderaan", "__typename": "HomeWorld", "id": 2}, "twice": "Leia Organa"}, "b": None}}


def test_composite_key(engine):
    assert engine.execute("{ AppearsIn(primaryKey: {hero_id: 5, episode: JEDI}) { episode } }")["data"] == {"AppearsIn": {"episode": "JEDI"}}


@pytest.mark.parametrize(
    "text",
    [
        '{ Heros(filter: {heroName: {id: "Leia %"}}) { heroName } }',
        "{ Heros(filter: {id: {is_null: true}}) { heroName } }",
        '{ Heros(filter: {id: {eq: "one"}}) { heroName } }',
        '{ Heros(filter: {id: {like: "1%"}}) { heroName } }',
        "{ Heros { nothing } }",
        "{ Heros { species } }",
        "{ Heros { heroName { x } } }",
        "{ Heros(first: 3) { heroName } }",
        "{ Speciess { heros(limit: 1) { heroName } } }",
        "{ Nothing { id } }",
        "{ Hero { id } Heros { id }",
        "{ Hero(primaryKey: {}) { id } }",
        "{ a: Heros { id } a: Speciess { id } }",
        "query($x: Int!) { Hero(primaryKey: {id: $x}) { id } }",
        "{ ...missing }",
        "{ Heros { ...f } } fragment f on Hero { ...f }",
        "",
    ],
)
def test_documents_that_do_not_fit(engine, text):
    out = engine.execute(text)
    assert out["errors"] and "data" not in out


def test_errors_of_fields(engine):
    out = engine.execute("\n{\n    Heros(order: {column: heroName, direction: DESC}) {\n        heroName\n    }\n}\n")
    assert out == {"data": None, "errors": [{"message": "Could not build filter from arguments", "locations": [{"line": 3, "column": 5}], "path": ["Heros"]}]}
    assert engine.execute("{ Heros(limit: -1) { id } }")["data"] is None
    assert engine.execute("{ Heros(limit: null) { id } }")["errors"][0]["message"] == "Could not build filter from arguments"
    assert engine.execute("{ Hero { id } ok: Hero(primaryKey: {id: 1}) { id } }") == {"data": {"Hero": None, "ok": {"id": 1}}, "errors": [{"message": "No primary key argument found", "locations": [{"line": 1, "column": 3}], "path": ["Hero"]}]}


def test_modifiers(spark):
    from dataclasses import replace

    from nestql.engine import Engine
    from nestql.model import RootField
    from nestql.schema import Schema
    from nestql.sources.catalog import FrameCatalog

    def only(entity, context, selection, df):
        if context == "nobody":
            raise EngineError("Not allowed")
        least = selection.arguments.get("least")
        return df.filter(df.id >= (least.value if least else 3))

    hero = replace(S.HERO, modifier=only)
    schema = Schema((S.SPECIES, S.HOME_WORLD, hero, S.APPEARS_IN, S.FRIEND), [RootField("Hero", extra={"least": ("Int", 3)}), "Species"])
    text = "{ Heros { id } Speciess { heros { id } } }"
    catalog = FrameCatalog(S.frames(spark))
    out = Engine(catalog, schema).execute(text)["data"]
    assert sorted(h["id"] for h in out["Heros"]) == [3, 4, 5] and [len(s["heros"]) for s in out["Speciess"]] == [3, 0]
    assert [len(s["heros"]) for s in Engine(catalog, schema, root_only=True).execute(text)["data"]["Speciess"]] == [5, 0]
    assert [h["id"] for h in Engine(catalog, schema).execute("{ Heros(least: 5) { id } }")["data"]["Heros"]] == [5]
    assert Engine(catalog, schema, context="nobody").execute("{ Heros { id } }")["errors"][0]["message"] == "Not allowed"


def test_introspection(engine):
    fields = "name description isDeprecated deprecationReason"
    out = engine.execute(f'{{ __type(name: "Hero") {{ name description fields {{ {fields} }} }} }}')["data"]["__type"]
    assert (out["name"], out["description"]) == ("Hero", "A hero from Star Wars")
    assert [f["name"] for f in out["fields"]] == ["id", "heroName", "species", "home_world", "appears_in", "friends"]
    assert out["fields"][1] == {"name": "heroName", "description": "The name of a hero", "isDeprecated": False, "deprecationReason": None}
    out = engine.execute(f'{{ __type(name: "Hero") {{ fields(includeDeprecated: true) {{ {fields} }} }} }}')["data"]["__type"]["fields"]
    assert out[2]["isDeprecated"] and out[2]["deprecationReason"] == "Hair color should be unimportant"
    out = engine.execute("{ __schema { queryType { name } mutationType { fields { name args { name type { kind ofType { name } } } } } types { kind name } } }")["data"]["__schema"]
    assert {"CreateHero", "CreateHeros", "UpdateHero", "DeleteHero", "DeleteHomeWorld"} <= {f["name"] for f in out["mutationType"]["fields"]}
    assert {"HeroFilter", "Filter_Int_", "Filter_Nullable_String__", "Nullable_is_null__HomeWorldFilter", "Not_HeroFilter_", "HeroOrderBy", "HeroColumns", "HerosPrimaryKey", "Order", "DeletedCount", "Episode"} <= {t["name"] for t in out["types"]}
    assert 'home_world: HomeWorld\n' in engine.schema.sdl() and "enum Episode" in engine.schema.sdl()


def test_filters_of_an_entitys_own(spark):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from nestql.engine import Engine
    from nestql.plans.predicate import Custom
    from nestql.schema import Schema
    from nestql.sources.catalog import FrameCatalog

    starts = lambda v: Custom(lambda: F.col("name").startswith(v.value), f"starts_with(t.name, '{v.value}')")
    hero = replace(S.HERO, extra_filters={"starts": starts})
    e = Engine(FrameCatalog(S.frames(spark)), Schema((S.SPECIES, S.HOME_WORLD, hero, S.APPEARS_IN, S.FRIEND), ["Hero"]))
    assert heroes(e, 'filter: {starts: "L"}') == [LUKE, LEIA]
    assert heroes(e, 'filter: {not: {starts: "L"}, home_world: {is_null: false}}') == [VADER]
