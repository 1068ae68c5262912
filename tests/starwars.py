"""A small fixture: heroes, their species, home worlds, friends and films."""

from nestql.engine import Engine
from nestql.model import Column, Entity, EnumType, HasMany, HasOne, InputField, Mutation, RootField
from nestql.schema import Schema
from nestql.sources.catalog import FrameCatalog

Episode = EnumType("Episode", (("NEWHOPE", 1), ("EMPIRE", 2), ("JEDI", 3)))

SPECIES = Entity("Species", "species", (Column("id", "Int"), Column("name", "String"), HasMany("heros", "Hero", "species")))
HOME_WORLD = Entity("HomeWorld", "home_worlds", (Column("id", "Int"), Column("name", "String"), HasMany("heros", "Hero", "home_world")))
HERO = Entity(
    "Hero",
    "heros",
    (
        Column("id", "Int", description="Internal id of a hero"),
        Column("heroName", "String", "name", description="The name of a hero"),
        Column("hair_color", "String", nullable=True, deprecated="Hair color should be unimportant"),
        HasOne("species", "Species", description="Which species a hero belongs to"),
        HasOne("home_world", "HomeWorld", nullable=True, description="On which world a hero was born"),
        HasMany("appears_in", "AppearsIn", "hero_id", description="Episodes a hero appears in", on_delete="cascade"),
        HasMany("friends", "Friend", "friend_id", description="List of friends of the current hero", on_delete="cascade"),
    ),
    description="A hero from Star Wars",
)
APPEARS_IN = Entity("AppearsIn", "appears_in", (HasOne("hero_id", "Hero"), Column("episode", Episode)), ("hero_id", "episode"))
FRIEND = Entity("Friend", "friends", (Column("hero_id", "Int"), HasOne("friend_id", "Hero")), ("hero_id", "friend_id"))

#: The rows, and the names and descriptions of entities and fields above, are those of the expected results.
ROWS = {
    "species": ("id int, name string", [(1, "Human"), (2, "Robot")]),
    "home_worlds": ("id int, name string", [(1, "Tatooine"), (2, "Alderaan")]),
    "heros": (
        "id int, name string, species int, home_world int, hair_color string",
        [(1, "Luke Skywalker", 1, 1, "blond"), (2, "Darth Vader", 1, 1, None), (3, "Han Solo", 1, None, None), (4, "Leia Organa", 1, 2, None), (5, "Wilhuff Tarkin", 1, None, None)],
    ),
    "appears_in": ("hero_id int, episode smallint", [(h, e) for h in range(1, 5) for e in (1, 2, 3)] + [(5, 3)]),
    "friends": ("hero_id int, friend_id int", [(1, 3), (1, 4), (2, 5), (3, 1), (3, 4), (4, 1), (4, 3), (5, 2)]),
}

HERO_INPUT = (InputField("name", "name", "String"), InputField("hairColor", "hair_color", "String", False), InputField("species", "species", "Int"), InputField("homeWorld", "home_world", "Int", False))
HERO_CHANGES = (InputField("id", "id", "Int"), *[InputField(f.name, f.sql, f.type, False) for f in HERO_INPUT])
MUTATIONS = (
    Mutation("Hero", HERO_INPUT, None, HERO_CHANGES),
    Mutation("Species", (InputField("name", "name", "String"),), None, (InputField("id", "id", "Int"), InputField("name", "name", "String", False))),
    Mutation("Friend", (InputField("heroId", "hero_id", "Int"), InputField("friendId", "friend_id", "Int"))),
    Mutation("AppearsIn", (InputField("heroId", "hero_id", "Int"), InputField("episode", "episode", Episode))),
    Mutation("HomeWorld"),
)


def schema(**more):
    return Schema((SPECIES, HOME_WORLD, HERO, APPEARS_IN, FRIEND), [RootField("Hero"), RootField("Species"), RootField("HomeWorld"), RootField("AppearsIn", "Appearances"), RootField("Friend")], MUTATIONS)


def frames(spark):
    return {n: spark.createDataFrame(rows, ddl).coalesce(1) for n, (ddl, rows) in ROWS.items()}


def engine(spark, catalog=None, **more):
    return Engine(catalog or FrameCatalog(frames(spark)), schema(), **more)
