"""Declarations: entities, their columns and relations, enums, inputs of mutations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from nestql.functions.naming import plural_field


@dataclass(frozen=True)
class EnumType:
    """A set of names with the values that tables store for them."""

    name: str
    values: tuple[tuple[str, Any], ...]
    description: str | None = None

    def stored(self, name: str) -> Any:
        return dict(self.values)[name]


@dataclass(frozen=True)
class Column:
    """A scalar. ``type`` is a scalar's name, a list of one as ``[Double]``, or an enum."""

    name: str
    type: str | EnumType
    sql: str | None = None
    nullable: bool = False
    description: str | None = None
    deprecated: str | None = None

    @property
    def source(self) -> str:
        return self.sql or self.name


@dataclass(frozen=True)
class HasOne:
    """A foreign key, shown as the row it points to; ``type`` is the key's scalar."""

    name: str
    target: str
    type: str = "Int"
    sql: str | None = None
    nullable: bool = False
    description: str | None = None
    deprecated: str | None = None

    @property
    def source(self) -> str:
        return self.sql or self.name


@dataclass(frozen=True)
class HasMany:
    """All rows of ``target`` whose column ``fk`` holds this row's primary key."""

    name: str
    target: str
    fk: str
    description: str | None = None
    deprecated: str | None = None
    #: What a delete of this row does to those: None or "cascade".
    on_delete: str | None = None


Field = Column | HasOne | HasMany


@dataclass(frozen=True)
class OwnFilter:
    """A member of a filter input: ``build(value)`` gives its predicate or None.

    ``type`` is the input's type, as ``Int`` or ``[String!]``; with ``members``
    (name -> type) it is the name of an input object that has these.
    """

    build: Callable
    type: str = "String"
    members: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Entity:
    """A table with a graph type. ``unique`` is false where the key's columns don't identify a row."""

    name: str
    table: str
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...] = ("id",)
    unique: bool = True
    description: str | None = None
    #: (entity, context, selection, frame) -> frame, or an EngineError raised: a hook on each load.
    modifier: Callable | None = None
    #: A ``plans.planner.Loading`` with steps of its own, or None for the usual ones.
    loading: Any = field(default=None, hash=False, compare=False)
    #: Further members of the filter input: an OwnFilter, or a function value -> predicate or None of a String.
    extra_filters: dict[str, OwnFilter | Callable] = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(names) != len(set(names)):
            raise ValueError(f"{self.name}: a field is declared twice")

    @property
    def columns(self) -> list[Column | HasOne]:
        return [f for f in self.fields if not isinstance(f, HasMany)]

    def get(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def by_source(self, sql: str) -> Column | HasOne:
        return next(f for f in self.columns if f.source == sql)


@dataclass(frozen=True)
class RootField:
    """An entity's two root fields and the arguments of its list."""

    entity: str
    name: str | None = None
    lookup: bool = True
    filter: bool = True
    limit: bool = True
    offset: bool = True
    order: bool = True
    #: Further arguments: name -> (type, default). The modifier sees them in the selection.
    extra: dict[str, tuple[str, Any]] = field(default_factory=dict, hash=False, compare=False)

    @property
    def list_name(self) -> str:
        return self.name or plural_field(self.entity)


@dataclass(frozen=True)
class InputField:
    name: str
    sql: str
    type: str | EnumType
    required: bool = True


@dataclass(frozen=True)
class Mutation:
    """What may be done to an entity: insert and update are off unless an input says what, delete is on.

    Handlers replace the default action: (engine, entity, value, context) -> the keys of created rows (insert, batch; batch
    gets a list of values), the key of the changed row, or a count for delete. Keys are dicts by column.
    """

    entity: str
    insert: tuple[InputField, ...] | None = None
    insert_name: str | None = None
    update: tuple[InputField, ...] | None = None
    update_name: str | None = None
    delete: bool = True
    batch: bool = True
    on_insert: Callable | None = None
    on_batch: Callable | None = None
    on_update: Callable | None = None
    on_delete: Callable | None = None
