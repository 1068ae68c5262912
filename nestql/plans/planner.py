"""Plans: an entity's selection as one DataFrame.

scan -> filter -> sort -> offset -> limit -> nest -> project. Every column gets
a name of its own right after the scan, so that entities can nest in each other
to any depth; only columns that the selection needs leave the scan. Limits apply
before nesting. Below a filtered or limited entity, on every level, a list's rows
are narrowed to those of its parents by a semi-join before anything is gathered
or joined to them, and so are rows of to-one relations that hold lists or whose
parents a limit has left few of.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.errors import ArgumentError, UnknownField
from nestql.functions.scalars import rendered
from nestql.model import Column, Entity, HasMany, HasOne
from nestql.operators.filtering import Filters
from nestql.operators.nesting import nest_list, nest_object
from nestql.operators.ordering import sort_keys, window
from nestql.plans.language import Value
from nestql.plans.predicate import build, conjunction
from nestql.plans.selection import Selection


@dataclass
class EntityQuery:
    entity: Entity
    selection: Selection
    predicate: Any = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    offset: int | None = None
    limit: int | None = None


class Loading:
    """How an entity is loaded; subclasses override steps, for entities that name one as ``loading``."""

    def rows(self, planner: Planner, entity: Entity, selection: Selection | None, root: bool) -> DataFrame:
        df = planner.catalog.table(entity.table)
        if entity.modifier is not None and selection is not None and (root or not planner.root_only):
            df = entity.modifier(entity, planner.context, selection, df)
        return df

    def filtered(self, planner: Planner, q: EntityQuery, df: DataFrame) -> DataFrame:
        return planner.filters.apply(df, q.predicate)

    def order(self, planner: Planner, q: EntityQuery) -> list[tuple[str, bool]]:
        """(column, descending); the key breaks ties."""
        order = list(q.order)
        if order or q.limit is not None or q.offset:
            order += [(c, False) for c in q.entity.primary_key if c not in {o for o, _ in order}]
        return order

    def windowed(self, planner: Planner, q: EntityQuery, df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
        return window(df, order, q.offset, q.limit, planner.nulls_first)

    def narrowed(self, q: EntityQuery) -> bool:
        """Whether rows of the table may be missing, so that what nests in it is narrowed first."""
        return q.predicate is not None or q.limit is not None


@dataclass
class Planned:
    frame: DataFrame
    #: Values by response key, in request order.
    values: list[SparkColumn]
    #: Columns that were asked to be kept, by their table names.
    kept: dict[str, str]
    #: Scalar columns of the selection, to sort rows that no key identifies.
    scalars: list[str]


@dataclass
class Within:
    """The rows' ``column`` holds a value of ``key`` of ``parents``; these are few after a limit."""

    column: str
    parents: DataFrame
    key: str
    few: bool


def integer_argument(value: Value | None) -> int | None:
    """limit and offset: absent means none; anything but a number is an error."""
    if value is None:
        return None
    if value.kind != "int" or value.value < 0:
        raise ArgumentError
    return value.value


def order_argument(entity: Entity, value: Value | None) -> list[tuple[str, bool]]:
    if value is None:
        return []
    if value.kind != "list":
        raise ArgumentError
    out = []
    for item in value.value:
        column = item.value.get("column") if item.kind == "object" else None
        direction = item.value.get("direction") if item.kind == "object" else None
        if column is None or column.kind not in ("enum", "string") or (direction is not None and direction.value not in ("ASC", "DESC")):
            raise ArgumentError
        f = entity.get(column.value)
        if f is None or isinstance(f, HasMany):
            raise UnknownField(column.value)
        out.append((f.source, direction is not None and direction.value == "DESC"))
    return out


class Planner:
    """``catalog.table(name)`` gives tables. ``root_only``: modifiers apply to root fields alone."""

    def __init__(self, catalog, entities: dict[str, Entity], context: Any = None, *, nulls_first: bool = False, root_only: bool = False):
        self.catalog, self.entities, self.context = catalog, entities, context
        self.nulls_first, self.root_only = nulls_first, root_only
        self.filters = Filters(lambda e: self.rows(e))
        self._numbers = count()

    def fresh(self) -> str:
        return f"__nql{next(self._numbers)}"

    def loading(self, entity: Entity) -> Loading:
        return entity.loading or DEFAULT

    def rows(self, entity: Entity, selection: Selection | None = None, root: bool = False) -> DataFrame:
        return self.loading(entity).rows(self, entity, selection, root)

    def holds_list(self, entity: Entity, selection: Selection) -> bool:
        fields = [(s, entity.get(s.name)) for s in selection.children if s.name != "__typename"]
        return any(isinstance(f, HasMany) or (isinstance(f, HasOne) and self.holds_list(self.entities[f.target], s)) for s, f in fields)

    def query(self, entity: Entity, selection: Selection, predicate: Any = None) -> EntityQuery:
        a = selection.arguments
        try:
            found = build(entity, self.entities, a.get("filter"))
            both = [p for p in (predicate, found) if p is not None]
            return EntityQuery(entity, selection, conjunction(both), order_argument(entity, a.get("order")), integer_argument(a.get("offset")), integer_argument(a.get("limit")))
        except (ArgumentError, UnknownField) as e:
            e.location = e.location or selection.location
            raise

    def plan(self, q: EntityQuery, keep: tuple[str, ...] = (), root: bool = False, within: Within | None = None) -> Planned:
        """``within``: only rows whose column holds a key of those of the parents."""
        entity, loading = q.entity, self.loading(q.entity)
        df = loading.filtered(self, q, loading.rows(self, entity, q.selection, root))
        order = loading.order(self, q)
        if order or q.limit is not None or q.offset:
            df = loading.windowed(self, q, df, order)
        fields = [(s, entity.get(s.name)) for s in q.selection.children if s.name != "__typename"]
        names: dict[str, str] = {}
        many = any(isinstance(f, HasMany) for _, f in fields)
        for sql in (*keep, *(o for o, _ in order), *(entity.primary_key if many else ()), *(f.source for _, f in fields if not isinstance(f, HasMany))):
            names.setdefault(sql, self.fresh())
        df = df.select(*[F.col(f"`{sql}`").alias(n) for sql, n in names.items()]) if names else df.select(F.lit(True).alias(self.fresh()))
        if within is not None:
            own = self.fresh()
            df = df.join(within.parents.select(F.col(within.key).alias(own)), F.col(names[within.column]) == F.col(own), "left_semi")
        narrowed = within is not None or loading.narrowed(q)
        few = q.limit is not None or (within is not None and within.few)
        parents, values = df, {}
        for s, f in fields:
            if isinstance(f, Column):
                values[s.key] = rendered(F.col(names[f.source]), f.type)
            elif isinstance(f, HasOne):
                target = self.entities[f.target]
                key = target.primary_key[0]
                only = Within(key, parents, names[f.source], few) if few or (narrowed and self.holds_list(target, s)) else None
                child = self.plan(EntityQuery(target, s), (key,), within=only)
                out = self.fresh()
                df = nest_object(df, names[f.source], child.frame, child.kept[key], child.values, out)
                values[s.key] = F.col(out)
            else:
                target = self.entities[f.target]
                child_query = EntityQuery(target, s, build(target, self.entities, s.arguments.get("filter")))
                key = names[entity.primary_key[0]]
                child = self.plan(child_query, (f.fk, *target.primary_key), within=Within(f.fk, parents, key, few) if narrowed else None)
                sort = [child.kept[c] for c in target.primary_key]
                if not target.unique:
                    sort += [c for c in child.scalars if c not in sort]
                out = self.fresh()
                df = nest_list(df, key, child.frame, child.kept[f.fk], sort, child.values, out)
                values[s.key] = F.col(out)
        ordered = []
        for s in q.selection.children:
            ordered.append((F.lit(entity.name) if s.name == "__typename" else values[s.key]).alias(s.key))
        if root and order:
            df = df.orderBy(*sort_keys([(names[c], d) for c, d in order], self.nulls_first))
        return Planned(df, ordered, names, [names[f.source] for _, f in fields if not isinstance(f, HasMany)])

    def frame(self, q: EntityQuery) -> DataFrame:
        """The rows of a root field, a column for each response key."""
        planned = self.plan(q, root=True)
        return planned.frame.select(*planned.values)


DEFAULT = Loading()
