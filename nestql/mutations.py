"""Mutations: create, batch create, update and delete on a table store.

A mutation writes the rows and keys by which tables change in one transaction and
then loads its rows again through the ordinary planner, so relations can be
nested in its result. Keys of a single integer column are counted up in the
store.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.errors import Conflict, EngineError
from nestql.functions.scalars import coerce, literal
from nestql.model import Entity, HasMany, InputField, Mutation
from nestql.plans.language import Value
from nestql.plans.predicate import Cmp, Or, key_predicate, key_type
from nestql.plans.selection import Selection

INTEGERS = ("SmallInt", "Int", "BigInt")
#: How often a mutation begins again after another transaction was faster.
RETRIES = 5


def read_input(fields: tuple[InputField, ...], v: Value) -> dict[str, Any]:
    """The members of an input by column; null and absent ones are left out."""
    return {f.sql: coerce(v.value[f.name].value, v.value[f.name].kind, f.type) for f in fields if f.name in v.value and v.value[f.name].kind != "null"}


def read_key(entity: Entity, v: Value) -> dict[str, Any]:
    return {c: coerce(v.value[c].value, v.value[c].kind, key_type(entity, c)) for c in entity.primary_key}


class Mutations:
    """Actions on the engine's catalog; one that loses to another transaction begins again, up to ``RETRIES`` times."""

    def __init__(self, engine):
        self.engine, self.entities = engine, engine.schema.entities

    def run(self, selection: Selection) -> tuple[str, Any]:
        """("rows", (entity, keys, several?)) or ("count", n)."""
        m, action = self.engine.schema.mutations[selection.name]
        entity, e = self.entities[m.entity], self.engine
        argument = {"create": f"New{m.entity}", "batch": f"New{m.entity}s", "update": f"Update{m.entity}", "delete": f"Delete{m.entity}"}[action]
        value = selection.arguments.get(argument)
        if value is None:
            raise EngineError(f'Missing argument "{argument}"', selection.location)
        if action == "delete":
            return "count", m.on_delete(e, entity, value, e.context) if m.on_delete else self.tried(lambda tx: self.delete(tx, entity, read_key(entity, value)))
        if action == "update":
            keys = [m.on_update(e, entity, value, e.context) if m.on_update else self.tried(lambda tx: self.update(tx, entity, m, value))]
        else:
            items = [value] if action == "create" or value.kind != "list" else value.value
            handler = m.on_insert if action == "create" else m.on_batch
            if handler:
                keys = handler(e, entity, value if action == "create" else items, e.context)
            else:
                keys = self.tried(lambda tx: self.insert(tx, entity, m, items)) if items else []
        return "rows", (entity, keys, action == "batch")

    def tried(self, action: Callable[[Any], Any]) -> Any:
        """An action in a transaction of its own."""
        if not hasattr(self.engine.catalog, "begin"):
            raise EngineError("These tables can't be changed")
        for left in range(RETRIES, -1, -1):
            tx = self.engine.catalog.begin()
            try:
                return action(tx)
            except Conflict:
                if not left:
                    raise
            except BaseException:
                tx.rollback()
                raise

    def _where(self, predicate: Any) -> SparkColumn:
        return self.engine.planner().filters.column(predicate)

    def insert(self, tx, entity: Entity, m: Mutation, items: list[Value]) -> list[dict[str, Any]]:
        rows = [read_input(m.insert or (), v) for v in items]
        table, next_ids = tx.table(entity.table), {}
        single = entity.primary_key[0] if len(entity.primary_key) == 1 else None
        if single and key_type(entity, single) in INTEGERS and any(single not in r for r in rows):
            at = tx.next_ids.get(entity.table)
            if at is None:
                at = (table.agg(F.max(F.col(f"`{single}`"))).first()[0] or 0) + 1
            for r in rows:
                r.setdefault(single, at)
                at = max(at, r[single] + 1)
            next_ids = {entity.table: at}
        for r in rows:
            lost = [c for c in entity.primary_key if c not in r]
            if lost:
                raise EngineError(f"No value for {lost[0]} of {entity.name}")
        keys = [{c: r[c] for c in entity.primary_key} for r in rows]
        if len({tuple(k.values()) for k in keys}) < len(keys) or table.filter(self._where(self._any(entity, keys))).limit(1).count():
            raise EngineError(f"A row of {entity.name} has this key already")
        schema = table.schema
        new = table.sparkSession.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema=type(schema)([type(f)(f.name, f.dataType, True) for f in schema]))
        tx.append(entity.table, new)
        tx.commit(next_ids)
        return keys

    def _any(self, entity: Entity, keys: list[dict[str, Any]]) -> Any:
        parts = [key_predicate(entity, k) for k in keys]
        if len(entity.primary_key) == 1:
            c = entity.primary_key[0]
            return Cmp("eq_any", c, [k[c] for k in keys], key_type(entity, c))
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def update(self, tx, entity: Entity, m: Mutation, value: Value) -> dict[str, Any]:
        given = read_input(m.update or (), value)
        lost = [c for c in entity.primary_key if c not in given]
        if lost:
            raise EngineError("No primary key argument found")
        key = {c: given.pop(c) for c in entity.primary_key}
        if not given:
            raise EngineError("There are no changes to save")
        rows = tx.table(entity.table).filter(self._where(key_predicate(entity, key)))
        if not rows.limit(1).count():
            return key
        types = {f.name: f.dataType for f in rows.schema}
        changed = rows.withColumns({c: literal(v, entity.by_source(c).type).cast(types[c]) for c, v in given.items()})
        tx.update(entity.table, changed, entity.primary_key, list(given))
        tx.commit()
        return key

    def delete(self, tx, entity: Entity, key: dict[str, Any]) -> int:
        rows = tx.table(entity.table).filter(self._where(key_predicate(entity, key)))
        n = rows.count()
        if n:
            gone = tx.delete(entity.table, keys_of(rows, entity.primary_key))
            self._cascade(tx, entity, gone)
            tx.commit()
        return n

    def _cascade(self, tx, entity: Entity, gone: DataFrame) -> None:
        """Rows that hold a deleted key go with it, level by level until a level has none; keys that went before aren't followed again."""
        todo = [(entity, gone)]
        followed: dict[str, list[DataFrame]] = {entity.name: [gone]}
        while todo:
            entity, gone = todo.pop(0)
            for f in entity.fields:
                if not isinstance(f, HasMany) or f.on_delete != "cascade":
                    continue
                child = self.entities[f.target]
                parents = gone.select(F.col(f"`{entity.primary_key[0]}`").alias(f.fk)).distinct()
                if any(isinstance(g, HasMany) and g.on_delete == "cascade" for g in child.fields):
                    lost = keys_of(tx.table(child.table).join(parents, f.fk, "left_semi"), child.primary_key)
                    for before in followed.get(child.name, []):
                        lost = lost.join(before, [*child.primary_key], "left_anti")
                    lost = tx.delete(child.table, lost)  # written, so plans of deep levels don't hold those above
                    if lost.limit(1).count():
                        followed[child.name] = [*followed.get(child.name, []), lost]
                        todo.append((child, lost))
                else:
                    tx.delete(child.table, parents)


def keys_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct values of some columns."""
    return rows.select(*[F.col(f"`{c}`") for c in columns]).distinct()


def reload_predicate(entity: Entity, keys: list[dict[str, Any]]) -> Any:
    """The rows that a mutation returns."""
    parts = [key_predicate(entity, k) for k in keys]
    if not parts:
        return Cmp("eq_any", entity.primary_key[0], [], key_type(entity, entity.primary_key[0]))
    return parts[0] if len(parts) == 1 else Or(tuple(parts))


def sorted_like(rows: list[dict], keys: list[dict[str, Any]], names: list[str]) -> list[dict]:
    """Rows in the order of the input."""
    place = {tuple(k.values()): i for i, k in enumerate(keys)}
    return sorted(rows, key=lambda r: place[tuple(r[n] for n in names)])

