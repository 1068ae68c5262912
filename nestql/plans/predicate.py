"""Predicates: a small algebra between filter arguments and columns or SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from nestql.functions.scalars import Unfit, coerce, sql_literal
from nestql.model import Column, Entity, EnumType, HasMany, HasOne, OwnFilter
from nestql.plans.language import Value


@dataclass(frozen=True)
class Cmp:
    """op: eq, not_eq, eq_any or like."""

    op: str
    column: str
    value: Any
    type: str | EnumType


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool = False


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class InRelation:
    """``column`` is among the values of ``key`` in the rows of ``entity`` that fit ``part``.

    ``column_nullable`` and ``key_nullable`` tell where nulls may occur, which decides what NOT means.
    """

    column: str
    entity: Entity
    key: str
    part: Any
    column_nullable: bool = False
    key_nullable: bool = False


@dataclass(frozen=True)
class Custom:
    """A predicate of an entity's own filter member: a callable from nothing to a Spark column, and its SQL."""

    build: Callable
    sql: str = ""


def conjunction(parts: list) -> Any:
    """AND of what is there; None if nothing is."""
    flat: list = []
    for p in parts:
        if isinstance(p, And):
            flat += p.parts
        elif p is not None:
            flat.append(p)
    return None if not flat else flat[0] if len(flat) == 1 else And(tuple(flat))


def disjunction(parts: list) -> Any:
    flat = [p for p in parts if p is not None]
    return None if not flat else flat[0] if len(flat) == 1 else Or(tuple(flat))


def _column_filter(sql: str, kind: str | EnumType, nullable: bool, value: Value) -> Any:
    """All operations given for one column, ANDed; a null or a value that doesn't fit is no predicate."""
    if value.kind != "object":
        return None
    parts: list = []
    for op, v in value.value.items():
        try:
            if v.kind == "null":
                continue
            if op in ("eq", "not_eq"):
                parts.append(Cmp(op, sql, coerce(v.value, v.kind, kind), kind))
            elif op == "eq_any" and v.kind == "list":
                parts.append(Cmp(op, sql, [coerce(x.value, x.kind, kind) for x in v.value if x.kind != "null"], kind))
            elif op == "like" and kind == "String":
                parts.append(Cmp(op, sql, coerce(v.value, v.kind, "String"), kind))
            elif op == "is_null" and nullable and v.kind == "boolean":
                parts.append(IsNull(sql, not v.value))
        except Unfit:
            continue
    return conjunction(parts)


def build(entity: Entity, entities: dict[str, Entity], value: Value | None) -> Any:
    """The predicate of an entity's filter argument; None means all rows."""
    if value is None or value.kind != "object":
        return None
    parts: list = []
    for name, v in value.value.items():
        if name == "and" and v.kind == "list":
            parts.append(conjunction([build(entity, entities, x) for x in v.value]))
        elif name == "or" and v.kind == "list":
            parts.append(disjunction([build(entity, entities, x) for x in v.value]))
        elif name == "not":
            inner = build(entity, entities, v)
            parts.append(None if inner is None else Not(inner))
        elif name in entity.extra_filters:
            own = entity.extra_filters[name]
            parts.append((own.build if isinstance(own, OwnFilter) else own)(v))
        else:
            f = entity.get(name)
            if isinstance(f, Column):
                parts.append(_column_filter(f.source, f.type, f.nullable, v))
            elif isinstance(f, HasOne) and v.kind == "object":
                target = entities[f.target]
                rest = Value("object", {k: x for k, x in v.value.items() if not (k == "is_null" and f.nullable)})
                inner = build(target, entities, rest)
                if inner is not None:
                    parts.append(InRelation(f.source, target, target.primary_key[0], inner, f.nullable, False))
                null = v.value.get("is_null")
                if f.nullable and null is not None and null.kind == "boolean":
                    parts.append(IsNull(f.source, not null.value))
            elif isinstance(f, HasMany):
                target = entities[f.target]
                inner = build(target, entities, v)
                if inner is not None:
                    fk = target.by_source(f.fk)
                    parts.append(InRelation(entity.primary_key[0], target, f.fk, inner, False, fk.nullable))
    return conjunction(parts)


def key_predicate(entity: Entity, values: dict[str, Any]) -> Any:
    """Equality with a primary key, single or composite."""
    return conjunction([Cmp("eq", c, values[c], key_type(entity, c)) for c in entity.primary_key])


def key_type(entity: Entity, sql: str) -> str | EnumType:
    return entity.by_source(sql).type


def to_sql(p: Any, table_of: Callable[[str], str] = lambda t: t, alias: str = "t") -> str:
    """A predicate in SQL, for oracles."""
    if p is None:
        return "TRUE"
    if isinstance(p, Cmp):
        c = f"{alias}.{p.column}"
        if p.op == "eq_any":
            return f"{c} IN ({', '.join(map(sql_literal, p.value))})" if p.value else "FALSE"
        op = {"eq": "=", "not_eq": "<>", "like": "LIKE"}[p.op]
        return f"{c} {op} {sql_literal(p.value)}" + (" ESCAPE '\\'" if p.op == "like" else "")
    if isinstance(p, IsNull):
        return f"{alias}.{p.column} IS {'NOT ' * p.negated}NULL"
    if isinstance(p, And):
        return "(" + " AND ".join(to_sql(x, table_of, alias) for x in p.parts) + ")"
    if isinstance(p, Or):
        return "(" + " OR ".join(to_sql(x, table_of, alias) for x in p.parts) + ")"
    if isinstance(p, Not):
        return f"(NOT {to_sql(p.part, table_of, alias)})"
    if isinstance(p, InRelation):
        inner = alias + "_"
        return f"({alias}.{p.column} IN (SELECT {inner}.{p.key} FROM {table_of(p.entity.table)} {inner} WHERE {to_sql(p.part, table_of, inner)}))"
    return f"({p.sql})"
