"""Selection trees: fragments expanded, variables bound, directives applied."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from nestql.errors import DocumentError
from nestql.plans.language import Document, FieldNode, Inline, Operation, Spread, Value, value_of


@dataclass
class Selection:
    name: str
    key: str
    arguments: dict[str, Value]
    children: list[Selection] = field(default_factory=list)
    location: tuple[int, int] | None = None

    @property
    def children_by_key(self) -> dict[str, Selection]:
        return {c.key: c for c in self.children}


def _same(a: Value, b: Value) -> bool:
    if a.kind != b.kind:
        return False
    if a.kind == "list":
        return len(a.value) == len(b.value) and all(map(_same, a.value, b.value))
    if a.kind == "object":
        return a.value.keys() == b.value.keys() and all(_same(v, b.value[k]) for k, v in a.value.items())
    return a.value == b.value


class Binder:
    def __init__(self, doc: Document, operation: Operation, variables: dict[str, Any] | None):
        self.fragments = doc.fragments
        self.bound: dict[str, Value] = {}
        given = variables or {}
        for v in operation.variables:
            if v.name in given:
                self.bound[v.name] = value_of(given[v.name])
            elif v.default is not None:
                self.bound[v.name] = v.default
            if v.type.endswith("!") and (v.name not in self.bound or self.bound[v.name].kind == "null"):
                raise DocumentError(f"Variable ${v.name} of type {v.type} is missing", v.location)
        self.declared = {v.name for v in operation.variables}

    def value(self, v: Value) -> Value | None:
        """A literal with its variables replaced; None if it is a variable without a value."""
        if v.kind == "variable":
            if v.value not in self.declared:
                raise DocumentError(f"Variable ${v.value} isn't declared", v.location)
            found = self.bound.get(v.value)
            return None if found is None else Value(found.kind, found.value, v.location)
        if v.kind == "list":
            return Value("list", [x for x in map(self.value, v.value) if x is not None], v.location)
        if v.kind == "object":
            return Value("object", {k: x for k, x in ((k, self.value(y)) for k, y in v.value.items()) if x is not None}, v.location)
        return v

    def wanted(self, directives) -> bool:
        for d in directives:
            if d.name not in ("include", "skip"):
                raise DocumentError(f"Unknown directive @{d.name}")
            cond = d.arguments.get("if")
            cond = self.value(cond) if cond else None
            if cond is None or cond.kind != "boolean":
                raise DocumentError(f"@{d.name} takes if: Boolean!")
            if cond.value != (d.name == "include"):
                return False
        return True

    def select(self, selections: list[Any], on: str, types_of, inside: tuple[str, ...] = ()) -> list[Selection]:
        """types_of(type, field) gives the type of a field's value, or None for a scalar."""
        out: dict[str, Selection] = {}

        def add(s: Selection) -> None:
            had = out.get(s.key)
            if had is None:
                out[s.key] = s
                return
            if had.name != s.name or had.arguments.keys() != s.arguments.keys() or not all(_same(v, s.arguments[k]) for k, v in had.arguments.items()):
                raise DocumentError(f"Fields conflict at {s.key}", s.location)
            merged = Selection(had.name, had.key, had.arguments, list(had.children), had.location)
            for c in s.children:
                merged.children = merge(merged.children, c)
            out[s.key] = merged

        def merge(children: list[Selection], c: Selection) -> list[Selection]:
            for i, x in enumerate(children):
                if x.key == c.key:
                    if x.name != c.name:
                        raise DocumentError(f"Fields conflict at {c.key}", c.location)
                    kids = list(x.children)
                    for g in c.children:
                        kids = merge(kids, g)
                    return [*children[:i], Selection(x.name, x.key, x.arguments, kids, x.location), *children[i + 1 :]]
            return [*children, c]

        for s in selections:
            if not self.wanted(s.directives):
                continue
            if isinstance(s, FieldNode):
                arguments = {k: v for k, v in ((k, self.value(v)) for k, v in s.arguments.items()) if v is not None}
                inner = types_of(on, s.name)
                children = self.select(s.selections, inner or "", types_of, inside) if s.selections else []
                add(Selection(s.name, s.key, arguments, children, s.location))
            else:
                if isinstance(s, Spread):
                    if s.name not in self.fragments:
                        raise DocumentError(f"Unknown fragment {s.name}", s.location)
                    if s.name in inside:
                        raise DocumentError(f"Fragment {s.name} contains itself", s.location)
                    f = self.fragments[s.name]
                    target, body, path = f.on, f.selections, (*inside, s.name)
                else:
                    assert isinstance(s, Inline)
                    target, body, path = s.on or on, s.selections, inside
                if target != on:
                    raise DocumentError(f"A fragment on {target} can't be used on {on}")
                for c in self.select(body, on, types_of, path):
                    add(c)
        return list(out.values())
