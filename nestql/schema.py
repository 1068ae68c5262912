"""Schemas: the types that declarations give, validation of documents, introspection."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from nestql.errors import DocumentError
from nestql.functions.naming import filter_value_name, key_type
from nestql.functions.scalars import SPARK, Unfit, coerce
from nestql.model import Column, Entity, EnumType, HasMany, HasOne, InputField, Mutation, OwnFilter, RootField
from nestql.plans.language import Value
from nestql.plans.selection import Selection


def type_name(kind: str | EnumType) -> str:
    return kind.name if isinstance(kind, EnumType) else kind


class Schema:
    """Entities with their root fields and mutations."""

    def __init__(self, entities: Iterable[Entity], query: Iterable[RootField | str] | None = None, mutations: Iterable[Mutation] = ()):
        self.entities = {e.name: e for e in entities}
        roots = [RootField(r) if isinstance(r, str) else r for r in (query if query is not None else list(self.entities))]
        self.roots: dict[str, tuple[RootField, bool]] = {}
        for r in roots:
            self.roots[r.list_name] = (r, False)
            if r.lookup:
                self.roots[r.entity] = (r, True)
        self.mutations: dict[str, tuple[Mutation, str]] = {}
        for m in mutations:
            if m.insert is not None:
                self.mutations[f"Create{m.entity}"] = (m, "create")
                if m.batch:
                    self.mutations[f"Create{m.entity}s"] = (m, "batch")
            if m.update is not None:
                self.mutations[f"Update{m.entity}"] = (m, "update")
            if m.delete:
                self.mutations[f"Delete{m.entity}"] = (m, "delete")
        self._check()
        self.types = self._types()

    def _check(self) -> None:
        for e in self.entities.values():
            for f in e.fields:
                if isinstance(f, (HasOne, HasMany)) and f.target not in self.entities:
                    raise ValueError(f"{e.name}.{f.name}: no entity {f.target}")
                if isinstance(f, HasMany):
                    self.entities[f.target].by_source(f.fk)
                if isinstance(f, HasOne) and len(self.entities[f.target].primary_key) != 1:
                    raise ValueError(f"{e.name}.{f.name}: {f.target} has a composite key")
            for c in e.primary_key:
                e.by_source(c)

    # -- types ---------------------------------------------------------------

    def filter_name(self, e: Entity) -> str:
        return f"{e.name}Filter"

    def field_type(self, f: Column | HasOne | HasMany) -> str:
        if isinstance(f, HasMany):
            return f"[{f.target}!]!"
        name = f.target if isinstance(f, HasOne) else type_name(f.type)
        if name.startswith("["):
            name = f"[{name[1:-1]}!]"
        return name if f.nullable else name + "!"

    def filter_type(self, f: Column | HasOne | HasMany) -> str:
        if isinstance(f, Column):
            return f"Filter_{filter_value_name(type_name(f.type), f.nullable)}_"
        target = self.filter_name(self.entities[f.target])
        return f"Nullable_is_null__{target}" if isinstance(f, HasOne) and f.nullable else target

    def list_args(self, r: RootField) -> dict[str, str]:
        e = self.entities[r.entity]
        out = {}
        if r.filter:
            out["filter"] = self.filter_name(e)
        if r.limit:
            out["limit"] = "Int"
        if r.offset:
            out["offset"] = "Int"
        if r.order:
            out["order"] = f"[{e.name}OrderBy!]"
        return out | {k: t for k, (t, _) in r.extra.items()}

    def arguments(self, owner: str, name: str) -> dict[str, str]:
        """The arguments of a field, by name."""
        if owner == "Query":
            if name == "__type":
                return {"name": "String!"}
            if name not in self.roots:
                return {}
            r, lookup = self.roots[name]
            return {"primaryKey": key_type(self.entities[r.entity].table) + "!"} if lookup else self.list_args(r)
        if owner == "Mutation":
            if name not in self.mutations:
                return {}
            m, action = self.mutations[name]
            return {
                "create": {f"New{m.entity}": (m.insert_name or f"New{m.entity}") + "!"},
                "batch": {f"New{m.entity}s": f"[{m.insert_name or f'New{m.entity}'}!]!"},
                "update": {f"Update{m.entity}": (m.update_name or f"{m.entity}Changeset") + "!"},
                "delete": {f"Delete{m.entity}": key_type(self.entities[m.entity].table) + "!"},
            }[action]
        if owner in self.entities and isinstance(f := self.entities[owner].get(name), HasMany):
            return {"filter": self.filter_name(self.entities[f.target])}
        return {}

    def value_type(self, owner: str, name: str) -> str | None:
        """The object type of a field's value; None for scalars. Unknown fields raise."""
        if name == "__typename":
            return None
        if owner == "Query":
            if name in ("__schema", "__type"):
                return {"__schema": "__Schema", "__type": "__Type"}[name]
            if name in self.roots:
                return self.roots[name][0].entity
        elif owner == "Mutation":
            if name in self.mutations:
                m, action = self.mutations[name]
                return "DeletedCount" if action == "delete" else m.entity
        elif owner in self.entities:
            f = self.entities[owner].get(name)
            if f is not None:
                return None if isinstance(f, Column) else f.target
        elif owner == "DeletedCount":
            if name == "count":
                return None
        elif owner in META:
            if name in META[owner]:
                return META[owner][name]
        raise DocumentError(f'Unknown field "{name}" on type "{owner}"')

    def _types(self) -> dict[str, dict[str, Any]]:
        types: dict[str, dict[str, Any]] = {}

        def obj(name: str, fields: list[dict], description: str | None = None) -> None:
            types[name] = {"kind": "OBJECT", "name": name, "description": description, "fields": fields, "interfaces": []}

        def inputs(name: str, members: dict[str, str], description: str | None = None) -> None:
            types.setdefault(name, {"kind": "INPUT_OBJECT", "name": name, "description": description, "inputFields": [{"name": n, "type": t, "description": None, "defaultValue": None} for n, t in members.items()]})

        def enum(name: str, values: list[str], description: str | None = None) -> None:
            types.setdefault(name, {"kind": "ENUM", "name": name, "description": description, "enumValues": [{"name": v, "description": None, "isDeprecated": False, "deprecationReason": None} for v in values]})

        def scalar(kind: str | EnumType) -> None:
            if isinstance(kind, EnumType):
                enum(kind.name, [n for n, _ in kind.values], kind.description)
            else:
                name = kind.strip("[]")
                types.setdefault(name, {"kind": "SCALAR", "name": name, "description": None})

        def described(name: str, kind: str, owner: str, description: str | None = None, deprecated: str | None = None) -> dict:
            args = [{"name": a, "type": t, "description": None, "defaultValue": None} for a, t in self.arguments(owner, name).items()]
            return {"name": name, "type": kind, "description": description, "args": args, "isDeprecated": deprecated is not None, "deprecationReason": deprecated}

        for s in ("Int", "String", "Boolean", "BigInt"):
            scalar(s)
        enum("Order", ["ASC", "DESC"])
        obj("DeletedCount", [described("count", "BigInt!", "DeletedCount")])
        for e in self.entities.values():
            obj(e.name, [described(f.name, self.field_type(f), e.name, f.description, f.deprecated) for f in e.fields], e.description)
            members = {f.name: self.filter_type(f) for f in e.fields}
            members |= {n: own.type if isinstance(own, OwnFilter) else "String" for n, own in e.extra_filters.items()} | {"and": f"[{self.filter_name(e)}!]", "or": f"[{self.filter_name(e)}!]", "not": f"Not_{self.filter_name(e)}_"}
            for own in e.extra_filters.values():
                if isinstance(own, OwnFilter) and own.members:
                    inputs(own.type.rstrip("!"), dict(own.members))
                for kind in [t for _, t in own.members] or [own.type] if isinstance(own, OwnFilter) else []:
                    if kind.strip("[]!") in SPARK:
                        scalar(kind.replace("!", ""))
            inputs(self.filter_name(e), members)
            inputs(f"Not_{self.filter_name(e)}_", {k: v for k, v in members.items() if k not in ("and", "or", "not")} | {"and": f"[{self.filter_name(e)}!]", "or": f"[{self.filter_name(e)}!]", "not": f"Not_{self.filter_name(e)}_"})
            for f in e.fields:
                if isinstance(f, Column):
                    scalar(f.type)
                    name = type_name(f.type)
                    ops = {"eq": name, "not_eq": name, "eq_any": f"[{name}]"} | ({"is_null": "Boolean"} if f.nullable else {}) | ({"like": "String"} if name == "String" else {})
                    inputs(self.filter_type(f), ops)
                elif isinstance(f, HasOne) and f.nullable:
                    target = self.entities[f.target]
                    inputs(self.filter_type(f), {g.name: self.filter_type(g) for g in target.fields} | {"and": f"[{f.target}Filter!]", "or": f"[{f.target}Filter!]", "not": f"Not_{f.target}Filter_", "is_null": "Boolean"})
            enum(f"{e.name}Columns", [f.name for f in e.columns])
            inputs(f"{e.name}OrderBy", {"column": f"{e.name}Columns!", "direction": "Order"})
            inputs(key_type(e.table), {c: type_name(e.by_source(c).type) + "!" for c in e.primary_key})
        obj("Query", [described(n, (r.entity if look else f"[{r.entity}!]!"), "Query") for n, (r, look) in self.roots.items()])
        if self.mutations:
            obj("Mutation", [described(n, {"delete": "DeletedCount", "batch": f"[{m.entity}!]!"}.get(a, m.entity), "Mutation") for n, (m, a) in self.mutations.items()])
            for m, _ in self.mutations.values():
                for fields, name in ((m.insert, m.insert_name or f"New{m.entity}"), (m.update, m.update_name or f"{m.entity}Changeset")):
                    if fields is not None:
                        inputs(name, {f.name: type_name(f.type) + ("!" if f.required else "") for f in fields})
        return types

    # -- validation ----------------------------------------------------------

    def input_fields(self, name: str) -> dict[str, str] | None:
        t = self.types.get(name)
        return {f["name"]: f["type"] for f in t["inputFields"]} if t and t["kind"] == "INPUT_OBJECT" else None

    def enum_type(self, name: str) -> EnumType | None:
        for e in self.entities.values():
            for f in e.columns:
                if isinstance(f.type, EnumType) and f.type.name == name:
                    return f.type
        return None

    def check_value(self, v: Value, kind: str, where: str) -> None:
        """A literal against an input type; lists take a single item as well, as clients may send it."""
        if kind.endswith("!"):
            if v.kind == "null":
                raise DocumentError(f'Invalid value for argument "{where}", expected type "{kind}"', v.location)
            kind = kind[:-1]
        if v.kind == "null":
            return
        if kind.startswith("["):
            for x in v.value if v.kind == "list" else [v]:
                self.check_value(x, kind[1:-1], where)
            return
        members = self.input_fields(kind)
        bad = DocumentError(f'Invalid value for argument "{where}", expected type "{kind}"', v.location)
        if members is not None:
            if v.kind != "object":
                raise bad
            for n, x in v.value.items():
                if n not in members:
                    raise DocumentError(f'Invalid value for argument "{where}": unknown member "{n}" of "{kind}"', x.location)
                self.check_value(x, members[n], where)
            missing = [n for n, t in members.items() if t.endswith("!") and n not in v.value]
            if missing:
                raise DocumentError(f'Invalid value for argument "{where}": "{kind}" misses "{missing[0]}"', v.location)
            return
        t = self.types.get(kind)
        if t and t["kind"] == "ENUM":
            if v.kind not in ("enum", "string") or v.value not in [x["name"] for x in t["enumValues"]]:
                raise bad
            return
        try:
            if kind in SPARK:
                coerce(v.value, v.kind, kind)
        except Unfit:
            raise bad from None

    def validate(self, selections: list[Selection], owner: str) -> None:
        for s in selections:
            inner = self.value_type(owner, s.name)
            allowed = {"includeDeprecated": "Boolean"} if owner == "__Type" and s.name in ("fields", "enumValues") else self.arguments(owner, s.name)
            for name, v in s.arguments.items():
                if name not in allowed:
                    raise DocumentError(f'Unknown argument "{name}" on field "{s.name}" of type "{owner}"', s.location)
                if name == "order" and v.kind != "list":
                    continue  # an error of this field when it runs, not of the document
                self.check_value(v, allowed[name], name)
            if inner is None and s.children:
                raise DocumentError(f'Field "{s.name}" must not have a selection', s.location)
            if inner is not None:
                if not s.children:
                    raise DocumentError(f'Field "{s.name}" of type "{inner}" must have a selection', s.location)
                self.validate(s.children, inner)

    # -- introspection -------------------------------------------------------

    def introspect(self, selection: Selection) -> Any:
        if selection.name == "__type":
            t = self.types.get(selection.arguments["name"].value)
            return None if t is None else self._shown(t, "__Type", selection.children)
        return self._shown({}, "__Schema", selection.children)

    def _ref(self, kind: str) -> dict[str, Any]:
        if kind.endswith("!"):
            return {"kind": "NON_NULL", "name": None, "ofType": kind[:-1]}
        if kind.startswith("["):
            return {"kind": "LIST", "name": None, "ofType": kind[1:-1]}
        return self.types.get(kind, {"kind": "SCALAR", "name": kind, "description": None})

    def _shown(self, x: dict[str, Any], owner: str, children: list[Selection]) -> dict[str, Any]:
        out = {}
        for s in children:
            inner = META[owner].get(s.name) if s.name != "__typename" else None
            if s.name == "__typename":
                v: Any = owner
            elif owner == "__Schema":
                v = {
                    "types": list(self.types.values()),
                    "queryType": self.types["Query"],
                    "mutationType": self.types.get("Mutation"),
                    "subscriptionType": None,
                    "directives": [{"name": n, "description": None, "locations": ["FIELD", "FRAGMENT_SPREAD", "INLINE_FRAGMENT"], "args": [{"name": "if", "description": None, "type": "Boolean!", "defaultValue": None}]} for n in ("include", "skip")],
                }[s.name]
            else:
                v = x.get(s.name)
                if s.name in ("fields", "enumValues") and v is not None:
                    flag = s.arguments.get("includeDeprecated")
                    v = [f for f in v if not f["isDeprecated"] or (flag is not None and flag.value)]
            if isinstance(v, str) and inner == "__Type":
                v = self._ref(v)
            if inner is not None and v is not None:
                v = [self._shown(i, inner, s.children) for i in v] if isinstance(v, list) else self._shown(v, inner, s.children)
            out[s.key] = v
        return out

    def sdl(self) -> str:
        """The schema as text."""
        out = []
        for t in self.types.values():
            head = f'"""{t["description"]}"""\n' if t.get("description") else ""
            if t["kind"] == "SCALAR":
                if t["name"] not in ("Int", "String", "Boolean", "Float", "ID"):
                    out.append(f"{head}scalar {t['name']}")
            elif t["kind"] == "ENUM":
                out.append(f"{head}enum {t['name']} {{\n" + "".join(f"  {v['name']}\n" for v in t["enumValues"]) + "}")
            else:
                lines = []
                for f in t.get("fields") or t["inputFields"]:
                    args = ", ".join(f"{a['name']}: {a['type']}" for a in f.get("args", []))
                    old = f" @deprecated(reason: \"{f['deprecationReason']}\")" if f.get("isDeprecated") else ""
                    lines.append(f"  {f['name']}{f'({args})' if args else ''}: {f['type']}{old}\n")
                out.append(f"{head}{'type' if t['kind'] == 'OBJECT' else 'input'} {t['name']} {{\n{''.join(lines)}}}")
        return "\n\n".join(out) + "\n"


#: Types of introspection's own fields; None for scalars.
META: dict[str, dict[str, str | None]] = {
    "__Schema": {"types": "__Type", "queryType": "__Type", "mutationType": "__Type", "subscriptionType": "__Type", "directives": "__Directive"},
    "__Type": {"kind": None, "name": None, "description": None, "fields": "__Field", "interfaces": "__Type", "possibleTypes": "__Type", "enumValues": "__EnumValue", "inputFields": "__InputValue", "ofType": "__Type"},
    "__Field": {"name": None, "description": None, "args": "__InputValue", "type": "__Type", "isDeprecated": None, "deprecationReason": None},
    "__InputValue": {"name": None, "description": None, "type": "__Type", "defaultValue": None},
    "__EnumValue": {"name": None, "description": None, "isDeprecated": None, "deprecationReason": None},
    "__Directive": {"name": None, "description": None, "locations": None, "args": "__InputValue"},
}


def inputs_of(entity: Entity, *, keys: bool) -> tuple[InputField, ...]:
    """Input fields from an entity's columns: with its keys for a change, without a single generated one for a new row."""
    from nestql.functions.naming import camel

    out = []
    for f in entity.columns:
        is_key = f.source in entity.primary_key
        if not keys and is_key and len(entity.primary_key) == 1:
            continue
        out.append(InputField(camel(f.source), f.source, f.type, is_key if keys else not f.nullable))
    return tuple(out)
