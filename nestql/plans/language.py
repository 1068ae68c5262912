"""Documents: lexer and parser for the graph query language."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from nestql.errors import DocumentError

Location = tuple[int, int]


@dataclass
class Value:
    """kind: int, float, string, boolean, null, enum, list, object or variable."""

    kind: str
    value: Any
    location: Location | None = None


@dataclass
class Directive:
    name: str
    arguments: dict[str, Value]


@dataclass
class FieldNode:
    name: str
    alias: str | None
    arguments: dict[str, Value]
    directives: list[Directive]
    selections: list[Any]
    location: Location

    @property
    def key(self) -> str:
        return self.alias or self.name


@dataclass
class Spread:
    name: str
    directives: list[Directive]
    location: Location


@dataclass
class Inline:
    on: str | None
    directives: list[Directive]
    selections: list[Any]


@dataclass
class Variable:
    name: str
    type: str
    default: Value | None
    location: Location


@dataclass
class Operation:
    kind: str
    name: str | None
    variables: list[Variable]
    selections: list[Any]


@dataclass
class Fragment:
    name: str
    on: str
    selections: list[Any]


@dataclass
class Document:
    operations: list[Operation] = field(default_factory=list)
    fragments: dict[str, Fragment] = field(default_factory=dict)

    def operation(self, name: str | None = None) -> Operation:
        if name is not None:
            for o in self.operations:
                if o.name == name:
                    return o
            raise DocumentError(f"Unknown operation named {name}")
        if len(self.operations) != 1:
            raise DocumentError("Must provide operation name if query contains multiple operations" if self.operations else "Must provide an operation")
        return self.operations[0]


_TOKEN = re.compile(
    r"""(?P<skip>[\s,﻿]+|\#[^\n\r]*)
    |(?P<spread>\.\.\.)
    |(?P<punct>[!$():=@\[\]{}|&])
    |(?P<name>[_A-Za-z][_0-9A-Za-z]*)
    |(?P<float>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+))
    |(?P<int>-?(?:0|[1-9][0-9]*))
    |(?P<block>\"\"\"(?:[^"\\]|\\.|\"(?!\"\"))*\"\"\")
    |(?P<string>"(?:[^"\\\n\r]|\\.)*")""",
    re.X | re.S,
)


def _block(raw: str) -> str:
    """A block string without its common indent and blank first and last lines."""
    lines = raw.replace('\\"""', '"""').splitlines()
    indents = [len(x) - len(x.lstrip(" \t")) for x in lines[1:] if x.strip(" \t")]
    if indents:
        lines = lines[:1] + [x[min(indents) :] for x in lines[1:]]
    while lines and not lines[0].strip(" \t"):
        lines.pop(0)
    while lines and not lines[-1].strip(" \t"):
        lines.pop()
    return "\n".join(lines)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, Location]] = []
        at, line, start = 0, 1, 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise DocumentError(f"Unexpected character {text[at]!r}", (line, at - start + 1))
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup or "", m[0], (line, at - start + 1)))
            for nl in re.finditer(r"\n", m[0]):
                line, start = line + 1, at + nl.end()
            at = m.end()
        self.tokens.append(("end", "", (line, len(text) - start + 1)))
        self.at = 0

    @property
    def peek(self) -> tuple[str, str, Location]:
        return self.tokens[self.at]

    def take(self, text: str | None = None, kind: str | None = None) -> str:
        k, s, where = self.peek
        if (text is not None and (s != text or k in ("string", "block"))) or (kind is not None and k != kind):
            raise DocumentError(f"Unexpected {s!r}" if k != "end" else "Unexpected end of input", where)
        self.at += 1
        return s

    def maybe(self, text: str) -> bool:
        if self.peek[1] == text and self.peek[0] in ("punct", "name", "spread"):
            self.at += 1
            return True
        return False

    def document(self) -> Document:
        doc = Document()
        while self.peek[0] != "end":
            if self.peek[1] == "{":
                doc.operations.append(Operation("query", None, [], self.selections()))
            elif self.peek[1] == "fragment":
                self.take()
                name = self.take(kind="name")
                self.take("on")
                on = self.take(kind="name")
                self.directives()
                doc.fragments[name] = Fragment(name, on, self.selections())
            elif self.peek[1] in ("query", "mutation", "subscription"):
                kind = self.take()
                name = self.take(kind="name") if self.peek[0] == "name" else None
                variables = self.variables()
                self.directives()
                doc.operations.append(Operation(kind, name, variables, self.selections()))
            else:
                raise DocumentError(f"Unexpected {self.peek[1]!r}", self.peek[2])
        return doc

    def variables(self) -> list[Variable]:
        out: list[Variable] = []
        if self.maybe("("):
            while not self.maybe(")"):
                where = self.peek[2]
                self.take("$")
                name = self.take(kind="name")
                self.take(":")
                kind = self.type()
                out.append(Variable(name, kind, self.value() if self.maybe("=") else None, where))
        return out

    def type(self) -> str:
        if self.maybe("["):
            inner = self.type()
            self.take("]")
            out = f"[{inner}]"
        else:
            out = self.take(kind="name")
        return out + "!" if self.maybe("!") else out

    def directives(self) -> list[Directive]:
        out = []
        while self.maybe("@"):
            out.append(Directive(self.take(kind="name"), self.arguments()))
        return out

    def arguments(self) -> dict[str, Value]:
        out: dict[str, Value] = {}
        if self.maybe("("):
            while not self.maybe(")"):
                where, name = self.peek[2], self.take(kind="name")
                self.take(":")
                if name in out:
                    raise DocumentError(f"Argument {name} is given twice", where)
                out[name] = self.value()
        return out

    def selections(self) -> list[Any]:
        out: list[Any] = []
        self.take("{")
        while not self.maybe("}"):
            where = self.peek[2]
            if self.maybe("..."):
                if self.peek[0] == "name" and self.peek[1] != "on":
                    out.append(Spread(self.take(), self.directives(), where))
                else:
                    on = self.take(kind="name") if self.maybe("on") else None
                    out.append(Inline(on, self.directives(), self.selections()))
                continue
            name, alias = self.take(kind="name"), None
            if self.maybe(":"):
                alias, name = name, self.take(kind="name")
            arguments, directives = self.arguments(), self.directives()
            out.append(FieldNode(name, alias, arguments, directives, self.selections() if self.peek[1] == "{" else [], where))
        if not out:
            raise DocumentError("A selection is empty", self.peek[2])
        return out

    def value(self) -> Value:
        kind, s, where = self.peek
        if kind == "int":
            self.take()
            return Value("int", int(s), where)
        if kind == "float":
            self.take()
            return Value("float", float(s), where)
        if kind == "string":
            self.take()
            try:
                return Value("string", json.loads(s), where)
            except ValueError:
                raise DocumentError(f"Malformed string {s}", where) from None
        if kind == "block":
            self.take()
            return Value("string", _block(s[3:-3]), where)
        if self.maybe("$"):
            return Value("variable", self.take(kind="name"), where)
        if self.maybe("["):
            items = []
            while not self.maybe("]"):
                items.append(self.value())
            return Value("list", items, where)
        if self.maybe("{"):
            members: dict[str, Value] = {}
            while not self.maybe("}"):
                at, name = self.peek[2], self.take(kind="name")
                self.take(":")
                if name in members:
                    raise DocumentError(f"Member {name} is given twice", at)
                members[name] = self.value()
            return Value("object", members, where)
        name = self.take(kind="name")
        if name in ("true", "false"):
            return Value("boolean", name == "true", where)
        return Value("null", None, where) if name == "null" else Value("enum", name, where)


def parse(text: str) -> Document:
    return Parser(text).document()


def value_of(x: Any) -> Value:
    """A JSON value as a literal."""
    if x is None:
        return Value("null", None)
    if isinstance(x, bool):
        return Value("boolean", x)
    if isinstance(x, int):
        return Value("int", x) if -(1 << 63) <= x < 1 << 63 else Value("float", float(x))
    if isinstance(x, float):
        return Value("float", x)
    if isinstance(x, str):
        return Value("string", x)
    if isinstance(x, (list, tuple)):
        return Value("list", [value_of(v) for v in x])
    return Value("object", {k: value_of(v) for k, v in x.items()})
