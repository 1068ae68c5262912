import pytest

from nestql.errors import DocumentError
from nestql.plans.language import parse


def test_documents():
    doc = parse(
        '''# a comment
        query Q($a: [Int!]! = [1, 2], $b: String) @x { a: f(n: -1, d: 1.5e3, s: "t\\n\\u00e9", e: ENUM, n2: null, t: true, l: [], o: {k: $b}) { id, ...F ... on T @include(if: $b) { x } } }
        fragment F on T { y }
        mutation { m }'''
    )
    q = doc.operation("Q")
    assert [(v.name, v.type) for v in q.variables] == [("a", "[Int!]!"), ("b", "String")]
    f = q.selections[0]
    assert (f.key, f.name) == ("a", "f")
    assert {k: (v.kind, v.value) for k, v in f.arguments.items() if v.kind not in ("list", "object")} == {"n": ("int", -1), "d": ("float", 1500.0), "s": ("string", "t\né"), "e": ("enum", "ENUM"), "n2": ("null", None), "t": ("boolean", True)}
    assert f.arguments["o"].value["k"].kind == "variable" and f.arguments["l"].value == []
    assert doc.fragments["F"].on == "T" and doc.operations[1].kind == "mutation"
    assert parse('{ f(s: """\n    one\n      two\n  """) }').operations[0].selections[0].arguments["s"].value == "one\n  two"
    assert parse("{\n  f }").operations[0].selections[0].location == (2, 3)


@pytest.mark.parametrize("text", ["{", "{}", "{ f( }", "{ f(a: ) }", "{ f(a: 1, a: 2) }", "query {", "x", '{ f(s: "a\n") }', "{ f(a: {b: 1, b: 2}) }", "{ a: }", "{ ?", "{ f(x: $) }"])
def test_malformed(text):
    with pytest.raises(DocumentError):
        parse(text)


def test_operations_are_chosen_by_name():
    doc = parse("query A { a } query B { b }")
    assert doc.operation("B").selections[0].name == "b"
    for name in (None, "C"):
        with pytest.raises(DocumentError):
            doc.operation(name)
