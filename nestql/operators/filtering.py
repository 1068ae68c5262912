"""Filters: comparisons as columns, relation filters as semi- and anti-joins.

A relation filter among the ANDed parts of a filter is a left semi-join, its
negation an anti-join, so that neither side is ever collected or broadcast
unless Spark measures it to be small. Elsewhere (under OR, or deeper under NOT)
it is an IN subquery, which Catalyst turns into an existence join.

SQL's NOT IN is null-aware. Where nulls may occur, the anti-join on equality
is completed by a scalar subquery that counts the keys and their nulls: a null
among the keys lets no row through, and no keys at all let every row through,
nulls too.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestql.functions.scalars import literal
from nestql.plans.predicate import And, Cmp, Custom, InRelation, IsNull, Not, Or

KEY = "__nql_key"


class Filters:
    """Applies predicates; ``rows_of(entity)`` gives an entity's rows."""

    def __init__(self, rows_of):
        self.rows_of = rows_of

    def column(self, p: Any) -> Column:
        if isinstance(p, Cmp):
            c = F.col(f"`{p.column}`")
            if p.op == "eq_any":
                return reduce(lambda a, b: a | b, [c == literal(v, p.type) for v in p.value]) if isinstance(p.type, str) and p.type.startswith("[") and p.value else c.isin([literal(v, p.type) for v in p.value]) if p.value else F.lit(False)
            if p.op == "like":
                return c.like(p.value)
            return c == literal(p.value, p.type) if p.op == "eq" else c != literal(p.value, p.type)
        if isinstance(p, IsNull):
            c = F.col(f"`{p.column}`")
            return c.isNotNull() if p.negated else c.isNull()
        if isinstance(p, And):
            return reduce(lambda a, b: a & b, map(self.column, p.parts))
        if isinstance(p, Or):
            return reduce(lambda a, b: a | b, map(self.column, p.parts))
        if isinstance(p, Not):
            return ~self.column(p.part)
        if isinstance(p, InRelation):
            return F.col(f"`{p.column}`").isin(self.keys(p))
        assert isinstance(p, Custom)
        return p.build()

    def keys(self, p: InRelation) -> DataFrame:
        return self.apply(self.rows_of(p.entity), p.part).select(F.col(f"`{p.key}`").alias(KEY))

    def apply(self, df: DataFrame, p: Any) -> DataFrame:
        if p is None:
            return df
        parts = p.parts if isinstance(p, And) else (p,)
        plain = [x for x in parts if not isinstance(x, InRelation) and not (isinstance(x, Not) and isinstance(x.part, InRelation))]
        if plain:
            df = df.filter(reduce(lambda a, b: a & b, map(self.column, plain)))
        for x in parts:
            if isinstance(x, InRelation):
                df = self.semi(df, x)
            elif isinstance(x, Not) and isinstance(x.part, InRelation):
                df = self.anti(df, x.part)
        return df

    def semi(self, df: DataFrame, p: InRelation) -> DataFrame:
        return df.join(self.keys(p), F.col(f"`{p.column}`") == F.col(KEY), "left_semi")

    def anti(self, df: DataFrame, p: InRelation) -> DataFrame:
        keys, c = self.keys(p), F.col(f"`{p.column}`")
        out = df.join(keys, c == F.col(KEY), "left_anti")
        if not (p.column_nullable or p.key_nullable):
            return out
        # what a row needs, by one pass over the keys: nothing if there are none, a value, or more than it can have if one is null
        n, nulls = F.count("*"), F.count("*") - F.count(KEY)
        needs = keys.agg(F.when(n == 0, 0).when(nulls == 0, 1).otherwise(2)).scalar()
        return out.filter(F.when(c.isNotNull(), 1).otherwise(0) >= needs)
