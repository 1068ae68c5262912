"""Nesting: rows as objects of their parents, groups of rows as their lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest_object(parent: DataFrame, fk: str, child: DataFrame, key: str, fields: list[Column], out: str) -> DataFrame:
    """``out``: the child row whose ``key`` is the parent's ``fk``, as a struct; null if there is none."""
    child = child.select(F.col(key).alias(f"{out}_k"), F.struct(*fields).alias(out))
    return parent.join(child, F.col(fk) == F.col(f"{out}_k"), "left").drop(f"{out}_k")


def nest_list(parent: DataFrame, key: str, child: DataFrame, fk: str, sort: list[str], fields: list[Column], out: str) -> DataFrame:
    """``out``: the child rows whose ``fk`` is the parent's ``key``, as structs in order; empty if there are none.

    Children are gathered by key before the join, so lists of one parent never multiply.
    """
    row = F.struct(*[F.col(c) for c in sort], F.struct(*fields).alias("v"))
    kids = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(f"{out}_k")).agg(F.array_sort(F.collect_list(row)).alias(out))
    kids = kids.withColumn(out, F.transform(out, lambda r: r["v"]))
    joined = parent.join(kids, F.col(key) == F.col(f"{out}_k"), "left").drop(f"{out}_k")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(kids.schema[out].dataType)))
