"""Order, offset and limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_keys(order: list[tuple[str, bool]], nulls_first: bool) -> list[Column]:
    """order: (column, descending). Nulls are smallest if nulls_first, else largest."""
    out = []
    for name, descending in order:
        c = F.col(f"`{name}`")
        if descending:
            out.append(c.desc_nulls_last() if nulls_first else c.desc_nulls_first())
        else:
            out.append(c.asc_nulls_first() if nulls_first else c.asc_nulls_last())
    return out


def window(df: DataFrame, order: list[tuple[str, bool]], offset: int | None, limit: int | None, nulls_first: bool) -> DataFrame:
    """Sort, skip, take; a limit on a sort is a distributed top-k."""
    if order:
        df = df.orderBy(*sort_keys(order, nulls_first))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
