"""Putting one-row tables side by side without a join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def beside(*tables: DataFrame) -> DataFrame:
    """The columns of several one-row tables in one row.

    Each table becomes one struct; a union of those few rows is folded into one. Every table is
    computed once, which a scalar subquery per column would not give.
    """
    packed = [t.select(F.struct(*t.columns).alias(f"_{i}")) for i, t in enumerate(tables)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    names = [f"_{i}" for i in range(len(tables))]
    folded = rows.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return folded.select(*[f"{n}.*" for n in names])
