"""Registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscore.queries.inputs import Inputs, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as sums of doubles depend on their order; arrays of text joined."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        c = F.col(f"`{field.name}`")
        if kind == "double":
            c = F.round(c, digits)
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, *needs: str, sql: str | None = None):
    """Registers `fn(inputs)` under a name, with the oracle over the named derivations."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(fn(Inputs(spark, folder)))
        if sql:
            ORACLES[name] = oracle(sql, *needs)
        return fn

    return register


def tree_sql(line: str, key: str, table: str, fanout: int = 256) -> str:
    """n_rows and root of a hash tree over the lines of a table in the order of a key."""
    return f"""SELECT * FROM (WITH RECURSIVE n(level, place, h) AS (
        SELECT 0::BIGINT, row_number() OVER (ORDER BY {key}, d)-1, d FROM (SELECT {key}, sha256({line}) AS d FROM {table})
        UNION ALL SELECT level+1, place//{fanout}, sha256(string_agg(h, '' ORDER BY place))
          FROM (SELECT *, count(*) OVER () AS c FROM n) WHERE c>1 GROUP BY level, place//{fanout})
      SELECT (SELECT count(*) FROM {table}) AS n_rows, h AS root FROM n ORDER BY level DESC LIMIT 1)"""
