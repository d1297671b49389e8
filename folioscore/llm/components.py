"""Connected components of a table of edges, by alternating large and small stars.

Each round points neighbours at the smallest id near them. A node's smallest neighbour is an
aggregate with map-side combining, and the join that hands it out is an ordinary one that AQE can
split, so a hub with a third of all edges is never gathered in one task. Rounds end when a
round changes nothing; their number grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscore.llm.common import cut


def _smallest(pairs: DataFrame) -> DataFrame:
    """For rows (u, v): each u with the smallest of itself and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def _with_smallest(pairs: DataFrame) -> DataFrame:
    return pairs.join(_smallest(pairs), F.col("u") == F.col("k")).drop("k")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node with an edge to another; component is its smallest node.

    Ids may be of any type with an order. Loops and repeated or reversed edges do no harm; edges
    with a null end are ignored. No edges, no rows.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    pairs = cut(start.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        held = _with_smallest(large)
        small = held.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(held.select("u", F.col("m").alias("v")))
        pairs = cut(small.filter("u <> v").distinct())
