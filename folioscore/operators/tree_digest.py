"""An order-sensitive digest of a table of any size: a hash tree over its sorted rows.

The published digest of a set is one hash over all lines in order, which is sequential
(`fingerprints.ordered_digest`). Here every line is a leaf, and every `fanout` consecutive nodes
become their parent, so all tasks share the work and each level is smaller than the one below by
the fanout. Two tables have the same digest if they hold the same lines in the same order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from folioscore.functions.digests import canonical_json
from folioscore.operators.fingerprints import evaluation_line
from folioscore.operators.ordering import global_position

FANOUT = 256


def trees(df: DataFrame, order_by: Sequence[str], lines: dict[str, Column], fanout: int = FANOUT) -> tuple[dict[str, list[DataFrame]], int]:
    """(for each line the levels from the leaves to the root, the number of rows).

    Every level has `place` and `digest`, 32 bytes, and those above the leaves the `run` of nodes that each
    one is made of. The rows are sorted once for all lines, and only digests are kept of them; rows
    that share a key are ordered by their digests.
    """
    leaves = df.select(*order_by, *[F.unhex(F.sha2(line, 256)).alias(name) for name, line in lines.items()])
    placed = global_position(leaves, [F.col(c) for c in (*order_by, *lines)], "place", keep=list(lines))
    rows = placed.count()
    levels = {name: [placed.select((F.col("place") - 1).alias("place"), F.col(name).alias("digest"))] for name in lines}
    for mine in levels.values():
        left = rows
        while left > 1:
            parts = F.array_sort(F.collect_list(F.struct("place", "digest")))
            nodes = mine[-1].groupBy(F.floor(F.col("place") / fanout).alias("place")).agg(parts.alias("run"))
            joined = F.array_join(F.transform("run", lambda n: F.lower(F.hex(n["digest"]))), "")
            mine.append(nodes.select("place", F.unhex(F.sha2(joined, 256)).alias("digest"), "run"))
            left = -(-left // fanout)
    return levels, rows


def tree_levels(df: DataFrame, order_by: Sequence[str], line: Column, fanout: int = FANOUT) -> tuple[list[DataFrame], int]:
    """(levels from the leaves to the root, each with `place` and `digest`; the number of rows)."""
    levels, rows = trees(df, order_by, {"digest": line}, fanout)
    return levels["digest"], rows


def tree_digest(df: DataFrame, order_by: Sequence[str], line: Column, fanout: int = FANOUT) -> DataFrame:
    """One row: n_rows and root; an empty table has the hash of an empty text."""
    levels, rows = tree_levels(df, order_by, line, fanout)
    root = F.coalesce(F.lower(F.hex(F.max("digest"))), F.sha2(F.lit(""), 256))
    return levels[-1].agg(F.lit(rows).cast("long").alias("n_rows"), root.alias("root"))


def evaluation_set_tree(df: DataFrame) -> DataFrame:
    """Identity of an evaluation set, rows in the order of their sample ids."""
    return tree_digest(df, ["sample_id"], evaluation_line())


def inventory_tree(files: DataFrame) -> DataFrame:
    """Identity of a folder: path, hash and size of each file in path order."""
    line = canonical_json(path=F.col("path"), sha256=F.col("sha256"), size_bytes=F.col("size_bytes"))
    return tree_digest(files, ["path"], line)


def changed_places(left: list[DataFrame], right: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Places of leaves that differ between two trees of one size, found from the root down.

    Only nodes under a differing parent are looked at, so for few changes each level costs one
    join with few rows, and equal parts of the tables are never compared. A node holds the digests
    it is made of, so the leaves themselves are not read again.
    """
    if len(left) != len(right):
        raise ValueError("trees of different height: compare the tables by their rows")
    found = None
    for a, b in zip(reversed(left), reversed(right)):
        if found is not None and "run" not in a.columns:
            return found
        if found is not None:
            a, b = (side.join(found, "place", "left_semi") for side in (a, b))
        b = b.withColumnsRenamed({"digest": "other", "run": "others"})
        pairs = a.join(b, "place", "full").filter(~F.col("digest").eqNullSafe(F.col("other")))
        if "run" not in a.columns:
            return pairs.select("place")
        # The places of a run follow one another, so equal positions are equal places.
        none = lambda name: F.filter(name, lambda n: F.lit(False))
        both = F.arrays_zip(F.coalesce("run", none("others")).alias("a"), F.coalesce("others", none("run")).alias("b"))
        changed = F.filter(both, lambda n: ~n["a"]["digest"].eqNullSafe(n["b"]["digest"]))
        found = pairs.select(F.explode(F.transform(changed, lambda n: F.coalesce(n["a"]["place"], n["b"]["place"]))).alias("place"))
    return found
