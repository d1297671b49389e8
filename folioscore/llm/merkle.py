"""A Merkle manifest of a table: subroots per language, one root, and a proof for every row.

Every row is a leaf. The leaves of a language stand in the order of their ids; every 8
consecutive nodes become their parent until one is left, the language's subroot, and the subroots
give the root in the same way.

The tree is persistent. Leaves are dealt into aligned blocks of 8**4; one task holds a block's
nodes. A changed leaf makes a new version of the block: only the leaf's ancestors are copied, all
other nodes are shared. The block roots are the leaves of the next blocks, so the upper tree is
distributed like the lower one, and each block gets the siblings on its own way to the root: along
these every version goes on, in the task of its block, until it has a root of its own. No task
holds more than one block and one path, however large the language.

Defined results: a null value is `-` in a leaf; rows without an id come first in their language
and are never tampered with by the query; rows that repeat an id are ordered by their leaf, equal
ones by their place in the stored leaves, and each is a leaf; null is a language of its own, before
all others; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.llm.common import cut
from folioscore.operators.ordering import global_position

FANOUT = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NODES = "tree string, place long, total long, leaf string"
PATH = "tree string, place long, befores array<string>, afters array<string>, subroot string, root string"
PROOFS = (
    "tree string, place long, doc_id long, leaf string, proof string, subroot string, root string, folded_root string"
)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(docs: DataFrame, fields=FIELDS, **replaced: Column) -> Column:
    """The leaf of a row, with some columns replaced."""
    return F.sha2(F.concat(*[field(replaced.get(name, docs[name])) for name in fields]), 256)


def small_letters(text: Column) -> Column:
    """Only A-Z become small."""
    return F.translate(text, CAPITALS, CAPITALS.lower())


class PersistentTree:
    """One block: nodes are never changed, a version is the node that is its root.

    `whole` says that the block is its tree's only one: then it is folded until one node is left.
    A block among others is folded `levels` times, also where one node is left before.
    """

    def __init__(self, leaves: list[str], whole: bool, levels: int = LEVELS, fanout: int = FANOUT):
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.rows = [list(range(len(leaves)))]
        self.fanout = fanout
        while len(self.rows[-1]) > 1 if whole else len(self.rows) <= levels:
            below = self.rows[-1]
            self.rows.append([self._node(tuple(below[i:i + fanout])) for i in range(0, len(below), fanout)])
        self.root = self.rows[-1][0]

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join([self.digests[c] for c in children])))
        self.children.append(children)
        return len(self.digests) - 1

    def version(self, place: int, leaf: str) -> int:
        """The root of a version with one leaf replaced: its ancestors are copied, all else shared."""
        self.digests.append(leaf)
        self.children.append(())
        node = len(self.digests) - 1
        for row in self.rows[1:]:
            place, own = divmod(place, self.fanout)
            children = self.children[row[place]]
            node = self._node((*children[:own], node, *children[own + 1:]))
        return node

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """(those before, those after) of each node on the way from a leaf to the block's root."""
        out = []
        for row in self.rows[1:]:
            place, own = divmod(place, self.fanout)
            near = [self.digests[c] for c in self.children[row[place]]]
            out.append(("".join(near[:own]), "".join(near[own + 1:])))
        return out


def _tree(rows: pd.DataFrame, column: str, size: int, levels: int, fanout: int) -> PersistentTree:
    return PersistentTree(rows[column].tolist(), int(rows["total"].iloc[0]) <= size, levels, fanout)


def _block_roots(levels: int, fanout: int):
    size = fanout**levels

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        tree = _tree(rows, "leaf", size, levels, fanout)
        total = -(-int(rows["total"].iloc[0]) // size)
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "place": rows["place"].iloc[:1] // size, "total": total, "leaf": tree.digests[tree.root]})

    return run


def _paths_below(levels: int, fanout: int):
    """The paths of a block's nodes: their siblings in the block, then those of the block."""

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        tree = _tree(rows, "leaf", fanout**levels, levels, fanout)
        befores, afters = list(above["befores"].iloc[0]), list(above["afters"].iloc[0])
        near = [tree.siblings(i) for i in range(len(rows))]
        return pd.DataFrame({
            "tree": rows["tree"], "place": rows["place"],
            "befores": [[b for b, _ in n] + befores for n in near], "afters": [[a for _, a in n] + afters for n in near],
            "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0],
        })

    return run


def _versions(levels: int, fanout: int):
    """The proof of every leaf of a block, and the root of the version its leaf leads to."""

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place").reset_index(drop=True)
        tree = _tree(rows, "leaf", fanout**levels, levels, fanout)
        upper = list(zip(above["befores"].iloc[0], above["afters"].iloc[0]))
        beyond = "".join(b + a for b, a in upper)
        proofs, folded = [], []
        for i, (leaf, changed) in enumerate(zip(rows["leaf"], rows["changed"])):
            proofs.append("".join([b + a for b, a in tree.siblings(i)]) + beyond)
            node = tree.digests[tree.version(i, leaf if changed is None else changed)]
            for before, after in upper:
                node = digest(before + node + after)
            folded.append(node)
        return rows.drop(columns=["total", "changed"]).assign(
            proof=proofs, subroot=above["subroot"].iloc[0], root=above["root"].iloc[0], folded_root=folded
        )

    return run


def placed_leaves(docs: DataFrame, changed: Column | None, id_column: str, group_column: str, fields) -> DataFrame:
    """Leaves with their place in their tree and the tree's number of leaves."""
    group = docs[group_column].cast("string")
    leaves = cut(docs.select(
        # Null first, then bytewise.
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"), docs[id_column].cast("long").alias("doc_id"),
        leaf_of(docs, fields).alias("leaf"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )).withColumn("row", F.monotonically_increasing_id())
    order = ["tree", "doc_id", "leaf", "row"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    # Stored, because places are only right if every pass sees the same bounds.
    ranged = cut(ranged.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    # One row per partition, and one more per tree.
    shares = ranged.groupBy("part", "tree").agg(F.min("seq").alias("first"), F.count("*").alias("held"))
    per_tree = W.partitionBy("tree")
    earlier = per_tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = shares.select(
        "part", "tree", (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(per_tree).alias("total"),
    )
    joined = ranged.join(starts, ["part", "tree"])
    return joined.select("tree", (F.col("seq") + F.col("shift")).alias("place"), "total", "doc_id", "leaf", "changed")


def merkle_manifest(
    docs: DataFrame, changed: Column | None = None, *, id_column: str = "doc_id", group_column: str = "lang",
    fields=FIELDS, levels: int = LEVELS, fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of `docs`: its tree (`=` and the group, empty for null), place, id, leaf,
    proof (the siblings' digests, from the leaf up), subroot, root, and the root of the version in
    which `changed`, a leaf or null, stands for its leaf.
    """
    size = fanout**levels
    block = F.floor(F.col("place") / size).alias("block")
    leaves = placed_leaves(docs, changed, id_column, group_column, fields)
    # The number of blocks on the way up: one number.
    most = leaves.agg(F.max("total")).first()[0] or 1
    stages = [leaves]
    while True:
        below = stages[-1].select("tree", "place", "total", "leaf")
        stages.append(cut(below.groupBy("tree", block).applyInPandas(_block_roots(levels, fanout), NODES)))
        most = -(-most // size)
        if most <= 1:
            break
    subroots = stages.pop()
    paths = _root_paths(subroots, levels, fanout, block)
    for nodes in reversed(stages[1:]):
        above = paths.groupBy("tree", F.col("place").alias("block"))
        paths = nodes.groupBy("tree", block).cogroup(above).applyInPandas(_paths_below(levels, fanout), PATH)
    above = cut(paths).groupBy("tree", F.col("place").alias("block"))
    return leaves.groupBy("tree", block).cogroup(above).applyInPandas(_versions(levels, fanout), PROOFS)


def _root_paths(subroots: DataFrame, levels: int, fanout: int, block: Column) -> DataFrame:
    """The way of each tree's subroot to the root: the same folding, over one row per tree."""
    size = fanout**levels
    ordered = global_position(subroots.select("tree", "leaf"), [F.col("tree")], "place")
    trees = ordered.count()
    nodes = cut(ordered.select(
        F.lit("").alias("tree"), (F.col("place") - 1).alias("place"), F.lit(trees).cast("long").alias("total"), "leaf", F.col("tree").alias("name"),
    ))
    stages, most = [nodes], trees
    while True:
        below = stages[-1].select("tree", "place", "total", "leaf")
        stages.append(cut(below.groupBy("tree", block).applyInPandas(_block_roots(levels, fanout), NODES)))
        most = -(-most // size)
        if most <= 1:
            break
    none = F.array().cast("array<string>")
    paths = stages.pop().select("tree", "place", none.alias("befores"), none.alias("afters"), F.lit("").alias("subroot"), F.col("leaf").alias("root"))
    for level in reversed(stages):
        above = paths.groupBy("tree", F.col("place").alias("block"))
        paths = level.select("tree", "place", "total", "leaf").groupBy("tree", block).cogroup(above).applyInPandas(_paths_below(levels, fanout), PATH)
    # A subroot is the only node of its tree, at place 0.
    return paths.select("place", "befores", "afters", "root").join(nodes.select("place", "name", "leaf"), "place").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "befores", "afters", F.col("leaf").alias("subroot"), "root"
    )


def _field_sql(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


def _leaf_sql(text: str = "text") -> str:
    return "sha256(" + " || ".join(_field_sql(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _climb_sql(start: str, leaves: str, at: str) -> str:
    """Common tables: nodes `n{at}`, nodes with siblings `s{at}`, and rows at every level `r{at}`."""
    run = "PARTITION BY level, tree, place // 8 ORDER BY place ROWS BETWEEN"
    return f"""
n{at}(level, tree, place, h) AS (
  {leaves} UNION ALL
  SELECT level + 1, tree, place // 8, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM n{at}) WHERE c > 1 GROUP BY level, tree, place // 8),
s{at} AS (
  SELECT *, count(*) OVER (PARTITION BY level, tree) AS c,
         coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM n{at}),
r{at}(doc_id, leaf, level, tree, place, cur, proof) AS (
  {start} UNION ALL
  SELECT r.doc_id, r.leaf, r.level + 1, r.tree, r.place // 8, sha256(before || cur || after), proof || before || after
  FROM r{at} r JOIN s{at} s ON s.level = r.level AND s.tree = r.tree AND s.place = r.place WHERE s.c > 1),
t{at} AS (
  SELECT r.*, s.h FROM r{at} r JOIN s{at} s ON s.level = r.level AND s.tree = r.tree AND s.place = r.place WHERE s.c = 1)"""


# The checksum is written out over a table made by its rule. Rows then climb a level in each step,
# first to the subroots, then to the root.
ORACLE = f"""
WITH RECURSIVE
crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) t(i))),
b AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql()} AS leaf,
         CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1])), 4294967295) % 3 = 0
              THEN {_leaf_sql(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")} END AS changed
  FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM b),
{_climb_sql(
    "SELECT doc_id, leaf, 0::BIGINT, tree, place, coalesce(changed, leaf), '' FROM l", "SELECT 0::BIGINT, tree, place, leaf FROM l", "1"
).strip()},
m AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place, h FROM s1 WHERE c = 1),
{_climb_sql(
    "SELECT t.doc_id, t.leaf || t.h, 0::BIGINT, '', m.place, t.cur, t.proof FROM t1 t JOIN m USING (tree)", "SELECT 0::BIGINT, '', place, h FROM m", "2"
).strip()}
SELECT doc_id, substr(leaf, 1, 64) AS leaf, substr(leaf, 65) AS subroot, h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = h AS verified
FROM t2
"""
