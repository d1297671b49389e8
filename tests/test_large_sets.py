"""Tree digests, set reconciliation and the rank index against plain computations."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioscore.operators import pages_index, reconcile, tree_digest
from folioscore.operators.fingerprints import table_difference


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(lines, fanout):
    nodes = [H(x) for x in lines]
    while len(nodes) > 1:
        nodes = [H("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0] if nodes else H("")


@pytest.mark.parametrize("n,fanout", [(0, 4), (1, 4), (4, 4), (5, 4), (100, 3)])
def test_tree_digest(spark, n, fanout):
    rows = [(i, f"line {i * i}") for i in range(n)]
    random.Random(n).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, line string")
    got = tree_digest.tree_digest(df, ["k"], F.col("line"), fanout).head()
    assert (got["n_rows"], got["root"]) == (n, plain_root([x for _, x in sorted(rows)], fanout))


def test_order_and_content_change_the_root_and_places_are_found(spark):
    base = [(i, f"{i}") for i in range(200)]
    other = [(i, "x" if i in (17, 18, 150) else f"{i}") for i in range(200)]
    swapped = [(i, f"{199 - i}") for i in range(200)]
    trees = [tree_digest.tree_levels(spark.createDataFrame(r, "k long, line string"), ["k"], F.col("line"), 4)[0] for r in (base, other, swapped)]
    roots = [t[-1].head()["digest"] for t in trees]
    assert len(set(roots)) == 3
    assert sorted(r["place"] for r in tree_digest.changed_places(trees[0], trees[1], 4).collect()) == [17, 18, 150]
    assert tree_digest.changed_places(trees[0], trees[0], 4).count() == 0


def test_trees_of_several_lines_share_one_sort_and_hold_bytes(spark, monkeypatch):
    rows = [(i, f"{i}", "x" if i in (17, 18, 150) else f"{i}") for i in range(200)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, one string, two string")
    sorts, plain = [], tree_digest.global_position
    monkeypatch.setattr(tree_digest, "global_position", lambda *a, **b: sorts.append(1) or plain(*a, **b))
    both, n = tree_digest.trees(df, ["k"], {"one": F.col("one"), "two": F.col("two")}, 4)
    assert len(sorts) == 1 and n == 200
    for at, name in ((1, "one"), (2, "two")):
        root = both[name][-1].head()["digest"]
        assert len(root) == 32 and bytes(root).hex() == plain_root([r[at] for r in sorted(rows)], 4)
    assert sorted(r["place"] for r in tree_digest.changed_places(both["one"], both["two"]).collect()) == [17, 18, 150]


def test_places_of_trees_with_other_last_runs_and_of_single_rows(spark):
    levels = lambda n: tree_digest.tree_levels(spark.range(n), ["id"], F.col("id").cast("string"), 4)[0]
    assert sorted(r["place"] for r in tree_digest.changed_places(levels(61), levels(50)).collect()) == list(range(50, 61))
    other = tree_digest.tree_levels(spark.range(1), ["id"], F.lit("x"), 4)[0]
    assert [r["place"] for r in tree_digest.changed_places(levels(1), other).collect()] == [0]
    assert tree_digest.changed_places(levels(0), levels(0)).collect() == []


ROW = "a long, b string, c double"


def as_set(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("cells,most", [(30, 3000), (3000, 3000), (3, 3)])
def test_reconciled_rows_are_those_of_a_full_comparison(spark, cells, most):
    """Also where the sketch is too small and grows, or all rows are grouped in the end."""
    rng = random.Random(7)
    rows = [(i, None if i % 11 == 0 else f"t{i % 50}", i / 7) for i in range(500)]
    other = [r for r in rows if r[0] % 97] + [(1000 + i, None, None) for i in range(5)] + [rows[3], rows[3], (None, "x", 0.5)]
    rng.shuffle(other)
    left, right = spark.createDataFrame(rows, ROW), spark.createDataFrame(other, ROW)
    want = as_set(table_difference(left, right))
    assert want and as_set(reconcile.differing_rows(left, right, cells=cells, most_cells=most)) == want


def test_many_copies_and_equal_or_empty_tables(spark):
    rows = [(1, "hot", 0.0)] * 400 + [(2, None, None)] * 3
    left = spark.createDataFrame(rows, ROW)
    fewer = spark.createDataFrame(rows[7:], ROW)
    assert [tuple(r) for r in reconcile.differing_rows(left, fewer).collect()] == [(1, "hot", 0.0, 7)]
    assert reconcile.differing_rows(left, left.repartition(5)).count() == 0
    empty = spark.createDataFrame([], ROW)
    assert as_set(reconcile.differing_rows(empty, left)) == as_set(table_difference(empty, left))
    # Nulls in other columns are other rows.
    a, b = (spark.createDataFrame([r], "a string, b string") for r in (("x", None), (None, "x")))
    assert reconcile.differing_rows(a, b).count() == 2


def test_pages_by_index(spark, tmp_path):
    rows = [(i // 3 if i % 10 else None, f"n{i % 7}", i) for i in range(250)]
    random.Random(1).shuffle(rows)
    path = str(tmp_path / "ranked")
    pages_index.store_ranked(spark.createDataFrame(rows, "g long, n string, i long"), ["g", "n", "i"], path, range_rows=40)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for number in (1, 2, 5, 9, 100):
        got = [(r["g"], r["n"], r["i"]) for r in pages_index.page(spark, path, number, 30).orderBy("position").collect()]
        assert got == order[(number - 1) * 30:number * 30]
    after = order[:1]
    seen = list(after)
    for _ in range(9):
        seen += [(r["g"], r["n"], r["i"]) for r in pages_index.page_after(spark, path, ["g", "n", "i"], seen[-1], 30).orderBy("position").collect()]
    assert seen == order
    # A key that no row has, and one behind all.
    assert pages_index.page_after(spark, path, ["g", "n", "i"], (5, "n", 0), 1).head()["g"] == 5
    assert pages_index.page_after(spark, path, ["g", "n", "i"], (10**9, "", 0), 5).count() == 0
    assert pages_index.total_rows(spark, path).head()["total"] == 250
    with pytest.raises(ValueError):
        pages_index.page(spark, path, 0, 5)
    plan = pages_index.page(spark, path, 2, 30)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [range" in plan and "Exchange" not in plan
