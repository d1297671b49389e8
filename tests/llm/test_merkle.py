"""The manifest against a plain tree in memory."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscore.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, place, fanout):
    """(root, siblings before and after on the way from a place)."""
    way = []
    while len(nodes) > 1:
        if place is not None:
            start = place // fanout * fanout
            run = nodes[start:start + fanout]
            way.append(("".join(run[:place - start]), "".join(run[place - start + 1:])))
            place //= fanout
        nodes = [H(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], way


def plain(rows, hit, fanout=8):
    trees = defaultdict(list)
    for r in rows:
        small = r["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        mine = leaf(r, r["text"])
        changed = leaf(r, small) if r["doc_id"] is not None and hit(r["doc_id"]) else mine
        trees[(r["lang"] is not None, (r["lang"] or "").encode())].append((r["doc_id"] is not None, r["doc_id"] or 0, mine, changed))
    names = sorted(trees)
    for n in names:
        trees[n].sort()
    subroots = [climb([x[2] for x in trees[n]], None, fanout)[0] for n in names]
    out = []
    for i, n in enumerate(names):
        root, top = climb(subroots, i, fanout)
        for place, (known, doc_id, mine, changed) in enumerate(trees[n]):
            _, way = climb([x[2] for x in trees[n]], place, fanout)
            node = changed
            for before, after in way + top:
                node = H(before, node, after)
            proof = "".join(b + a for b, a in way + top)
            out.append((doc_id if known else None, mine, subroots[i], root, proof, node))
    return sorted(out, key=repr)


def hit(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 0


def manifest(docs, **options):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_of(docs, text=merkle.small_letters(F.col("text"))))
    rows = merkle.merkle_manifest(docs, changed, **options)
    return sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"]) for r in rows.collect()], key=repr)


@pytest.mark.parametrize("fanout,levels", [(8, 4), (2, 1), (2, 3), (3, 2)])
def test_messy_rows(messy, fanout, levels):
    docs = messy.withColumnRenamed("key", "tree").withColumnRenamed("rank", "place").withColumnRenamed("payload", "leaf")
    assert manifest(docs, fanout=fanout, levels=levels) == plain(messy.collect(), hit, fanout)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 300])
def test_sizes_of_one_tree_beside_many(spark, n):
    rows = [(i * 3, f"Text {i} OF many", "en" if i < n else f"l{i}", "s", i) for i in range(n + 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest(docs, levels=1)
    assert got == plain(docs.collect(), hit)
    # A changed leaf leads to another root, an untouched one to the same.
    assert all((r[5] == r[3]) == (not hit(r[0])) for r in got)


def test_one_language_only_and_one_row(spark):
    docs = spark.createDataFrame([(5, "A", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = manifest(docs)
    assert row[1] == row[2] == row[3] and row[4] == ""


def test_a_hot_id(spark):
    """One id with most of the rows, equal and different ones."""
    rows = [(7, f"T{i % 40}", "en", "s", 1) for i in range(600)] + [(i, "X", "en", "s", 1) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    assert manifest(docs, levels=2) == plain(docs.collect(), hit)


def test_an_empty_table(empty):
    assert manifest(empty) == []


def test_versions_share_what_they_do_not_change():
    tree = merkle.PersistentTree([H(str(i)) for i in range(100)], whole=True)
    before = len(tree.digests)
    base = list(tree.digests)
    version = tree.version(37, H("other"))
    # The leaf and its ancestors are new, every other node is the old one.
    assert len(tree.digests) - before == len(tree.rows) and tree.digests[:before] == base
    old, new = tree.children[tree.root], tree.children[version]
    assert [a == b for a, b in zip(old, new)].count(False) == 1
    assert tree.digests[tree.version(37, H("37"))] == tree.digests[tree.root] != tree.digests[version]
