import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folioscore.llm import fingerprints, mixing


def sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    parts = [" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    return sorted({h for h in (hashlib.md5(p.encode()).hexdigest()[:12] for p in parts) if h < "4"})


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0


def test_fingerprints(messy, empty):
    rows = messy.collect()
    got = fingerprints.edited_fingerprints(messy).collect()
    assert len(got) == len(rows)
    distinct = sorted({(r.doc_id, r.text or "") for r in rows}, key=lambda r: (r[0] is not None, r[0]))
    following = {r: distinct[(i + 1) % len(distinct)] for i, r in enumerate(distinct)}
    after = {r: n[1] for r, n in following.items()}
    want = []
    for r in rows:
        text = r.text or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[r.doc_id, text][:half]
        a, b = sketch(text), sketch(edited)
        want.append((r.doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), like(a, b), like(a, sketch(after[r.doc_id, text])), len(a), following[r.doc_id, text][0]))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fingerprints.edited_fingerprints(empty).collect() == []


def test_one_document_is_its_own_next(messy):
    row = fingerprints.edited_fingerprints(messy.filter("doc_id = 4")).first()
    assert row.near_next == 1.0


def test_sketches_merge_and_contain(spark):
    words = [f"w{i}" for i in range(4000)]
    big, small = " ".join(words), " ".join(words[100:300])
    row = spark.createDataFrame([(big, small)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    row = row.select("*", fingerprints.containment(F.col("b"), F.col("a")).alias("inside"), fingerprints.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert row.inside == 1.0 and row.m == row.a and abs(len(row.a) - 1000) < 120


def plain_targets(sizes, repeat=3.0):
    """Shares the excess again and again, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(names)}
    target, free, left = {s: 0.0 for s in names}, set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        gain = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, g in gain.items():
            target[s] += g
            if target[s] > repeat * sizes[s]:
                left += target[s] - repeat * sizes[s]
                target[s] = repeat * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 7, None: 50}, {"a": 10, "b": 10, "c": 10}, {"x": 1000}, {"a": 0, "b": 9}, {f"s{i:02}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)


def test_mix(spark, messy, empty):
    rows = [(i, "w " * (1 + i * 7 % 40), "abcd"[i % 4] if i % 5 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, buckets=64).collect()
    assert len(got) == 4000 and sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7), buckets=16).collect()))
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)
    unequal = mixing.mix(docs.withColumn("liking", F.col("doc_id") % 3 + 1), propensity="liking").collect()
    by = [sum(r.copies for r in unequal if r.doc_id % 3 == k) for k in range(3)]
    assert by[0] < by[1] < by[2]
    odd = mixing.mix(messy).collect()
    assert len(odd) == messy.count() and sum(r.size for r in odd if r.doc_id in (0, 1, 2)) == 0
    assert mixing.mix(empty).collect() == []


def test_mixed_documents(messy):
    plan = {(r.doc_id, r.size): r.copies for r in mixing.mix(messy).collect()}
    rows = mixing.mixed_documents(messy)
    assert rows.columns == messy.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = sorted(repr(tuple(r)) for r in messy.collect() for _ in range(plan[r.doc_id, size(r.text)]))
    assert sorted(repr(tuple(r)) for r in rows.collect()) == want
