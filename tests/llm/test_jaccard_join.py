import random

import pytest

from folioscore.llm import jaccard_join as J


def shingles(text):
    words = [w for w in (text or "").encode().split()]
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        reached, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        out.append((rows[i][0], min(ids) if ids else None, len(links[i])))
    return sorted(map(repr, out))


def corpus(seed=1, bases=40, hot=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    rows = []
    for b in range(bases):
        words = rnd.choices(vocabulary, k=rnd.randint(3, 300))
        if b % 3 == 0:
            words = passage.split() + words
        rows.append(" ".join(words))
        for _ in range(rnd.randint(0, 4)):
            near = list(words)
            for _ in range(rnd.randint(0, max(1, len(words) // 30))):
                near[rnd.randrange(len(near))] = rnd.choice(vocabulary)
            rows.append(("  " if rnd.random() < 0.3 else " ").join(near))
    base = rnd.choices(vocabulary, k=200)
    for _ in range(hot):
        near = list(base)
        near[rnd.randrange(200)] = rnd.choice(vocabulary)
        rows.append(" ".join(near))
    return list(enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"limit": 4, "chunk": 16, "tile": 16}])
def test_against_brute_force(spark, options):
    rows = corpus(hot=90) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "a  b"), (5, corpus(hot=0)[5][1]), (None, "a b c d e f g")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, path int")
    got = J.similar_documents(frame, recall=0.99999, **options).collect()
    assert sorted(repr(tuple(r)[:3]) for r in got) == plain(rows)


def test_empty_and_messy(messy, empty):
    assert J.similar_documents(empty).collect() == []
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert sorted(repr(tuple(r)[:3]) for r in J.similar_documents(messy).collect()) == plain(rows)


def test_paths_nest():
    import numpy as np

    from folioscore.llm.common import shingle_hashes

    hashes = shingle_hashes(corpus()[1][1])
    rows = J.paths_of(hashes, 20, 0.8, 3)
    assert 5 < len(rows) < 60
    batch = J._batch([p for p, _ in rows], ["k"] * len(rows), [b"\0" * 72 + kids for _, kids in rows])
    down = next(iter(J._next_paths([batch])))
    deeper = next(iter(J._next_paths([down])))
    firsts = np.array([p for p, _ in rows], np.uint64)
    seconds = np.concatenate(J._picks(hashes, firsts, 0.8))
    assert sorted(down.column(0).to_numpy().view(np.uint64)) == sorted(seconds)
    assert sorted(deeper.column(0).to_numpy().view(np.uint64)) == sorted(np.concatenate(J._picks(hashes, np.array(down.column(0).to_numpy().view(np.uint64)), 0.8)))


def test_recall_of_the_runs():
    assert J.runs_for(0.9995) == 8


def test_one_of_each(spark, messy):
    rows = [r for r in corpus(hot=20)]
    frame = spark.createDataFrame([(i, t, i % 5) for i, t in rows] + [(rows[3][0], rows[3][1], 3)], "doc_id long, text string, key int")
    kept = J.one_of_each(frame)
    wanted = {eval(r)[1] for r in plain(rows)}
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(wanted)
    ids = [r.doc_id for r in J.one_of_each(messy).collect()]
    assert sorted(ids, key=str) == sorted([0, 1, 2, 3, 4, 6, 8, 9, 10, None, 12, 13] + [7] * (7 in ids), key=str)


def test_runs_for_the_deepest_level():
    assert J.runs_for(0.9995, 2) == 13 and J.runs_for(0.9995, 3) == 17


def test_copies_do_not_crowd_a_bucket_and_near_copies_are_found(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(60):
        base = rnd.choices(vocabulary, k=205)
        near = list(base)
        for at in range(5, 160, 46):  # 4 separate words: 20 of about 201 shingles
            near[at] = "other"
        rows += [" ".join(base)] * (300 if g < 3 else 1) + [" ".join(near)]
    rows = list(enumerate(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spoken = frame.selectExpr("md5(text) AS key", "text")
    seen = list(J._first_of_each(iter([b for b in [spoken.toArrow().to_batches()[0]]])))
    assert seen[0].num_rows == len(set(seen[0].column(0).to_pylist()))
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.similar_documents(frame).collect()}
    sets = {t: shingles(t) for t in {t for _, t in rows}}
    for g, (i, near) in enumerate([r for r in rows if "other" in r[1]]):
        base = rows[i - 1][1]
        assert len(sets[base] & sets[near]) >= 0.8 * len(sets[base] | sets[near])
        assert got[i][1] == (300 if g < 3 else 1)


def test_pairs_meet_in_a_leftover_bucket_that_no_pivot_resembles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows, pairs = [], set()
    for i in range(200):  # pairs of near texts, each far from all others
        one = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        two = np.r_[one[:285], rng.integers(0, 1 << 63, 15).astype(np.uint64)]
        for name, hashes in ((f"{i}a", one), (f"{i}b", two)):
            rows.append((1, name, bytearray(len(hashes).to_bytes(8, "little") + J.sketch_of(hashes).tobytes())))
        pairs.add((f"{i}a", f"{i}b"))
    edges, rest = J.large_edges(spark.createDataFrame(rows, J.ROWS), 0.8, None, 16)
    assert {tuple(sorted(r)) for r in edges.collect()} == pairs and not rest.count()
    edges, rest = J.large_edges(spark.createDataFrame(rows, J.ROWS), 0.8, 64, 16)
    assert rest.count() == 400


def test_texts_alike_below_the_threshold_are_compared_where_they_meet(spark, monkeypatch):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rnd.choices(vocabulary, k=110)
    rows = [" ".join(passage + rnd.choices(vocabulary, k=70)) for _ in range(250)]
    for i in range(0, 250, 25):  # near copies of some
        words = rows[i].split()
        words[150] = "other"
        rows.append(" ".join(words))
    rows = list(enumerate(rows))
    split = []
    whole = J.candidate_edges
    monkeypatch.setattr(J, "candidate_edges", lambda paths, *a: split.append(paths.count()) or whole(paths, *a))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.similar_documents(frame).collect()
    assert sorted(repr(tuple(r)[:3]) for r in got) == plain(rows)
    assert not sum(split)


def test_large_buckets_are_split_above_the_bound(spark):
    rows = corpus(hot=90)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.similar_documents(frame, recall=0.99999, limit=4, chunk=16, tile=16, tiled=4).collect()
    assert sorted(repr(tuple(r)[:3]) for r in got) == plain(rows)


def test_sketches_compare_as_one_by_one():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = [base[rng.random(200) < rng.choice([0.05, 0.5, 0.9])] for _ in range(60)] + [base[:1]]
    held = [len(s).to_bytes(8, "little") + J.sketch_of(s).tobytes() for s in sets]
    near = J._similar(held, 0.8)
    for i, a in enumerate(held):
        for j, b in enumerate(held):
            sizes = sorted(int.from_bytes(h[:8], "little") for h in (a, b))
            known = sum(x > 0 or y > 0 for x, y in zip(a[8:], b[8:]))
            equal = sum(x == y > 0 for x, y in zip(a[8:], b[8:]))
            assert near[i, j] == (sizes[0] >= 0.8 * sizes[1] and (equal >= (0.8 - J.SLACK) * known or known < 16))
