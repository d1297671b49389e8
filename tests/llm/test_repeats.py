import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from folioscore.llm import repeats as R


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(text):
    text = text + [0]
    assert R.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_first_owners():
    rnd = random.Random(3)
    runs = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(5, 30))) for _ in range(40)]
    owners = np.array([rnd.randint(0, 9) for _ in runs])
    least = {}
    for r, o in zip(runs, owners):
        for i in range(len(r) - 4):
            least[r[i:i + 5]] = min(o, least.get(r[i:i + 5], 99))
    for r, got in zip(runs, R.first_owners(runs, owners, 5)):
        assert got.tolist() == [least[r[i:i + 5]] for i in range(len(r) - 4)]


def plain(rows):
    """Straight from the definition."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    first = {}
    for i, t in texts:
        for k in range(len(t) - 49):
            w = t[k:k + 50]
            if w not in first or order(i) < order(first[w]):
                first[w] = i
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if order(first[t[k:k + 50]]) < order(i):
                gone[k:k + 50] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(map(repr, out))


def corpus(seed):
    rnd = random.Random(seed)
    syllables = ["the", "of", "ther", "ing", "é", " ", " ", ". ", "tion", "漢"]
    some = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    passages = [some(rnd.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [some(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, 6)
            parts += [p[cut:len(p) - rnd.randint(0, 6)], some(rnd.randint(0, 30))]
        rows.append((i * 3, "".join(parts)))
        if rnd.random() < 0.25:
            near = list(rows[-1][1])
            for _ in range(rnd.randint(0, 3)):
                near.insert(rnd.randint(0, len(near)), "#")
            rows.append((i * 3 + 1, "".join(near)))
    rows += [(400, "ab" * 200), (401, "ab" * 100), (402, "a" * 300), (403, "a" * 49), (404, "a" * 50), (9, rows[2][1])]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1500), (2, 10_000_000)])
def test_against_the_definition(spark, monkeypatch, seed, block):
    monkeypatch.setattr(R, "BLOCK_BYTES", block)
    rows = corpus(seed)
    rows += [(None, rows[0][1]), (500, None), (500, ""), (501, rows[5][1]), (501, rows[5][1])]
    random.Random(seed).shuffle(rows)
    frame = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, block string, bucket int")
    got = R.without_repeats(frame, buckets=5).collect()
    assert sorted(repr((*r[:5], bytes(r.kept))) for r in got) == plain(rows)


def test_messy_and_empty(messy, empty):
    got = R.without_repeats(messy).collect()
    assert sorted(repr((*r[:5], bytes(r.kept))) for r in got) == plain([(r.doc_id, r.text) for r in messy.collect()])
    assert R.without_repeats(empty).collect() == []
