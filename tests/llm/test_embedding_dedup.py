import numpy as np
import pytest

from folioscore.llm import embedding_dedup as E
from folioscore.llm.components import components


def plain(rows, threshold):
    """By brute force: id to (links, component)."""
    sound = {}
    for i, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        sound[i] = np.array(v, float) / np.linalg.norm(v) if ok else None
    links = {i: {j for j in sound if j != i and sound[i] is not None and sound[j] is not None and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= threshold} for i in sound}
    out = {}
    for i in sound:
        reached, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(reached))
    return out


def clusters(seed, n, size, spread=0.02, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (n, dims))
    return [c + rng.normal(0, spread, dims) for c in centres for _ in range(rng.integers(1, size))]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 4), (4, 3), (9, 9), (3, 2), (7, 8), (8, 7)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 49), (None, 3)]])
def test_components(spark, edges):
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x: {x} for e in edges for x in e if None not in e and e[0] != e[1]}
    for a, b in edges:
        if None in (a, b) or a == b:
            continue
        joined = nodes[a] | nodes[b]
        for x in joined:
            nodes[x] = joined
    assert got == {x: min(group) for x, group in nodes.items()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for v in clusters(1, 60, 12)] + rng.normal(0, 1, (300, 24)).tolist()
    vectors += [vectors[0]] * 3 + [(np.array(vectors[5]) * 7).tolist(), [0.0] * 24, None, [], [1.0, None], [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(vectors))
    frame = spark.createDataFrame([(i, v, 3, "x", 1) for i, v in rows + rows[:4]], "vec_id long, embedding array<double>, label int, shard string, id int")
    want = plain(rows, 0.95)
    for options in ({}, {"min_shards": 3, "block_rows": 100}):
        got = {r.id: (r.n_links, r.component_id) for r in E.near_vectors(frame, **options).collect()}
        assert got == want


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_of_one_graph():
    rng = np.random.default_rng(4)
    v = np.array(clusters(3, 300, 20, 0.03, 32) + list(rng.normal(0, 1, (1500, 32))), np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = E.Graph(v, np.floor(-np.log(rng.random(len(v))) / np.log(16)).astype(int))
    truth = v @ graph.vectors.T >= 0.95
    q, j = graph.near(v, 0.95, graph.audited_beam(0.95, 0.995))
    assert truth[q, j].all() and len(q) >= 0.995 * truth.sum()


def test_a_beam_full_of_links_is_widened():
    rng = np.random.default_rng(6)
    v = (rng.normal(0, 1, 48) + rng.normal(0, 0.05, (900, 48))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = E.Graph(v, np.zeros(900, int))
    q, _ = graph.near(v[:20], 0.9, 16)
    assert np.bincount(q).min() >= 890


def group_and_pairs(dims=64, group=600, pairs=300, others=1200):
    """A close group with a quarter of all vectors, pairs of two, and vectors without a link."""
    rng = np.random.default_rng(11)
    centre = rng.normal(0, 1, dims)
    left = rng.normal(0, 1, (pairs, dims))
    parts = [centre + rng.normal(0, 0.1, (group, dims)), left, left + rng.normal(0, 0.1, left.shape), rng.normal(0, 1, (others, dims))]
    return np.vstack(parts)[rng.permutation(group + 2 * pairs + others)]


def test_links_of_a_close_group_count_for_both_ends(spark):
    vectors = group_and_pairs()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    rows = [(i - 5, v.tolist()) for i, v in enumerate(vectors)]  # ids below zero as well
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: r.n_links for r in E.near_vectors(frame).collect()}
    assert got == {i - 5: int(n) - 1 for i, n in enumerate(linked.sum(1))}


def test_the_audit_looks_at_queries_with_few_links_apart():
    vectors = group_and_pairs().astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = E.Graph(vectors, np.zeros(len(vectors), int))
    assert graph.audited_beam(0.95, 0.995) > 0
    # Without edges no beam passes: the shard is compared whole.
    graph.layers = [np.full_like(links, -1) for links in graph.layers]
    assert graph.audited_beam(0.95, 0.995) == 0
    q, j, full = graph.searched(vectors[:9], 0.95, 0)
    assert not len(q) and full.tolist() == list(range(9))


def test_whole_shards_keep_components_in_few_edges():
    vectors = group_and_pairs(group=200, pairs=20, others=50)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(len(vectors))
    counts, edges = E._whole(vectors, ids, vectors, ids, np.ones(len(ids), np.int64), 0.95)
    linked = vectors @ vectors.T >= 0.95
    assert counts.tolist() == (linked.sum(1) - 1).tolist() and len(edges) <= 2 * len(ids)
    want = plain(list(enumerate(vectors.tolist())), 0.95)
    label = {i: i for i in ids.tolist()}
    for _ in range(20):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert label == {i: want[i][1] for i in label}
