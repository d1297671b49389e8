import zlib

import numpy as np
import pytest

from folioscore.llm import quality

CLEAN = "the old town lies by the river and its people walk there in the evening. ".split(" ")


def text(i, junk):
    rng = np.random.default_rng(i)
    words = rng.choice(CLEAN, rng.integers(3, 250))
    return " ".join(w.upper() + "!!" if junk else w for w in words)


def test_gradients_match_differences():
    net = quality.Network(3)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    blocks = [quality.blocks_of(text(i, i % 2)) for i in range(4)]
    labels = np.array([1.0, 0, 1, 0])

    def loss():
        maxima = net.maxima(np.concatenate(blocks))
        starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1]))
        _, mean, most = quality.pooled(maxima, starts)
        p = quality.sigmoid(np.concatenate([mean, most], 1) @ net.out + net.offset)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = net.gradients(blocks, labels)
    rng = np.random.default_rng(0)
    for name in net.NAMES:
        weights = getattr(net, name)
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            kept = weights[at]
            weights[at] = kept + 1e-6
            up = loss()
            weights[at] = kept - 1e-6
            down = loss()
            weights[at] = kept
            assert abs((up - down) / 2e-6 - found[name][at]) < 1e-5


def test_every_byte_lies_in_a_chunk():
    for n in (0, 1, 255, 256, 257, 5000):
        blocks = quality.blocks_of("x" * n)
        assert (blocks[:, :quality.BLOCK] != quality.PAD).sum() == n and len(blocks) == max(1, -(-n // quality.BLOCK))


@pytest.fixture(scope="module")
def network(spark):
    docs = spark.createDataFrame([(i, text(i, i % 3 == 0)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(500)] + [(None, 1), (3, None)], "doc_id long, quality int")
    return quality.fit(docs, labels, max_rows=400, epochs=4)


def test_held_out_accuracy(network):
    wanted = [i % 3 != 0 for i in range(500, 600)]
    assert np.mean((network.scores([text(i, i % 3 == 0) for i in range(500, 600)]) >= 0.3) == wanted) > 0.97


def test_junk_at_the_end_of_a_long_text_counts(network):
    clean = " ".join(text(i, False) for i in range(40))
    scores = network.scores([clean, clean + " " + " ".join(text(i, True) for i in range(40))])
    assert scores[1] < scores[0]


def test_scores_do_not_depend_on_the_batch(network):
    texts = [text(i, i % 2) * (60 if i % 7 == 0 else 1) for i in range(60)] + ["", None]
    alone = np.array([network.scores([t])[0] for t in texts])
    assert np.allclose(network.scores(texts), alone, atol=1e-6)


def test_frame(spark, messy, empty, network):
    rows = quality.scored(messy.withColumnRenamed("rank", "score"), network).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows) and "payload" in rows[0]
    assert len({r.score for r in rows if r.doc_id in (0, 1)}) == 1
    assert quality.scored(empty, network).collect() == []
    none = quality.fit(messy, spark.createDataFrame([], "doc_id long, quality int"))
    assert none is None and {r.score for r in quality.scored(messy, none).collect()} == {0.5}


def test_registered_query(spark, small):
    from folioscore.llm.queries import QUERIES

    rows = QUERIES["op8_quality"](spark, small).collect()
    assert len({r.doc_id for r in rows}) == len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)


def test_a_step_over_slices_is_a_step_over_all_blocks():
    net = quality.Network(5)
    blocks = [quality.blocks_of(text(i, i % 2) * (1 + 3 * i)) for i in range(5)]
    labels = np.array([1.0, 0, 1, 0, 1], np.float32)
    whole, sliced = net.gradients(blocks, labels, 10**6), net.gradients(blocks, labels, 7)
    assert all(np.allclose(whole[n], sliced[n], atol=1e-5) for n in net.NAMES)


def test_whole_texts_are_learned():
    """What tells the classes apart stands behind the first three kilobytes only."""
    start = "some plain words of no meaning at all " * 100
    texts = [start + ("good end of text " if i % 2 else "#!%& 00 ~~ ") * 40 for i in range(60)]
    labels = np.array([i % 2 for i in range(60)], np.float32)
    scores = quality.trained(texts, labels).scores(texts)
    assert scores[labels == 1].min() > scores[labels == 0].max()


def test_a_whole_text_against_a_plain_forward_pass():
    net, sample = quality.Network(9), text(3, True) * 5
    data = [*sample.encode()]
    n = -(-len(data) // quality.BLOCK)
    data += [quality.PAD] * (n * quality.BLOCK + quality.WIDTH - len(data))
    blocks = []
    for b in range(n):
        outs = []
        for s in range(0, quality.BLOCK, quality.STRIDE):
            at = b * quality.BLOCK + s
            window = np.concatenate([net.embedding[c] for c in data[at:at + quality.WIDTH]])
            outs.append(window @ net.filters + net.bias)
        blocks.append(np.maximum(np.max(outs, axis=0), 0))
    chunks = np.array([np.maximum(blocks[i], blocks[min(i + 1, n - 1)]) for i in range(n)])
    features = np.concatenate([chunks.mean(0), chunks.max(0)])
    want = 1 / (1 + np.exp(-(features @ net.out + net.offset[0])))
    assert abs(net.scores([sample])[0] - want) < 1e-5
