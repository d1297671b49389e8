"""A byte-level convolutional network that scores the quality of whole texts.

A text's UTF-8 bytes are read in overlapping chunks that cover all of it: blocks of `BLOCK`
bytes, each chunk two neighbouring blocks. Learned filters slide over the embedded bytes, every
chunk keeps each filter's maximum, and the document keeps the mean and the maximum of its chunks,
which one logistic layer turns into a probability. Numpy only, inside Spark tasks.

The network is fitted on a bounded sample: `max_rows` labelled documents with the lowest hashes of
their ids, their texts whole. Training and scoring take a bounded number of blocks at a time.

Defined results: null and empty texts are one block of padding and get that block's score; without
any labelled row every score is 0.5; repeated rows score alike; an empty table gives an empty
result; other columns pass through, and columns named like the new ones are replaced.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK, WIDTH, STRIDE, EMBEDDED, FILTERS = 256, 9, 3, 5, 24
PAD = 256
MAX_ROWS, EPOCHS, BATCH, RATE = 2000, 8, 24, 0.01
STEPS = np.arange(0, BLOCK, STRIDE)


def blocks_of(text: str | None) -> np.ndarray:
    """(blocks, BLOCK + WIDTH) symbols: each block with the bytes its last windows look into."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(data) // BLOCK))
    padded = np.full(n * BLOCK + WIDTH, PAD, np.int16)
    padded[:len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, BLOCK + WIDTH)[::BLOCK]


def windows_of(blocks: np.ndarray, embedding: np.ndarray) -> np.ndarray:
    """(blocks, steps, WIDTH * EMBEDDED) inputs of the filters."""
    embedded = embedding[blocks]
    seen = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH, axis=1)[:, STEPS]
    return seen.transpose(0, 1, 3, 2).reshape(len(blocks), len(STEPS), WIDTH * EMBEDDED)


def pooled(maxima: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk maxima of each document's blocks, and their mean and maximum by document."""
    ends = np.append(starts[1:], len(maxima))
    last = np.zeros(len(maxima), bool)
    last[ends - 1] = True
    after = np.where(last[:, None], maxima, np.roll(maxima, -1, axis=0))
    chunks = np.maximum(maxima, after)
    return chunks, np.add.reduceat(chunks, starts) / (ends - starts)[:, None], np.maximum.reduceat(chunks, starts)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """The weights, their forward pass and one step of their training."""

    NAMES = ("embedding", "filters", "bias", "out", "offset")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f4 = lambda x: x.astype(np.float32)
        self.embedding = f4(rng.normal(0, 0.5, (PAD + 1, EMBEDDED)))
        self.filters = f4(rng.normal(0, (2 / (WIDTH * EMBEDDED)) ** 0.5, (WIDTH * EMBEDDED, FILTERS)))
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = f4(rng.normal(0, 0.1, 2 * FILTERS))
        self.offset = np.zeros(1, np.float32)

    def maxima(self, blocks: np.ndarray, at_once: int = 256) -> np.ndarray:
        found = [
            (windows_of(part, self.embedding) @ self.filters).max(axis=1)
            for part in (blocks[i:i + at_once] for i in range(0, len(blocks), at_once))
        ]
        return np.maximum(np.concatenate(found) + self.bias, 0)

    def scores(self, texts: list) -> np.ndarray:
        """Probabilities, a bounded number of blocks at a time however long a text is."""
        out = np.empty(len(texts))
        maxima, starts, held, first = [], [], 0, 0

        def flush(upto: int) -> None:
            if upto > first:
                _, mean, most = pooled(np.concatenate(maxima), np.array(starts))
                out[first:upto] = sigmoid(np.concatenate([mean, most], 1) @ self.out + self.offset)

        for i, text in enumerate(texts):
            blocks = blocks_of(text)
            starts.append(held)
            maxima.append(self.maxima(blocks) if len(blocks) > 64 else blocks)
            held += len(blocks)
            if held > 4096:
                maxima = self._finish(maxima)
                flush(i + 1)
                maxima, starts, held, first = [], [], 0, i + 1
        if starts:
            maxima = self._finish(maxima)
            flush(len(texts))
        return out

    def _finish(self, parts: list) -> list:
        """Short texts' blocks are run together; long ones already are maxima."""
        short = [p for p in parts if p.shape[1] != FILTERS]
        if not short:
            return parts
        done = np.split(self.maxima(np.concatenate(short)), np.cumsum([len(p) for p in short])[:-1])
        left = iter(done)
        return [p if p.shape[1] == FILTERS else next(left) for p in parts]

    def gradients(self, blocks: list[np.ndarray], labels: np.ndarray, at_once: int = 512) -> dict:
        """Two passes over slices of the blocks: what each filter sees best, then what flows back to it."""
        sizes = np.array([len(b) for b in blocks])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        owner = np.repeat(np.arange(len(blocks)), sizes)
        symbols = np.concatenate(blocks)
        slices = [slice(i, i + at_once) for i in range(0, len(symbols), at_once)]
        best, maxima = np.empty((len(symbols), FILTERS), np.int64), np.empty((len(symbols), FILTERS), self.filters.dtype)
        for part in slices:
            linear = windows_of(symbols[part], self.embedding) @ self.filters
            best[part] = linear.argmax(axis=1)
            maxima[part] = np.maximum(np.take_along_axis(linear, best[part][:, None], 1)[:, 0] + self.bias, 0)
        chunks, mean, most = pooled(maxima, starts)
        features = np.concatenate([mean, most], 1)
        wrong = (sigmoid(features @ self.out + self.offset) - labels).astype(np.float32) / len(labels)
        back = wrong[:, None] * self.out
        # Overlapping chunks share maxima: each of the equal ones gets its part.
        top = chunks == most[owner]
        shared = np.add.reduceat(top, starts, dtype=np.float32)
        to_chunk = back[owner, :FILTERS] / sizes[owner, None] + (back[:, FILTERS:] / shared)[owner] * top
        # A chunk's maximum came from its own block or from the next one.
        own = maxima == chunks
        to_block = to_chunk * own
        passed = to_chunk * ~own
        to_block[1:] += passed[:-1]
        to_block *= maxima > 0
        filters, embedding = np.zeros_like(self.filters), np.zeros_like(self.embedding)
        for part in slices:
            seen, flow, at = symbols[part], to_block[part], best[part]
            rows = np.arange(len(seen))[:, None]
            places = seen[rows[:, :, None], STEPS[at][:, :, None] + np.arange(WIDTH)]  # (blocks, FILTERS, WIDTH)
            taken = self.embedding[places].reshape(len(seen), FILTERS, WIDTH * EMBEDDED)
            filters += np.einsum("bf,bfk->kf", flow, taken)
            to_input = (flow[:, :, None] * self.filters.T).reshape(-1, EMBEDDED)
            for k in range(EMBEDDED):
                embedding[:, k] += np.bincount(places.ravel(), to_input[:, k], PAD + 1).astype(embedding.dtype)
        return {
            "embedding": embedding, "filters": filters, "bias": to_block.sum(0), "out": features.T @ wrong, "offset": wrong.sum(keepdims=True),
        }

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Network:
        net = cls()
        with np.load(io.BytesIO(data)) as held:
            for n in cls.NAMES:
                setattr(net, n, held[n])
        return net


def trained(texts: list, labels: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Adam on the logistic loss; deterministic for a given order of rows."""
    net, rng = Network(), np.random.default_rng(11)
    samples = [blocks_of(text) for text in texts]
    moments = {n: [np.zeros_like(getattr(net, n)) for _ in range(2)] for n in net.NAMES}
    step = 0
    total = epochs * -(-len(samples) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for name, g in net.gradients([samples[i] for i in part], labels[part]).items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                getattr(net, name)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(
    docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    max_rows: int = MAX_ROWS, epochs: int = EPOCHS,
) -> Network | None:
    """A network from at most `max_rows` labelled documents; None if there are none.

    Conflicting labels of a document are averaged and rounded; of several texts with one id the
    first in order counts. The sample is drawn before texts are read, and the fit is one task's work.
    """
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("id"))
    drawn = known.agg(F.round(F.avg(label_column)).cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    # At most max_rows ids and numbers: the broadcast is bounded by the parameter.
    # Rows that repeat an id fall together before they reach the task that fits.
    sample = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min("text").alias("text")).withColumn("one", F.lit(0))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        net = trained(rows["text"].tolist(), rows["label"].to_numpy(np.float32), epochs)
        return pd.DataFrame({"weights": [net.packed()]})

    found = sample.groupBy("one").applyInPandas(run, "weights binary").collect()
    return Network.unpacked(bytes(found[0].weights)) if found else None


def scored(docs: DataFrame, network: Network | None, *, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """`docs` with a probability of quality, from the whole text."""
    if network is None:
        return docs.withColumn(score_column, F.lit(0.5))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(network.scores(texts.tolist()))

    return docs.withColumn(score_column, score(F.col(text_column)))
