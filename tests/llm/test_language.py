import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscore.llm import language as L

TEXTS = {
    "aa": ["the cat sat on the mat, the end", "a cat and a dog", "that the", "I", ""],
    "bb": ["der hund und die katze", "das ist der Hund 12 und die", "und", "ÄÖ"],
}


def padded(text):
    out = []
    for ch in text:
        out.append(ch.lower() if ch.isalpha() else " ")
    s = "  " + "".join(out)
    while "   " in s:
        s = s.replace("   ", "  ")
    return s.rstrip(" ") + "  " if s.strip() else "  "


def grams(text, n=4):
    s = padded(text)
    return [s[i:i + n] for i in range(len(s) - n + 1)]


class Plain:
    """Interpolated Kneser-Ney straight from its definition."""

    def __init__(self, texts, vocabulary):
        level = Counter(g for t in texts for g in grams(t))
        self.tables, self.vocabulary = {}, vocabulary
        for n in (4, 3, 2, 1):
            one, two = (sum(c == k for c in level.values()) for k in (1, 2))
            d = one / (one + 2 * two) if one and two else 0.5
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.tables[n] = (level, total, kinds, d)
            level = Counter(g[1:] for g in level)

    def p(self, g):
        n = len(g)
        if not n:
            return 1 / (self.vocabulary + 1)
        level, total, kinds, d = self.tables[n]
        lower = self.p(g[1:])
        if g[:-1] not in total:
            return lower
        return max(level[g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * lower

    def entropy(self, text):
        found = grams(text)
        return -sum(math.log(self.p(g)) for g in found) / len(found)


def counted(texts):
    c = Counter(g for t in texts for g in grams(t))
    key = lambda g: sum(ord(ch) << (16 * (3 - i)) for i, ch in enumerate(g))
    return np.array([key(g) for g in c], np.uint64), np.array(list(c.values()), np.int64)


@pytest.fixture(scope="module")
def models():
    return L.Models({k: counted(v) for k, v in TEXTS.items()})


def test_probabilities_are_those_of_the_definition(models):
    letters = {g[-1] for v in TEXTS.values() for t in v for g in grams(t)}
    plain = {k: Plain(v, len(letters)) for k, v in TEXTS.items()}
    texts = ["the dog and the hund", "x", "zzz qqq", "Der Katze", "die  12  matte", "I", "cat " * 400]
    entropy, n = models.entropies(texts)
    for i, t in enumerate(texts):
        assert n[i] == len(grams(t))
        for j, k in enumerate(models.languages):
            assert entropy[i, j] == pytest.approx(plain[k].entropy(t), rel=2e-4)


def test_probabilities_sum_to_one(models):
    # Over all seen last letters and one for the rest of the world.
    seen = np.array([ord(c) for c in sorted({g[-1] for v in TEXTS.values() for t in v for g in grams(t)})], np.uint64)
    context = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate("the"))
    total = np.exp(models.logs(np.uint64(context) | seen, 4)).sum(0)
    assert ((total > 0.8) & (total < 1.0001)).all()


def test_the_sorted_hashes_find_what_they_hold():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    table = L.SortedHashes(keys, np.arange(len(keys)))
    assert (table.values[table.find(keys)] == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1 << 63)) == -1).all()
    one = L.SortedHashes(keys[:1], np.zeros(1))
    assert one.find(keys[:2]).tolist() == [0, -1]


def test_frame(spark, messy, empty, models):
    docs = spark.createDataFrame([(i, t, k) for k, v in TEXTS.items() for i, t in enumerate(v)] + [(9, None, "aa"), (10, "no language", None)], "doc_id long, text string, lang string")
    fitted = L.fit(docs)
    assert fitted.languages == ["aa", "bb"]
    texts = [t for v in TEXTS.values() for t in v]
    assert np.allclose(fitted.entropies(texts)[0], models.entropies(texts)[0], atol=1e-5)
    rows = L.identified(messy.withColumnRenamed("payload", "lang_pred"), fitted).collect()
    assert len(rows) == messy.count()
    for r in rows:
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == blank and 0 <= r.lang_score <= 1
    assert L.identified(empty, fitted).collect() == []
    nothing = L.fit(empty)
    assert {r.lang_pred for r in L.identified(messy, nothing).collect()} == {"und"}


def test_the_batch_does_not_matter(models):
    texts = ["the cat", "", None, "hund " * 3000, "1 2 3", "und"]
    entropy, n = models.entropies(texts)
    for i, t in enumerate(texts):
        alone, k = models.entropies([t])
        assert k[0] == n[i] and np.allclose(alone[0], entropy[i])


def test_held_out_accuracy(spark, small):
    from folioscore.llm.queries import QUERIES

    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op7_language"](spark, small).collect() if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id] for r in rows]) > 0.95


def test_stored_models_keep_every_gram(spark, messy, empty, models):
    # Above the bound: the same probabilities from the distributed table, and no language lost beside a larger one.
    docs = [(t, k) for k, v in TEXTS.items() for t in v] + [("zq xj wv " * 3, "small")] + [("cat and dog " * 40, "aa")] * 3
    frame = spark.createDataFrame(docs, "text string, lang string")
    want, got = L.fit(frame), L.fit(frame, max_cells=10)
    assert isinstance(got, L.StoredModels) and got.languages == want.languages == ["aa", "bb", "small"]
    assert np.allclose(got.limits, want.limits, rtol=1e-5)
    asked = messy.unionByName(spark.createDataFrame([(t,) for t, _ in docs] + [("zq wv",), ("ß unknown",), ("x " * 5000,)], "text string"), allowMissingColumns=True)
    for block_bytes in (50, 10**6):
        rows = [sorted((r.text or "", r.text is None, r.lang_pred, round(r.lang_score, 4), r.lang_rejected) for r in L.identified(asked, m, block_bytes=block_bytes).collect()) for m in (want, got)]
        assert rows[0] == rows[1]
    assert {r.lang_pred for r in L.identified(asked, got).filter("text = 'zq wv'").collect()} == {"small"}
    assert L.identified(empty, got).collect() == []


def test_limits_come_from_every_learned_text(spark):
    """More texts than any sample, and a copied one: mean and deviation over the distinct ones."""
    import statistics

    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} some letters" for i in range(4000)]
    docs = spark.createDataFrame([(t, "en") for t in texts + texts[:1] * 3000], "text string, lang string")
    models = L.fit(docs)
    own = [r.e for r in L.identified(docs, models).groupBy("text").agg(F.max("lang_entropy").alias("e")).collect()]
    assert abs(models.limits[0] - (statistics.mean(own) + L.SPREAD * statistics.stdev(own))) < 1e-9
