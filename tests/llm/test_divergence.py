"""The divergence audit against plain Python integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscore.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_documents=3, top=200):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source = r["lang"] or "", r["source"] or ""
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(r["text"] or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= min_documents]
        sources = sorted(s for a, s in groups if a == lang)

        def share(count):
            held = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (held + len(kept)) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def audit(docs, **options):
    return sorted(tuple(r) for r in D.divergence_audit(docs, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def made(spark, n=240, sources=9, langs=3):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "漢字", "a­b", "Straße"]
    rows = []
    for i in range(n):
        source = int(rng.zipf(1.6)) % sources
        text = " ".join(words[int(x) % len(words)].title() + "1-" for x in rng.zipf(1.3, 40) + source * 3)
        rows.append((i, text, f"l{i % langs}", f"s{source}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("group_block,term_block", [(32, 4096), (2, 16), (1, 7), (4, 1000)])
def test_any_cells_give_the_same(spark, group_block, term_block):
    docs = made(spark)
    assert audit(docs, group_block=group_block, term_block=term_block) == plain(docs.collect())


def test_few_top_terms_and_tiny_dictionaries(spark):
    docs = made(spark, 120)
    assert audit(docs, top_terms=3, held=5) == plain(docs.collect(), top=3)


def test_messy_rows(messy):
    docs = messy.withColumnRenamed("bucket", "term").withColumnRenamed("payload", "n").withColumnRenamed("rank", "blocks")
    want = plain(messy.collect(), 2)
    assert audit(docs, min_documents=2) == want and {r[2] for r in want} == {"pair", "term"}


def test_no_term_is_kept(messy):
    rows = audit(messy, min_documents=10_000)
    assert rows and all(r[2] == "pair" and r[4] == 0 for r in rows) and rows == plain(messy.collect(), 10_000)


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 64)
    docs = made(spark, 60)
    assert audit(docs) == plain(docs.collect())


def test_an_empty_table(empty):
    assert audit(empty) == []


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 10**14, (5, 50))
    total = n.sum(axis=1) + 50
    want = [[1 + 10**9 * (int(c) + 1) // int(t) for c in row] for row, t in zip(n, total)]
    assert D.shares(n, total).tolist() == want
    huge = n * 10**4
    assert D.shares(huge, huge.sum(axis=1) + 50).tolist() == [[1 + 10**9 * (int(c) + 1) // (int(row.sum()) + 50) for c in row] for row in huge]
