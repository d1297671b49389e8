"""Token counts and packing against the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscore.llm import packing, pretokens, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_pretokens_give_the_ids_of_the_library(messy):
    from hypothesis import given, settings, strategies as st

    words = pretokens.Vocabulary(PATH)
    alphabet = st.sampled_from(list("ab'sÉ1½ \n\t\r\x85\x1c 　​!_-\0") + ["'ll", "<|endoftext|>", "  ", " \n"])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(alphabet, max_size=25))
    def same(parts):
        text = "".join(parts)
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == ids_of(text)

    same()
    for row in messy.collect():
        assert np.frombuffer(words.encode([row.text])[0], "<u4").tolist() == ids_of(row.text)


@pytest.mark.parametrize("block", [1, 200, 10_000_000])
def test_counts(messy, block):
    got = token_counts.token_counts(messy, PATH, block_chars=block, buckets=5)
    want = [(r.doc_id, len((r.text or "").encode()), len(ids_of(r.text))) for r in messy.collect()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_counts_of_an_empty_table(empty):
    assert token_counts.token_counts(empty, PATH).collect() == []


def check_pieces(docs, pieces, capacity):
    texts = {}
    for d in docs:
        texts.setdefault(d.doc_id, []).append(np.array([*ids_of(d.text), 1], "<u4"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids, times = texts[doc_id][0], len(texts[doc_id])
        own = sorted(own, key=lambda p: p.start)[::times]
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert sum(p.length for p in own) <= capacity


def test_pieces(messy):
    for capacity, piece, windows in ((2048, 512, 128), (64, 16, 4)):
        got = packing.pack(messy, PATH, capacity=capacity, piece=piece, group_windows=windows).collect()
        check_pieces(messy.collect(), got, capacity)


def test_pieces_of_an_empty_table(empty):
    assert packing.pack(empty, PATH).collect() == []


def test_little_padding(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    pieces = packing.pack(docs, PATH).collect()
    check_pieces(docs.collect(), pieces, 2048)
    sums = {}
    for p in pieces:
        sums[p.sequence_id] = sums.get(p.sequence_id, 0) + p.length
    assert sum(sums.values()) / (2048 * len(sums)) > 0.97


def test_differencing_makes_even_windows():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 500, 700)
    sums = np.bincount(packing.differencing(sizes, 80), weights=sizes, minlength=80)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 60
    halves = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(halves, weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_windows_rise_when_the_capacity_is_exceeded():
    sizes = np.array([6, 6, 6])
    window = packing.divided(sizes, 9)  # 18 fits two windows by sum, but not by piece
    assert len(set(window.tolist())) == 3
