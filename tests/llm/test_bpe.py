"""Byte-level BPE against the library on whole texts, and back."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from folioscore.llm import bpe
from folioscore.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def short():
    """Cuts texts all the time."""
    return bpe.Codec(RANKS, public_tokenizers.PATTERN, stretch=3)


PIECES = ["a", "ab", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x85", "\x1c", "é", "漢字", "7", "42", "½", "!?", "<|endoftext|>", "\U0001F600", "é"]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=40).map("".join)))
def test_cut_texts_have_the_ids_of_whole_ones(library, short, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert short.encode(text).tolist() == library.encode_ordinary(text)
    assert "".join(p for p, _ in short.stretches(text)) == text
    assert short.decode(short.encode(text).tobytes()) == text.encode()


@pytest.mark.parametrize("text", [
    "word " * 60_000, "x" * 200_000, "ab1!" * 50_000, "a" + " " * 90_000 + "b", "\n" * 90_000, "a\n" * 90_000, "é " * 50_000 + "  ",
])
def test_long_texts(library, text):
    words = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    assert words.encode(text).tolist() == library.encode_ordinary(text)


def test_white_space_beyond_what_the_library_takes():
    words = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    text = "start" + " " * 2_000_000 + "end" + "\n" * 1_500_000
    ids = words.encode(text)
    # All but the last space are one match, and the last one goes with the word.
    want = [*words.encoding.encode_ordinary("start"), *words.encoding._encode_single_piece(b" " * 1_999_999), *words.encoding.encode_ordinary(" end"), *words.encoding._encode_single_piece(b"\n" * 1_500_000)]
    assert ids.tolist() == want and words.decode(ids.tobytes()) == text.encode()


def test_messy_rows_and_clashing_names(spark, messy, library):
    docs = messy.withColumnRenamed("bucket", "value").withColumnRenamed("payload", "c0").withColumnRenamed("rank", "token_ids").withColumnRenamed("key", "o0")
    out = bpe.decoded(bpe.encoded(docs, RANKS), RANKS)
    assert set(out.columns) == {*docs.columns, "n_tokens", "decoded"}
    rows = out.collect()
    assert len(rows) == messy.count()
    for r in rows:
        ids = np.frombuffer(r["token_ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]).decode() == (r["text"] or "") and (r["value"], r["c0"], r["o0"]) == (7, "p", "k")


def test_any_bytes_and_any_ids(spark):
    raw = spark.createDataFrame([(1, b"ok \xff\xfe bad"), (2, None)], "doc_id long, text binary")
    rows = {r["doc_id"]: r for r in bpe.decoded(bpe.encoded(raw, RANKS), RANKS).collect()}
    assert bytes(rows[1]["decoded"]).decode() == "ok �� bad" and rows[2]["n_tokens"] == 0
    random.seed(3)
    ids = np.array([random.randrange(50_256) for _ in range(500)], "<u4")
    frame = spark.createDataFrame([(bytearray(ids.tobytes()),), (None,)], "token_ids binary")
    got = [bytes(r["decoded"]) for r in bpe.decoded(frame, RANKS).collect()]
    table = bpe.Codec(RANKS, public_tokenizers.PATTERN).encoding
    assert sorted(got) == sorted([b"".join(table.decode_single_token_bytes(int(i)) for i in ids), b""])


def test_an_empty_table(empty):
    assert bpe.decoded(bpe.encoded(empty, RANKS), RANKS).count() == 0


def test_the_query_against_the_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    import hashlib

    want = {}
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        want[d["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
    got = QUERIES["op11_bpe_round_trip"](spark, small)
    assert got.filter(F.col("n_tokens") < 0).count() == 0
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()} == want
