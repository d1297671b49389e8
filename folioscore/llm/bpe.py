"""Byte-level BPE by a rank file: whole texts to token ids, and ids back to bytes.

The tiktoken library encodes and decodes; the rank file is read in each worker from a local path.
A text of more than `stretch` characters is first cut where no match of the splitting pattern can
reach across: before a white space that follows another character, and before the last white
space of a run that other characters follow. So a text of any length is encoded piece by piece,
and a run of white space that the library's pattern cannot take in one go becomes one piece of
its own, which is what the pattern makes of it.

Defined results: a null text counts as empty and has no ids; bytes that are not UTF-8 count as
U+FFFD; strings of special tokens are ordinary text; null ids decode to no bytes; an id that the
rank file lacks is an error. Rows that repeat come out as often as they went in; an empty table
gives an empty result; other columns are kept, one that has the name of an output is replaced.
"""

from __future__ import annotations

import base64
import sys
import types

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

STRETCH = 32_768
# Rows of one Arrow batch that are handed on together: bounded by characters, not by rows.
BATCH_CHARS = 8_000_000
# The library's `\s` is the Unicode property.
SPACE, OTHER = r"\p{White_Space}", r"\P{White_Space}"


class Codec:
    """The library with one rank file and one splitting pattern."""

    def __init__(self, ranks: str, pattern: str, stretch: int = STRETCH):
        import regex
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.stretch = stretch
        self.edge = regex.compile(f"{OTHER}(?={SPACE})")
        self.run = regex.compile(f"{SPACE}{{{stretch},}}")

    def stretches(self, text: str):
        """(part, whether it is one match of the pattern) whose ids, joined, are those of the text."""
        at = 0
        while len(text) - at > self.stretch:
            # The first character followed by white space, `stretch` characters on.
            edge = self.edge.search(text, at + self.stretch - 1)
            end = edge.end() if edge else len(text)
            if end - at >= 2 * self.stretch:
                blank = self.run.search(text, at, end if edge else len(text))
                if blank:
                    if blank.start() > at:
                        yield text[at:blank.start()], False
                    # The last white space of a run belongs to what follows.
                    stop = blank.end() - (blank.end() < len(text))
                    yield text[blank.start():stop], True
                    at = stop
                    continue
            yield text[at:end], False
            at = end
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) <= self.stretch:
            return np.array(self.encoding.encode_ordinary(text), "<u4")
        whole = self.encoding._encode_single_piece
        ordinary = self.encoding.encode_ordinary
        return np.concatenate([
            np.array(whole(part.encode()) if single else ordinary(part), "<u4") for part, single in self.stretches(text)
        ])

    def decode(self, ids: bytes) -> bytes:
        return self.encoding.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def codec(ranks: str, pattern: str, stretch: int = STRETCH) -> Codec:
    """One per worker, file and pattern: workers are reused, and reading the file takes a while."""
    # This package travels by value, so its own globals do not outlive a task.
    kept = sys.modules.setdefault("_kept_bpe_codecs", types.ModuleType("_kept_bpe_codecs")).__dict__
    key = (ranks, pattern, stretch)
    if key not in kept:
        kept[key] = Codec(*key)
    return kept[key]


def _runs(sizes: list[int]):
    """(start, end) of runs of values of bounded total size, a larger value alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > BATCH_CHARS:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _mapped(df: DataFrame, source: str, outputs: dict[str, str], make) -> DataFrame:
    """`df` with the columns `outputs`, which `make` computes from the binary column `source`."""
    others = [c for c in df.columns if c not in outputs]
    # By position, so that no name of a further column can clash.
    kept = df.select(F.col(f"`{source}`").cast("binary"), *[F.col(f"`{c}`") for c in others]).toDF("value", *[f"c{i}" for i in range(len(others))])
    schema = kept.drop("value").schema
    for i, kind in enumerate(outputs.values()):
        schema = schema.add(f"o{i}", kind)

    def run(batches):
        compute = make()
        for batch in batches:
            values = batch.column(0).to_pylist()
            for a, b in _runs([len(v or b"") for v in values]):
                made = compute(values[a:b])
                columns = [c.slice(a, b - a) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, *made], schema.names)

    return kept.mapInArrow(run, schema).toDF(*others, *outputs)


def encoded(
    docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, *, text_column: str = "text",
    ids_column: str = "token_ids", count_column: str = "n_tokens", stretch: int = STRETCH,
) -> DataFrame:
    """`docs` with the ids of each text (binary, little-endian 32-bit) and their number."""

    def make():
        words = codec(ranks, pattern, stretch)

        def compute(texts):
            ids = [words.encode((t or b"").decode("utf-8", "replace")) for t in texts]
            return [pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64())]

        return compute

    return _mapped(docs, text_column, {ids_column: "binary", count_column: "long"}, make)


def decoded(
    rows: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, *, ids_column: str = "token_ids",
    bytes_column: str = "decoded", stretch: int = STRETCH,
) -> DataFrame:
    """`rows` with the bytes that the ids stand for; any ids decode, also such as cut a character."""

    def make():
        words = codec(ranks, pattern, stretch)
        return lambda ids: [pa.array([words.decode(i or b"") for i in ids], pa.binary())]

    return _mapped(rows, ids_column, {bytes_column: "binary"}, make)
