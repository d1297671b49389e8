"""Token counts per document: pieces are counted once per distinct pre-token.

Map tasks turn blocks of documents into (a) the block's distinct pre-tokens, dealt into buckets
by their hash, and (b) each document's pre-token frequencies as local numbers. Bucket tasks
count the pieces of each distinct pre-token once and send one small number per pre-token and
block back; a block's numbers and frequencies meet again and are multiplied and summed. Token ids
of documents are never built, and a very frequent pre-token costs one entry per block only.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; rows that repeat come
out as often as they went in; special strings inside texts count one token each, as the library
has it; an empty table gives an empty result; extra columns are ignored, whatever their names.
A text of any length is one document of one block.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscore.llm.common import cut
from folioscore.llm.pretokens import slices, vocabulary

BUCKETS = 64
BLOCK_CHARS = 12_000_000
ROWS = "block string, bucket int, payload binary"


def _packed(*arrays: np.ndarray, level: int = 1) -> bytes:
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = b"".join(a.tobytes() for a in arrays)
    return zlib.compress(len(head).to_bytes(4, "little") + head + body, level)


def _unpacked(payload: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(payload)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for kind, size in json.loads(raw[4:at]):
        a = np.frombuffer(raw, kind, size, at)
        out.append(a)
        at += a.nbytes
    return out


def _block(ids: list, texts: list, words, buckets: int, name: str):
    """The rows of one block: its dictionary by bucket, and its documents under bucket -1."""
    known: dict[str, int] = {}
    number = lambda p: known.setdefault(p, len(known))
    local, counts, ends, special, sizes = [], [], [], [], []
    total = 0
    for text in texts:
        seen: Counter = Counter()
        extra = 0
        for mark, pieces in words.parts(text or ""):
            extra += mark is not None
            seen.update(pieces)
        for p in seen:
            number(p)
        mine = np.fromiter(map(known.__getitem__, seen), np.uint32, len(seen))
        often = np.fromiter(seen.values(), np.uint32, len(seen))
        by = np.argsort(mine)
        mine = mine[by]
        local.append(np.diff(mine, prepend=np.uint32(0)).astype(np.uint32))
        counts.append(often[by])
        total += len(seen)
        ends.append(total)
        special.append(extra)
        sizes.append(len((text or "").encode()))
    shares: list[list[str]] = [[] for _ in range(buckets)]
    place = np.empty(len(known), np.uint32)
    home = np.empty(len(known), np.uint32)
    for p, i in known.items():
        b = zlib.crc32(p.encode()) % buckets
        home[i], place[i] = b, len(shares[b])
        shares[b].append(p)
    for b, share in enumerate(shares):
        if share:
            yield name, b, zlib.compress(json.dumps(share, ensure_ascii=False).encode(), 1)
    join = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.uint32)
    nulls = np.array([i is None for i in ids], np.uint8)
    yield name, -1, _packed(
        np.array([0 if i is None else i for i in ids], np.int64), nulls, np.array(ends, np.int64), join(local),
        join(counts), np.array(special, np.int64), np.array(sizes, np.int64), home, place,
    )


def _dictionaries(path: str, buckets: int, block_chars: int):
    def run(batches):
        import hashlib

        words = vocabulary(path)
        ids: list = []
        texts: list = []
        held = 0

        def flush():
            # The name follows from the content, so a task that runs again names alike.
            digest = hashlib.blake2b(repr(ids).encode(), digest_size=12)
            for t in texts:
                digest.update(zlib.crc32((t or "").encode()).to_bytes(4, "little"))
            rows = list(_block(ids, texts, words, buckets, digest.hexdigest()))
            for at in range(0, len(rows), 32):
                part = rows[at:at + 32]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())],
                    ["block", "bucket", "payload"],
                )

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                held += len(t or "")
                if held >= block_chars:
                    yield from flush()
                    ids, texts, held = [], [], 0
        if ids:
            yield from flush()

    return run


def _pieces_of(path: str):
    """Bucket side: the number of pieces of every listed pre-token, each counted once."""

    def run(batches):
        words = vocabulary(path)
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for payload in batch.column(2).to_pylist():
                share = json.loads(zlib.decompress(payload))
                if len(known) > 1_000_000:
                    known.clear()
                new = [p for p in share if p not in known]
                for at in range(0, len(new), 4096):
                    part = new[at:at + 4096]
                    known.update(zip(part, map(len, words.fresh(part))))
                out.append(_packed(np.fromiter(map(known.__getitem__, share), np.uint32, len(share))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "payload"])

    return run


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: the documents' frequencies times the pieces of their pre-tokens.

    Blocks of equal content share a name; their documents come out once for each.
    """
    pieces = {}
    frames = []
    for bucket, payload in zip(rows["bucket"], rows["payload"]):
        if bucket >= 0:
            pieces[bucket] = _unpacked(payload)[0]
    for bucket, payload in zip(rows["bucket"], rows["payload"]):
        if bucket >= 0:
            continue
        ids, nulls, ends, local, counts, special, sizes, home, place = _unpacked(payload)
        each = np.zeros(len(home), np.int64)
        for b, values in pieces.items():
            mine = home == b
            each[mine] = values[place[mine]]
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        # Local numbers are kept as differences that start anew in each document.
        run = np.cumsum(local.astype(np.int64))
        lengths = ends - starts
        before = np.where(starts > 0, run[np.maximum(starts, 1) - 1] if len(run) else 0, 0)
        number = run - np.repeat(before, lengths)
        sums = np.concatenate(([0], np.cumsum(each[number] * counts)))
        frames.append(pd.DataFrame({
            "doc_id": pd.array(np.where(nulls == 1, 0, ids), "Int64"), "n_bytes": sizes,
            "n_tokens": sums[ends] - sums[starts] + special,
        }).assign(doc_id=lambda f: f["doc_id"].mask(nulls == 1)))
    return pd.concat(frames) if frames else pd.DataFrame({"doc_id": pd.array([], "Int64"), "n_bytes": [], "n_tokens": []})


def token_counts(
    docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text",
    buckets: int = BUCKETS, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of `docs`."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    blocks = cut(rows.mapInArrow(_dictionaries(tokenizer_path, buckets, block_chars), ROWS))
    dealt = blocks.filter("bucket >= 0").repartition("bucket")
    counted = dealt.mapInArrow(_pieces_of(tokenizer_path), ROWS)
    both = counted.unionByName(blocks.filter("bucket < 0"))
    return both.groupBy("block").applyInPandas(_totals, "doc_id long, n_bytes long, n_tokens long")
