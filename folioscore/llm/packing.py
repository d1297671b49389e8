"""Packs token sequences into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and pieces of at most `piece` ids. Full windows stand
alone. The other pieces are dealt into groups of about `group_windows` windows' worth, and each
group is divided into near-equal windows: every piece starts as a partition with one filled
window; again and again the two partitions with the largest imbalance are merged, the fullest
windows of one with the emptiest of the other. If a window comes out above the capacity, the
group is divided again into one window more.

Defined results: a null or empty text has only the end id; rows that repeat are packed as often as
they occur; ties between equal imbalances go by the pieces' order; an empty table gives an empty
result; extra columns are ignored, whatever their names; a text of any length is cut like others.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscore.llm.common import cut
from folioscore.llm.pretokens import slices, vocabulary

CAPACITY = 2048
PIECE = 512
GROUP_WINDOWS = 128
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, the windows' sums as equal as differencing makes them."""
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    sums: list = []
    heap = []
    for i, size in enumerate(sizes):
        filled = np.zeros(windows, np.int64)
        filled[-1] = size
        sums.append(filled)
        heap.append((-int(size) if windows > 1 else 0, i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        # Both are ascending: the fullest windows of one meet the emptiest of the other.
        merged = sums[a] + sums[b][::-1]
        order = np.argsort(merged, kind="stable")
        merged = merged[order]
        sums[a] = sums[b] = None
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(merged[-1] - merged[0]), len(sums)))
        sums.append(merged - merged[0])
    # From the last merge back to the pieces: which final window each slot has become.
    final = {len(sums) - 1: np.arange(windows)}
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        slots = np.empty(windows, np.int64)
        slots[order] = final.pop(node)
        final[a], final[b] = slots, slots[::-1]
    return np.array([final[i][-1] for i in range(n)], np.int64)


def divided(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each size; the number of windows rises until none exceeds the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, windows)
        if not len(sizes) or np.bincount(window, weights=sizes).max() <= capacity:
            return window
        windows += 1


def _cut_points(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: full windows, then short pieces."""
    full = n // capacity * capacity
    cuts = [(s, capacity) for s in range(0, full, capacity)]
    return cuts + [(s, min(piece, n - s)) for s in range(full, n, piece)]


def _pieces(path: str, capacity: int, piece: int, end_id: int):
    def run(batches):
        words = vocabulary(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                rows: list[list] = [[], [], [], [], []]
                for doc_id, raw in zip(ids[a:b], words.encode(texts[a:b])):
                    raw += end
                    n = len(raw) // 4
                    view = memoryview(raw)
                    for s, k in _cut_points(n, capacity, piece):
                        for column, value in zip(rows, (doc_id, s, k, zlib.crc32(view[4 * s:4 * (s + k)]), n)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    return run


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row").reset_index(drop=True)
        sizes = group["length"].to_numpy()
        window = divided(sizes, capacity)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.r_[True, window[order][1:] != window[order][:-1]]
        begin = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        offset = np.empty(len(group), np.int64)
        offset[order] = ends - sizes[order] - begin
        # Even numbers; the full windows have the odd ones.
        group["sequence_id"] = ((group["pack"].to_numpy() << 32) + window) * 2
        group["offset"] = offset
        return group.drop(columns=["pack", "row"])

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text",
    capacity: int = CAPACITY, piece: int = PIECE, group_windows: int = GROUP_WINDOWS, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    pieces = cut(rows.mapInArrow(_pieces(tokenizer_path, capacity, piece, end_id), PIECES)).withColumn(
        "row", F.monotonically_increasing_id()
    )
    short = pieces.filter(F.col("length") < capacity)
    # One number: how many groups of bounded size the short pieces make.
    held = short.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-held // (capacity * group_windows)))
    dealt = short.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)))
    # As text, so that a null id does not turn the others into doubles.
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = f"{PIECES}, sequence_id long, offset long".replace("doc_id long", "doc_id string")
    packed = dealt.groupBy("pack").applyInPandas(_pack(capacity), schema)
    packed = packed.withColumn("doc_id", F.col("doc_id").cast("long"))
    full = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": F.col("row") * 2 + 1, "offset": F.lit(0).cast("long")}
    ).drop("row")
    return packed.unionByName(full)
