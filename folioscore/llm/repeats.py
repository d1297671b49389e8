"""Removes byte strings that also start in an earlier document, by suffix grouping.

Every 50-byte string has an anchor: of its 24-byte substrings, the first with the smallest hash.
Equal strings have equal anchors, so neighbouring strings with one anchor travel together as one
short run of bytes, and runs with equal anchors meet in one bucket, wherever they stand. First only
the anchors' hashes travel; a bucket answers with one bit for each: whether any other document has
it. Only runs with a shared anchor follow. In a bucket, equal runs are one; a string whose hash
occurs in one run only cannot repeat and is cut off the run's ends. The runs of one anchor that
still differ are joined into a text whose suffix array decides which strings are equal.

The suffix array is built by linear grouping: suffixes start grouped by their first symbol; groups
are processed in descending order, each suffix hands its group to the nearest earlier suffix of a
smaller group (its previous-smaller pointer), and those that were handed something leave their
group for higher ones. Then every group holds the suffixes of one Lyndon prefix, and one ascending
pass along the pointers emits the order inside the groups, with no recursion on a renamed text.

A document equal to an earlier one goes as a whole, by its digest. Texts are read whole, matches
never cross documents, and strings are judged on the input.

Defined results: a null text is empty; texts shorter than the length lose nothing; rows that repeat
an id do not remove each other and come out as often as they went in; rows without an id come before
all others; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscore.llm.common import RangeHash, cut
from folioscore.llm.token_counts import _packed, _unpacked

LENGTH = 50
ANCHOR = 24
PIECE = 64
AT_ONCE = 8192  # runs whose bytes are hashed at a time
BUCKETS = 64
BUCKET_BYTES = 32_000_000
BLOCK_BYTES = 3_000_000
FIRST = -(2**63)
ROWS = "block string, bucket int, payload binary"


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array by linear grouping; the last symbol must be the unique smallest one."""
    n = len(text)
    symbols = sorted(set(text))
    number = {s: i for i, s in enumerate(symbols)}
    members: list[list[int]] = [[] for _ in symbols]
    group = [0] * n
    for i, s in enumerate(text):
        g = number[s]
        group[i] = g
        members[g].append(i)
    # A doubly linked list of groups in ascending order.
    up = [g + 1 for g in range(len(symbols))]
    up[-1] = -1
    down = [g - 1 for g in range(len(symbols))]
    done = bytearray(n)
    smaller = [-1] * n  # the nearest earlier suffix of a smaller group
    jump = [-1] * n
    order: list[int] = []
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        if own:
            order.append(g)
            for i in own:
                done[i] = 1
            moved: dict[int, dict[int, list[int]]] = {}
            last, times = -1, 0
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = jump[j]
                smaller[i] = jump[i] = j
                # Shorten the way for those behind.
                k = i - 1
                while k >= 0 and done[k] and jump[k] != j:
                    jump[k], k = j, jump[k]
                if j == last:
                    times += 1
                else:
                    if last >= 0:
                        moved.setdefault(group[last], {}).setdefault(times, []).append(last)
                    last, times = j, 1
            if last >= 0:
                moved.setdefault(group[last], {}).setdefault(times, []).append(last)
            for old, by_times in moved.items():
                below = old
                for t in sorted(by_times):  # more handed over, higher group
                    new = len(members)
                    members.append(by_times[t])
                    for p in by_times[t]:
                        group[p] = new
                    above = up[below]
                    up.append(above)
                    down.append(below)
                    up[below] = new
                    if above >= 0:
                        down[above] = new
                    below = new
        g = down[g]
    # Where each group starts; groups were met from the highest down.
    free = [0] * len(members)
    at = n
    for g in order:
        at -= len(members[g])
        free[g] = at
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = 1
            s = smaller[s]
    return out


def first_owners(runs: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For every run, the smallest owner of each of its strings among all runs."""
    sizes = [len(r) for r in runs]
    starts = np.cumsum([0] + [s + 1 for s in sizes])
    text: list[int] = []
    for r in runs:
        text += [b + 2 for b in r]
        text.append(1)
    text.append(0)
    order = np.array(suffix_array(text), np.int64)
    # Only suffixes that begin a whole string inside their run.
    run = np.searchsorted(starts, order, side="right") - 1
    run = np.minimum(run, len(runs) - 1)
    ends = starts[run] + np.array(sizes)[run]
    whole = order + length <= ends
    order, run = order[whole], run[whole]
    data = np.array(text, np.uint16)
    window = np.lib.stride_tricks.sliding_window_view(data, length)
    new = np.ones(len(order), bool)
    for at in range(1, len(order), 65536):
        upto = min(len(order), at + 65536)
        new[at:upto] = (window[order[at:upto]] != window[order[at - 1:upto - 1]]).any(1)
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(owners[run], heads)
    value = np.empty(len(data), np.int64)
    value[order] = least[np.cumsum(new) - 1]
    return [value[s:s + k - length + 1] for s, k in zip(starts, sizes)]


def anchored_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(first string, last string, anchor hash, document) of each run of strings with one anchor."""
    n, wide = len(data), length - anchor + 1
    none = (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    if n < length:
        return none
    at = np.arange(n - anchor + 1)
    least = RangeHash(data).of(at, at + anchor)
    width = 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[:len(least) - (wide - width)], least[wide - width:])
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:len(least)]
    inside = np.arange(len(least)) + length <= ends[doc]
    change = np.r_[True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(least)] - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    # Periodic bytes repeat their anchor on and on; their runs are cut into pieces.
    pieces = (last - first) // PIECE + 1
    step = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
    first, last = np.repeat(first, pieces) + step, np.repeat(last, pieces)
    last = np.minimum(last, first + PIECE - 1)
    return first, last, least[first], doc[first]


def anchors_of(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor hash of each run, from the bytes of its first string."""
    begin, out = np.cumsum(sizes) - sizes, []
    for i in range(0, len(sizes), AT_ONCE):
        first = begin[i:i + AT_ONCE]
        part = data[first[0]:first[-1] + sizes[i:i + AT_ONCE][-1]]
        at = (first - first[0])[:, None] + np.arange(length - anchor + 1)
        out.append(RangeHash(part).of(at, at + anchor).min(1))
    return np.concatenate(out)


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each hash travel, besides its bucket. A chance collision only costs a comparison."""
    return (hashes >> np.uint64(32)).astype(np.uint32)


def _homes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


class Block:
    """Some documents' bytes, and the anchors that each of them has."""

    def __init__(self, texts: list[bytes], buckets: int):
        self.texts = texts
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.first, self.last, self.hashes, self.doc = anchored_runs(self.data, self.ends)
        # The anchors of each document once, by bucket, then by document.
        self.home = _homes(self.hashes, buckets)
        short = _short(self.hashes)
        order = np.lexsort((short, self.doc, self.home))
        h, d, s = self.home[order], self.doc[order], short[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])] if len(order) else np.empty(0, bool)
        self.distinct = np.empty(len(order), np.int64)
        self.distinct[order] = np.cumsum(new) - 1  # each run's place in the list of anchors
        self.homes, self.docs, self.shorts = h[new], d[new], s[new]


def _digests(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=16).digest() for t in texts), np.uint64).reshape(-1, 2)


def _anchors(buckets: int):
    """Map side: a block's texts under bucket -1, and its anchors and digests by bucket."""

    def run(batches):
        def block_of(ids: list, texts: list[bytes]):
            digest = hashlib.blake2b(repr(ids).encode(), digest_size=12)
            for t in texts:
                digest.update(zlib.crc32(t).to_bytes(4, "little"))
            name = digest.hexdigest()
            numbers = np.array([FIRST if i is None else i for i in ids], np.int64)
            block, whole = Block(texts, buckets), _digests(texts)
            lengths = np.array([len(t) for t in texts], np.int64)
            nulls = np.array([i is None for i in ids], np.uint8)
            rows = [(name, -1, _packed(numbers, nulls, lengths, block.data, level=4))]
            home = (whole[:, 0] % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(np.concatenate([block.homes, home])).tolist():
                i, j = np.searchsorted(block.homes, [b, b + 1])
                s, mine = block.shorts[i:j], np.flatnonzero(home == b)
                rows.append((name, b, _packed(
                    s, whole[mine, 0], whole[mine, 1], numbers[mine],
                )))
            for at in range(0, len(rows), 16):
                part = rows[at:at + 16]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part]), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())],
                    ["block", "bucket", "payload"],
                )

        ids: list = []
        texts: list[bytes] = []
        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield from block_of(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield from block_of(ids, texts)

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: a bit for each anchor (other documents have it), a byte for each digest (copy)."""
    parts = [_unpacked(p) for p in rows["payload"]]
    shorts = [p[0] for p in parts]
    every = np.sort(np.concatenate(shorts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    whole = pd.DataFrame({"a": np.concatenate([p[1] for p in parts]), "b": np.concatenate([p[2] for p in parts]), "id": np.concatenate([p[3] for p in parts])})
    copy = (whole.groupby(["a", "b"])["id"].transform("min") < whole["id"]).to_numpy().astype(np.uint8)
    out, at = [], 0
    for s, p in zip(shorts, parts):
        place = np.searchsorted(twice, s).clip(0, max(0, len(twice) - 1))
        hit = twice[place] == s if len(twice) else np.zeros(len(s), bool)
        out.append(_packed(np.packbits(hit), np.array([len(hit)], np.int64), copy[at:at + len(p[3])]))
        at += len(p[3])
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "payload": pd.Series(out, dtype=object)})


def _opened(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(ids, nulls, texts, lengths) of a block's documents; blocks of equal content follow each other."""
    held = [_unpacked(p) for b, p in zip(rows["bucket"], rows["payload"]) if b == -1]
    ids, nulls, lengths, data = held[0]
    raw, ends = data.tobytes(), np.cumsum(lengths)
    return ids, nulls, [raw[e - k:e] for e, k in zip(ends.tolist(), lengths.tolist())], lengths


def _copies(rows: pd.DataFrame, texts: list[bytes], buckets: int) -> np.ndarray:
    copy = np.zeros(len(texts), bool)
    home = (_digests(texts)[:, 0] % np.uint64(buckets)).astype(np.int64)
    for b, p in zip(rows["bucket"], rows["payload"]):
        if b >= 0:
            copy[home == b] = _unpacked(p)[2]
    return copy


def _runs(buckets: int):
    """One block: the runs whose anchor is shared, for the buckets of their anchors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["block", "bucket"])
        ids, _, texts, _ = _opened(rows)
        block, copy = Block(texts, buckets), _copies(rows, texts, buckets)
        shared = np.zeros(len(block.homes), bool)
        for b, p in zip(rows["bucket"], rows["payload"]):
            if b >= 0:
                bits, count, _ = _unpacked(p)
                i, j = np.searchsorted(block.homes, [b, b + 1])
                shared[i:j] = np.unpackbits(bits, count=int(count[0]))
        chosen = np.flatnonzero(shared[block.distinct] & ~copy[block.doc]) if len(block.first) else np.empty(0, np.int64)
        chosen = chosen[np.argsort(block.home[chosen], kind="stable")]
        out = {"block": [], "bucket": [], "payload": []}
        begin = np.concatenate(([0], block.ends[:-1]))
        homes = block.home[chosen]
        for b in np.unique(homes).tolist():
            i, j = np.searchsorted(homes, [b, b + 1])
            mine = chosen[i:j]
            start, size = block.first[mine], block.last[mine] - block.first[mine] + LENGTH
            offset = np.cumsum(size) - size
            taken = block.data[np.repeat(start - offset, size) + np.arange(size.sum())]
            d = block.doc[mine]
            out["block"].append(rows["block"].iloc[0])
            out["bucket"].append(b)
            out["payload"].append(_packed(
                ids[d], d.astype(np.uint32), (start - begin[d]).astype(np.int64), size.astype(np.uint8), taken, level=5,
            ))
        return pd.DataFrame({k: pd.Series(v, dtype=object if k != "bucket" else np.int32) for k, v in out.items()})

    return run


def _padded(data: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Ragged byte strings as rows of one length, each ending with its own length."""
    out = np.zeros((len(size), width + 1), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)] = data
    out[:, width] = size
    return out


def _distinct(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the distinct row, one place of each) for byte rows within groups; exact."""
    keyed = np.concatenate([group.astype(">u8").view(np.uint8).reshape(-1, 8), rows], 1)
    keyed = np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel()
    _, place, back = np.unique(keyed, return_index=True, return_inverse=True)
    return back, place


def repeated_strings(hashes: np.ndarray, owners: np.ndarray, sizes: np.ndarray, data: np.ndarray):
    """(run, first, one past the last byte) of the stretches of runs that smaller owners hold too."""
    sizes = sizes.astype(np.int64)
    width = int(sizes.max())
    rows = _padded(data, sizes, width)
    number, place = _distinct(hashes, rows)
    least = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(least, number, owners)
    whole = np.flatnonzero(owners > least[number])
    found = [(whole, np.zeros(len(whole), np.int64), sizes[whole].astype(np.int64))]
    # From here on: distinct runs of anchors that have several.
    anchor = hashes[place]
    order = np.argsort(anchor, kind="stable")
    change = np.r_[True, anchor[order][1:] != anchor[order][:-1]]
    count = np.diff(np.r_[np.flatnonzero(change), len(order)])
    several = np.zeros(len(place), bool)
    several[order] = np.repeat(count > 1, count)
    some = np.flatnonzero(several)
    if not len(some):
        return _joined(found)
    size = sizes[place[some]].astype(np.int64)
    strings = size - LENGTH + 1
    flat = rows[place[some], :width].ravel()
    del rows
    parts = []
    for i in range(0, len(some), AT_ONCE):
        k = strings[i:i + AT_ONCE]
        run = np.repeat(np.arange(len(k)), k)
        at = run * width + np.arange(len(run)) - np.repeat(np.cumsum(k) - k, k)
        parts.append(RangeHash(flat[i * width:(i + len(k)) * width]).of(at, at + LENGTH) ^ anchor[some][i:i + AT_ONCE][run])
    keys = np.concatenate(parts)
    offset = (np.arange(len(keys)) - np.repeat(np.cumsum(strings) - strings, strings)).astype(np.int32)
    by = np.argsort(keys, kind="stable")
    same = keys[by][1:] == keys[by][:-1]
    maybe = np.zeros(len(keys), bool)
    maybe[by] = np.r_[same, False] | np.r_[False, same]
    # Cut strings that occur once off the ends; runs of which nothing is left are done.
    begin = np.minimum.reduceat(np.where(maybe, offset, width), np.cumsum(strings) - strings)
    end = np.maximum.reduceat(np.where(maybe, offset, -1), np.cumsum(strings) - strings)
    left = np.flatnonzero(end >= 0)
    if not len(left):
        return _joined(found)
    begin, end, some = begin[left], end[left], some[left]
    kept = end - begin + LENGTH
    source = np.repeat(left * width + begin - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())
    trimmed = _padded(flat[source], kept, width)
    piece, one = _distinct(anchor[some], trimmed)
    owner = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(owner, piece, least[some])
    # The runs of one anchor that still differ decide by their suffixes.
    answer: dict[int, np.ndarray] = {}
    mine = anchor[some][one]
    order = np.argsort(mine, kind="stable")
    bounds = np.flatnonzero(np.r_[True, mine[order][1:] != mine[order][:-1], True])
    waiting: list[int] = []

    def decide() -> None:
        if waiting:
            texts = [trimmed[one[k], :trimmed[one[k], width]].tobytes() for k in waiting]
            # Different anchors have no string in common, so they may share a text.
            answer.update(zip(list(waiting), first_owners(texts, owner[waiting])))
            waiting.clear()

    for i, j in zip(bounds[:-1], bounds[1:]):
        if j - i > 1:
            waiting += order[i:j].tolist()
            if len(waiting) > 3000:
                decide()
    decide()
    runs, firsts, ends = [], [], []
    of_distinct = {int(d): k for k, d in enumerate(some.tolist())}
    # The owners of distinct runs: other holders of the same run are removed as a whole above.
    holders = np.flatnonzero(owners == least[number])
    holders = holders[np.isin(number[holders], some)]
    for r in holders.tolist():
        k = of_distinct[int(number[r])]
        p = int(piece[k])
        held = answer.get(p)
        early = np.full(kept[k] - LENGTH + 1, owner[p]) if held is None else np.minimum(held, owner[p])
        hit = np.flatnonzero(early < owners[r])
        if len(hit):
            parts = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
            for a, b in zip(hit[parts], hit[np.r_[parts[1:], len(hit)] - 1]):
                runs.append(r)
                firsts.append(begin[k] + a)
                ends.append(begin[k] + b + LENGTH)
    found.append((np.array(runs, np.int64), np.array(firsts, np.int64), np.array(ends, np.int64)))
    return _joined(found)


def _joined(found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.concatenate(x) for x in zip(*found))


def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the stretches of its runs that smaller documents hold too, by block."""
    parts = [_unpacked(p) for p in rows["payload"]]
    owners, doc, start, size, data = (np.concatenate([p[i] for p in parts]) for i in range(5))
    hashes = anchors_of(data, size.astype(np.int64))
    block = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    run, first, end = repeated_strings(hashes, owners, size, data)
    order = np.argsort(block[run], kind="stable")
    run, first, end = run[order], first[order], end[order]
    cuts = np.searchsorted(block[run], np.arange(len(parts) + 1))
    out = [
        _packed(doc[run[i:j]], start[run[i:j]] + first[i:j], start[run[i:j]] + end[i:j]) for i, j in zip(cuts[:-1], cuts[1:])
    ]
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "payload": pd.Series(out, dtype=object)})


def _removed(buckets: int):
    """One block: what is left of each document."""

    def run(rows: pd.DataFrame, stretches: pd.DataFrame) -> pd.DataFrame:
        times = int((rows["bucket"] == -1).sum())
        ids, nulls, texts, lengths = _opened(rows)
        copy = _copies(rows, texts, buckets)
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(texts) else np.empty(0, np.int64)
        step = np.zeros(int(lengths.sum()) + 1, np.int32)
        for p in stretches["payload"]:
            doc, first, end = _unpacked(p)
            np.add.at(step, begin[doc] + first, 1)
            np.add.at(step, begin[doc] + end, -1)
        gone = np.cumsum(step)[:-1] > 0
        out = []
        for i, text in enumerate(texts):
            n = len(text)
            mask = gone[begin[i]:begin[i] + n]
            if copy[i] and n >= LENGTH:
                mask = np.ones(n, bool)
            spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if spans else text
            out.append((None if nulls[i] else str(ids[i]), n, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], dtype=object)
        return pd.concat([frame] * times)

    return run


def without_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    if buckets is None:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(BUCKETS, total // BUCKET_BYTES)
    blocks = cut(rows.mapInArrow(_anchors(buckets), ROWS))
    texts = blocks.filter("bucket = -1")
    bits = cut(blocks.filter("bucket >= 0").groupBy("bucket").applyInPandas(_shared, ROWS))
    asked = texts.unionByName(bits)
    runs = asked.groupBy("block").applyInPandas(_runs(buckets), ROWS)
    stretches = runs.groupBy("bucket").applyInPandas(_decide, ROWS)
    # The texts' shuffle is the one that the runs came from, so Spark reads it again.
    done = asked.groupBy("block").cogroup(stretches.groupBy("block")).applyInPandas(
        _removed(buckets), "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))
