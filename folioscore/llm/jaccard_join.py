"""Similarity join on word shingles by chosen paths.

In each run a text picks, at random but alike for all texts, about 1 / threshold of its shingles:
a shingle of a text with k shingles is picked if its hash in this run is below 1 / (threshold * k).
Texts that pick the same shingle meet in a bucket. A bucket above `limit` is split again: its
texts pick among all their shingles anew, by a hash that depends on the path so far. A pair at the
threshold is expected to share at least one pick at every level, so in each run it stays together with
a probability of at least 1 - 1/e = 0.63 at the first level, 0.47 at the second and 0.37 at the third;
`runs_for` repeats runs until the target recall at the deepest level used. Texts that share only a
frequent passage part at the next level, as their picks rarely fall into it.

There are two rounds, each of which may miss half of what the recall allows. The first has one level:
a pair that meets in a bucket that is compared whole is found there. A pair that meets in other buckets
only has both texts in the second round, with runs of its own for `levels` levels over their texts.

Buckets up to `limit` are compared by brute force over 64-byte sketches, each in one row of a bounded
size: comparing a text with some thousand sketches costs less than the rows of its paths through all
levels. In larger ones, texts that
resemble the same one of a few pivots are candidates by way of it; all other pairs are compared in
tiles, one pair of chunks at a time, if they are at most `tiled` for each member or if no level is left to split
the bucket. Comparing only marks candidates and keeps a forest of them, so no bucket turns into rows of pairs. Then the texts of each candidate component are compared exactly,
all pairs of them, in tiles of bounded size: the Jaccard similarity of their shingle sets decides.

Equal texts are one node with a number of copies throughout, and one row of each takes part. Words are what ASCII white space
separates.

Defined results: a text that is null or has no word links with nothing; a text with fewer words than
a shingle has one shingle of all of them; rows that repeat come out as often as they went in and
count as copies; a class is named by its smallest id, nulls aside (null if it has no other); an
empty table gives an empty result; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscore.llm.common import cut, first_of_each as _first_of_each, mixed, own_name, shingle_hashes
from folioscore.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
LEVELS = 3
LIMIT = 4096
TILED = 512
SKETCH = 64
SLACK = 0.2  # below the threshold, four standard deviations of the sketch's estimate
CHUNK = 512
BLOCK = 1024
PIVOTS = 8
TILE = 256
ROWS = "path long, key string, held binary"


def runs_for(recall: float, levels: int = 1) -> int:
    """Runs after which a pair at the threshold is missed at `levels` levels with probability 1 - recall at most.

    A pair shares one pick or more at a level, as a Poisson number, and each must survive the levels below.
    """
    stays = 1.0
    for _ in range(levels):
        stays = 1 - math.exp(-stays)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - stays)))


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """One byte of the smallest hash in each of SKETCH parts of the hash range; 0 if there is none."""
    keys = mixed(hashes, 77)
    keys.sort()
    part = (keys >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else part
    out = np.zeros(SKETCH, np.uint8)
    out[part[first]] = 1 + (keys[first] & np.uint64(0xFFFF)) % np.uint64(255)
    return out


def _picks(hashes: np.ndarray, salts: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each salt, the new paths that lead to the text's picks."""
    bar = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(hashes)))))
    with np.errstate(over="ignore"):
        drawn = mixed(hashes[None, :] ^ mixed(salts)[:, None])
    return [row[row <= bar] for row in drawn]


def paths_of(hashes: np.ndarray, runs: int, threshold: float, levels: int, start: int = 1) -> list[tuple[int, bytes]]:
    """(path of the first level, its deeper paths as nested [count, path, ...] numbers), runs numbered from `start`."""

    def below(paths: np.ndarray, level: int) -> list[list]:
        if level > levels or not len(paths):
            return [[0] for _ in paths]
        found = _picks(hashes, paths, threshold)
        nested = below(np.concatenate(found), level + 1)
        out, at = [], 0
        for mine in found:
            flat = [len(mine)]
            for p in mine.tolist():
                flat.append(p)
                flat += nested[at]
                at += 1
            out.append(flat)
        return out

    first = np.concatenate(_picks(hashes, np.arange(start, start + runs, dtype=np.uint64), threshold))
    return [(p, np.array(kids, np.uint64).tobytes()) for p, kids in zip(first.tolist(), below(first, 2))]


def _batch(paths: list, keys: list, held: list) -> pa.RecordBatch:
    signed = np.array(paths, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed), pa.array(keys, pa.string()), pa.array(held, pa.binary())], ["path", "key", "held"])


def _first_paths(words: int, runs: int, threshold: float, levels: int, start: int):
    def run(batches):
        for batch in _first_of_each(batches):
            paths, keys, held = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingle_hashes(text, words)
                if not len(hashes):
                    continue
                head = len(hashes).to_bytes(8, "little") + sketch_of(hashes).tobytes()
                for path, kids in paths_of(hashes, runs, threshold, levels, start):
                    paths.append(path)
                    keys.append(key)
                    held.append(head + kids)
                if len(paths) > 20_000:
                    yield _batch(paths, keys, held)
                    paths, keys, held = [], [], []
            yield _batch(paths, keys, held)

    return run


def _next_paths(batches):
    """Rows of large buckets, one level down."""
    for batch in batches:
        paths, keys, held = [], [], []
        for key, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            head, kids = data[:8 + SKETCH], np.frombuffer(data, np.uint64, offset=8 + SKETCH).tolist()

            def skip(at: int) -> int:
                count, at = kids[at], at + 1
                for _ in range(count):
                    at = skip(at + 1)
                return at

            at = 1
            for _ in range(kids[0]):
                end = skip(at + 1)
                paths.append(kids[at])
                keys.append(key)
                held.append(head + np.array(kids[at + 1:end], np.uint64).tobytes())
                at = end
        yield _batch(paths, keys, held)


def _similar(held: list[bytes], threshold: float) -> np.ndarray:
    """(n, n): which pairs may reach the threshold, by sizes and sketches."""
    if len(held) <= 2 * BLOCK:
        return _similar_block(held, threshold)
    # Pairs of blocks, so that the numbers of a large bucket never lie in memory at once.
    near = np.zeros((len(held), len(held)), bool)
    starts = range(0, len(held), BLOCK)
    for i in starts:
        for j in starts[i // BLOCK + 1:]:
            a, b = held[i:i + BLOCK], held[j:j + BLOCK]
            found = _similar_block(a + b, threshold)
            near[i:i + len(a), i:i + len(a)] = found[:len(a), :len(a)]
            near[i:i + len(a), j:j + len(b)] = found[:len(a), len(a):]
            near[j:j + len(b), i:i + len(a)] = found[len(a):, :len(a)]
            near[j:j + len(b), j:j + len(b)] = found[len(a):, len(a):]
    return near


def _similar_block(held: list[bytes], threshold: float) -> np.ndarray:
    sizes = np.array([int.from_bytes(h[:8], "little") for h in held], np.float64)
    sketches = np.frombuffer(b"".join(h[8:8 + SKETCH] for h in held), np.uint8).reshape(len(held), SKETCH)
    fits = np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes)
    some = sketches > 0
    if len(held) <= 48:
        known = (some[:, None] | some[None, :]).sum(-1)
        equal = ((sketches[:, None] == sketches[None, :]) & some[:, None]).sum(-1)
    else:
        filled, both = some.sum(1), some.astype(np.float32)
        known = np.add.outer(filled, filled) - (both @ both.T).astype(np.int64)
        # An empty part equals nothing, so it has another number on either side; 64 parts fit a byte.
        left, right = (np.where(some, sketches, empty).astype(np.uint16).T.copy() for empty in (256, 257))
        equal = np.zeros(fits.shape, np.uint8)
        for mine, other in zip(left, right):
            equal += mine[:, None] == other[None, :]
    # Few parts filled: the estimate says little, so the exact comparison decides.
    return fits & ((equal >= (threshold - SLACK) * known) | (known < 16))


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of an adjacency matrix."""
    left, out = np.ones(len(near), bool), []
    for root in range(len(near)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            i = todo.pop()
            fresh = np.flatnonzero(near[i] & left).tolist()
            left[fresh] = False
            out += [(i, j) for j in fresh]
            todo += fresh
    return out


def _compare(threshold: float):
    """Each row is one bucket or chunk: lists of keys and of what is held of them."""

    def run(batches):
        for batch in batches:
            a, b, met = [], [], set()
            for keys, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = dict(zip(keys, held))  # a text may pick a path twice
                keys = tuple(sorted(one))
                # The same texts meet again in other runs.
                if len(keys) < 2 or keys in met:
                    continue
                met.add(keys)
                for i, j in _forest(_similar([one[k] for k in keys], threshold)):
                    a.append(keys[i])
                    b.append(keys[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    return run


def _listed(rows: DataFrame, *keys: str) -> DataFrame:
    """Buckets of bounded size as rows of two lists."""
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("key", "held")).alias("m")).select(F.col("m.key").alias("keys"), F.col("m.held").alias("held"))


def _bucketed(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two or more, with their number `n`."""
    counts = rows.groupBy(F.col("path").alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(counts, F.col("path") == F.col("k")).drop("k")


def _compared(buckets: DataFrame, threshold: float) -> DataFrame:
    return buckets.mapInArrow(_compare(threshold), "a string, b string")


def candidate_edges(rows: DataFrame, threshold: float, levels: int, limit: int, chunk: int, tiled: int = TILED) -> DataFrame:
    """Pairs of keys that may be similar: a forest of every bucket's."""
    edges = None
    for level in range(1, levels + 1):
        tagged = _bucketed(rows)
        found = _compared(_listed(tagged.filter(F.col("n") <= limit), "path"), threshold)
        edges = found if edges is None else edges.unionByName(found)
        found, rest = large_edges(tagged.filter(F.col("n") > limit).drop("n"), threshold, tiled if level < levels else None, chunk)
        edges = edges.unionByName(found)
        if level < levels:
            rows = cut(rest.mapInArrow(_next_paths, ROWS))
    return edges


def _labelled(threshold: float):
    """Each row is one chunk of a bucket and its pivots: members that resemble a pivot get the number of the
    first pivot that similar pivots connect it with, others -1."""

    def run(batches):
        for batch in batches:
            for path, keys, held, heads, pivots in zip(*(batch.column(i).to_pylist() for i in range(5))):
                near = _similar(pivots + held, threshold)
                among = near[:len(pivots), :len(pivots)]
                root = np.arange(len(pivots))
                for _ in pivots:
                    root = np.minimum(root, np.where(among, root[None, :], len(pivots)).min(1))
                near = near[len(pivots):, :len(pivots)]
                label = np.where(near.any(1), root[near.argmax(1)], -1)
                # A pivot belongs to its own connected pivots, whatever else it resembles.
                own = {k: root[i] for i, k in enumerate(heads)}
                label = np.array([own.get(k, old) for k, old in zip(keys, label.tolist())], np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path] * len(keys), pa.int64()), pa.array(keys, pa.string()), pa.array(held, pa.binary()),
                    pa.array(label), pa.array([heads[i] if i >= 0 else None for i in label.tolist()], pa.string()),
                ], ["path", "key", "held", "label", "pivot"])

    return run


def large_edges(rows: DataFrame, threshold: float, limit: int | None, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(edges of large buckets, rows of those that are left to split).

    Members that pivots connect are candidates by way of them. The other pairs meet in tiles, all of
    them, in every bucket where they are at most `limit` for each member; without a limit, in every one.
    """
    once = cut(rows.groupBy("path", "key").agg(F.first("held").alias("held")))
    sizes = once.groupBy(F.col("path").alias("k")).agg(F.count("*").alias("n"))
    dealt = once.join(sizes, F.col("path") == F.col("k")).drop("k")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / chunk)).cast("int"))
    pivots = once.groupBy(F.col("path").alias("k"), F.pmod(F.xxhash64("key", F.lit(3)), F.lit(PIVOTS)).alias("p")).agg(F.min(F.struct("key", "held")).alias("r"))
    pivots = pivots.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("p", "r"))).alias("r"))
    lists = dealt.groupBy("path", "chunk").agg(F.collect_list(F.struct("key", "held")).alias("m")).join(pivots, F.col("path") == F.col("k"))
    labelled = cut(lists.select(
        "path", F.col("m.key").alias("keys"), F.col("m.held").alias("held"), F.col("r.r.key").alias("heads"), F.col("r.r.held").alias("pivots"),
    ).mapInArrow(_labelled(threshold), "path long, key string, held binary, label int, pivot string"))
    by_pivot = labelled.filter("pivot IS NOT NULL AND pivot != key").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    counts = labelled.groupBy(F.col("path").alias("k"), F.col("label").alias("l")).agg(F.count("*").alias("m"))
    # Chunks of members with the same label; two chunks of one pivot need no tile.
    part = F.struct(F.col("l").alias("label"), F.ceil(F.col("m") / chunk).cast("int").alias("parts"), F.col("m").alias("m"))
    counts = counts.groupBy("k").agg(
        F.sum("m").alias("n"), F.sum(F.when(F.col("l") >= 0, F.col("m") * F.col("m")).otherwise(0)).alias("joined"), F.collect_list(part).alias("labels"),
    )
    few = F.lit(True) if limit is None else F.col("n") * F.col("n") - F.col("joined") <= 2 * limit * F.col("n")
    placed = labelled.join(counts.withColumn("few", few), F.col("path") == F.col("k")).drop("k")
    rest = placed.filter(~F.col("few")).select("path", "key", "held")
    mine = F.filter("labels", lambda x: x.label == F.col("label"))[0].parts
    others = F.flatten(F.transform("labels", lambda x: F.transform(
        F.sequence(F.lit(0), x.parts - 1), lambda c: F.struct(x.label.alias("label"), c.alias("c"))
    )))
    met = placed.filter("few").withColumn("own", F.struct("label", F.pmod(F.xxhash64("key", F.lit(5)), mine).cast("int").alias("c")))
    met = met.withColumn("other", F.explode(F.filter(others, lambda o: (F.col("label") < 0) | (o.label != F.col("label")))))
    met = met.select("path", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "key", F.substring("held", 1, 8 + SKETCH).alias("held"))
    return by_pivot.unionByName(_compared(_listed(met, "path", "low", "high"), threshold)), rest


def candidates_of(
    texts: DataFrame, words: int, threshold: float, recall: float, levels: int, limit: int, chunk: int, tiled: int = TILED,
) -> DataFrame:
    """Pairs that may be similar, from (key, text) rows of which many may share a key."""
    half = 1 - (1 - recall) / 2
    first = runs_for(half)
    texts = texts.mapInArrow(_first_of_each, "key string, text string")

    def paths(rows: DataFrame, runs: int, depth: int, start: int) -> DataFrame:
        return cut(rows.repartition("key").mapInArrow(_first_paths(words, runs, threshold, depth, start), ROWS))

    tagged = _bucketed(paths(texts, first, 1, 1))
    edges = _compared(_listed(tagged.filter(F.col("n") <= limit), "path"), threshold)
    found, rest = large_edges(tagged.filter(F.col("n") > limit).drop("n"), threshold, tiled, chunk)
    edges = edges.unionByName(found)
    crowded = cut(rest.select("key").distinct())
    if crowded.isEmpty():
        return edges
    rows = paths(texts.join(crowded, "key", "left_semi"), runs_for(half, levels), levels, first + 1)
    return edges.unionByName(candidate_edges(rows, threshold, levels, limit, chunk, tiled))


def exact_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """(n, n): which pairs of sets have at least the threshold's Jaccard similarity."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens, place, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[place] > 1
    owner, place = owner[shared], place[shared]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    # A bounded number of shingles at a time, whatever the texts' lengths.
    number = np.cumsum(np.r_[0, place[1:] != place[:-1]]) if len(place) else place
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        i, j = np.searchsorted(number, [at, at + 4096])
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[i:j], number[i:j] - at] = 1
        common += has @ has.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _verify(words: int, threshold: float):
    """One tile pair of a component: links counted for each text, and a forest of them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, tiles, copies = group["key"].to_numpy(), group["tile"].to_numpy(), group["copies"].to_numpy()
        linked = exact_links([shingle_hashes(t, words) for t in group["text"]], threshold)
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        if low != high:  # pairs inside a tile belong to its own group
            linked &= tiles[:, None] != tiles[None, :]
        n = linked @ copies
        some = np.flatnonzero(n)
        pairs = _forest(linked)
        named = lambda ends: pd.Series([*keys[some], *(keys[i] for i in ends)], dtype=object)
        return pd.DataFrame({
            "a": named(i for i, _ in pairs), "b": named(j for _, j in pairs), "n": [*n[some].astype(int).tolist(), *[0] * len(pairs)],
        })

    return run


def similar_documents(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
    recall: float = RECALL, levels: int = LEVELS, limit: int = LIMIT, chunk: int = CHUNK, tile: int = TILE,
    tiled: int = TILED,
) -> DataFrame:
    """(doc_id, class_id, n_links, text_key) of each row: its class of linked texts and its number of links."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.md5("text")).withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    spoken = rows.filter(~F.col("blank"))
    # A text's node in the graphs: 64 bits of its digest, which Spark hashes and compares as numbers.
    node = lambda key: F.xxhash64(key)
    classes = cut(spoken.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).withColumn("node", node("key")))
    edges = candidates_of(spoken.select("key", "text"), words, threshold, recall, levels, limit, chunk, tiled)
    candidates = components(edges.select(node("a").alias("a"), node("b").alias("b")))
    sizes = candidates.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("m"))
    tiles = F.ceil(F.col("m") / tile).cast("int")
    placed = candidates.join(sizes, F.col("component") == F.col("c")).join(
        classes.withColumnRenamed("node", "id"), "id"
    ).select("key", "component", "first_id", "copies", F.pmod(F.col("id"), tiles).cast("int").alias("tile"), tiles.alias("tiles"))
    # One row with the text for each class; rows that repeat even the id are the same text.
    texts = spoken.join(placed, "key").filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    met = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "component", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "key", "tile", "copies", "text",
    )
    met = met.dropDuplicates(["component", "low", "high", "key"])
    verified = cut(met.groupBy("component", "low", "high").applyInPandas(_verify(words, threshold), "a string, b string, n long"))
    counts = verified.filter("n > 0").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("linked"))
    groups = components(verified.filter("n = 0").select(node("a").alias("a"), node("b").alias("b"))).withColumnRenamed("id", "node")
    whole = classes.join(counts, "key", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = whole.groupBy("component").agg(F.min("first_id").alias("class_id"))
    of_class = whole.join(names, "component").select(
        "key", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    done = rows.select("doc_id", "key", "blank").join(of_class, "key", "left")
    blank = F.col("blank")
    return done.select(
        "doc_id", F.when(blank, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(blank, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.col("key").alias("text_key"),
    )


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of `docs` that name their class, one for each class, columns unchanged.

    Texts without a word are in no class: one row of each such id stays. Different texts of one
    class that share its smallest id, or have none, all stay.
    """
    classes = similar_documents(docs, id_column=id_column, text_column=text_column, **options)
    own_id, own_key, text_key, place = (own_name(n) for n in ("id", "key", "text_key", "place"))
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    # Rows of one id and text may be repeated: the first stays.
    keyed = docs.withColumn(text_key, F.md5(F.coalesce(F.col(text_column), F.lit(""))))
    found = keyed.join(kept, keyed[id_column].eqNullSafe(F.col(own_id)) & (F.col(text_key) == F.col(own_key)), "left_semi")
    named = W.partitionBy(id_column, text_key).orderBy(*[F.col(c) for c in docs.columns])
    return found.withColumn(place, F.row_number().over(named)).filter(F.col(place) == 1).select(*docs.columns)
