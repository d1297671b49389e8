"""Near duplicates among vectors: hierarchical navigable small-world graphs per shard.

Distinct directions are dealt into shards by hash, and every shard builds its own layered graph.
Every vector then queries every shard: blocks of queries meet one shard's graph at a time. A
beam search walks down the layers. Before that, an audit takes a stated set of queries, compares the
beam search with brute force over the same shard, query by query and apart for queries with few and
with many links, and widens all beams until the shard's recall passes. A query whose beam is full of
links, and every query of a shard that no beam makes pass, is compared with the whole shard, in blocks.

Candidates are verified by cosine in double precision. A link found from one end counts for both: the
few links of a beam come out as rows for each end, while a query compared with a whole shard knows all
its links there and returns their number and one spanning forest, so a group of thousands of close
vectors never turns into rows of pairs. Components are the union of links and forests.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are their own component; vectors of different lengths do not link; repeated rows
of an id count once and come out once, rows without an id are not asked about; equal vectors are one node of the graphs, and all of them
link with each other. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioscore.llm.common import cut
from folioscore.llm.components import components

DEGREE = 16
BUILD_BEAM = 48
FIRST_BEAM = 32
EXPAND = 4
SHARD_ROWS = 32_768
MIN_SHARDS = 4
BLOCK_ROWS = 16_384
RECALL = 0.995
AUDIT_QUERIES = 128
FEW_LINKS = 8
MARGIN = 1e-4  # single against double precision


def _merged_top(ids, sims, new_ids, new_sims, flags, beam: int):
    """The best `beam` of two candidate lists by row; `flags` marks what was expanded."""
    ids = np.concatenate([ids, new_ids], 1)
    sims = np.concatenate([sims, new_sims], 1)
    flags = np.concatenate([flags, np.zeros(new_ids.shape, bool)], 1)
    if ids.shape[1] > beam:
        top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims, flags = (np.take_along_axis(x, top, 1) for x in (ids, sims, flags))
    return ids, sims, flags


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int):
    """(ids, similarities) of each query's beam over one layer; -1 pads. `entry`: (queries, any) ids."""
    count, n = len(queries), len(vectors)
    seen = np.zeros((count, n + 1), bool)  # the last column takes the padding
    seen[:, n] = True
    rows = np.arange(count)
    ids = np.where(entry < 0, n, entry)
    sims = np.einsum("qed,qd->qe", vectors[np.minimum(ids, n - 1)], queries)
    sims[seen[rows[:, None], ids]] = -np.inf
    seen[rows[:, None], ids] = True
    flags = ids == n
    active = rows
    while len(active):
        open_sims = np.where(flags[active], -np.inf, sims[active])
        width = min(EXPAND, open_sims.shape[1])
        pick = np.argpartition(-open_sims, width - 1, axis=1)[:, :width]
        best = np.take_along_axis(open_sims, pick, 1)
        some = np.isfinite(best).any(1)
        active, pick, best = active[some], pick[some], best[some]
        if not len(active):
            break
        flags[active[:, None], pick] = True
        near = links[np.where(np.isfinite(best), ids[active[:, None], pick], n)].reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        # A node reached by two expanded ones counts once.
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        near = np.where(fresh, near, n)
        # Few of the neighbours are new: only those are compared.
        q, place = np.nonzero(near < n)
        found = np.full(near.shape, -np.inf, np.float32)
        found[q, place] = np.einsum("nd,nd->n", vectors[near[q, place]], queries[active[q]])
        grown = _merged_top(ids[active], sims[active], near, found, flags[active] | (ids[active] == n), beam)
        if grown[0].shape[1] > ids.shape[1]:
            pad = grown[0].shape[1] - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=n)
            sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
            flags = np.pad(flags, ((0, 0), (0, pad)), constant_values=True)
        elif grown[0].shape[1] < ids.shape[1]:
            grown = tuple(np.pad(g, ((0, 0), (0, ids.shape[1] - g.shape[1])), constant_values=v) for g, v in zip(grown, (n, -np.inf, True)))
        ids[active], sims[active], flags[active] = grown
        flags[active] |= ids[active] == n
    return np.where(np.isfinite(sims), ids, -1), sims


def diverse(vectors: np.ndarray, point: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours by the small-world rule: one nearer to a chosen one than to the point is put back."""
    order = np.argsort(-sims, axis=1)
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    count, width = ids.shape
    near = vectors[np.maximum(ids, 0)]
    between = near @ near.transpose(0, 2, 1)
    chosen = np.zeros((count, width), bool)
    taken = np.zeros(count, np.int64)
    for j in range(width):
        blocked = (chosen & (between[:, j] > sims[:, j:j + 1])).any(1)
        chosen[:, j] = (ids[:, j] >= 0) & ~blocked & (taken < degree)
        taken += chosen[:, j]
    # Free places go to the nearest of those put back.
    rank = np.where(ids < 0, 3, np.where(chosen, 0, 1))
    keep = np.argsort(rank, axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, keep, 1)
    if width < degree:
        out = np.pad(out, ((0, 0), (0, degree - width)), constant_values=-1)
    return out


class Graph:
    """Layers of one shard. Rows are in the order of their levels, so layer k is a prefix."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM):
        order = np.argsort(-levels, kind="stable")
        self.order = order
        self.vectors = np.ascontiguousarray(vectors[order])
        top = int(levels.max()) if len(levels) else 0
        self.sizes = [int((levels >= k).sum()) for k in range(top, -1, -1)]
        self.layers: list[np.ndarray] = []
        for depth, size in enumerate(self.sizes):
            self.layers.append(self._layer(size, degree * (2 if depth == top else 1), beam))

    @classmethod
    def of(cls, vectors: np.ndarray, layers: list[np.ndarray]) -> Graph:
        """A built graph from its arrays, vectors already in its order."""
        graph = cls.__new__(cls)
        graph.vectors, graph.layers = vectors, layers
        return graph

    def entries(self, queries: np.ndarray, layers: int | None = None, width: int = 4) -> np.ndarray:
        """Where to start below the given number of finished upper layers."""
        entry = np.zeros((len(queries), 1), np.int64)
        for links in self.layers[:layers]:
            found, sims = beam_search(self.vectors[:len(links) - 1], links, queries, entry, 8)
            top = np.argsort(-sims, axis=1)[:, :width]
            entry = np.take_along_axis(found, top, 1)
        return entry

    def _layer(self, size: int, degree: int, beam: int) -> np.ndarray:
        """Batches join the graph of those before them; batches grow with the graph."""
        links = np.full((size + 1, degree), -1, np.int32)
        above = len(self.layers[-1]) - 1 if self.layers else 0
        # The nodes of the upper layer are linked by brute force or as a first run of batches.
        done = min(size, 64)
        v = self.vectors
        if done > 1:
            sims = v[:done] @ v[:done].T
            np.fill_diagonal(sims, -np.inf)
            ids = np.broadcast_to(np.arange(done), sims.shape).copy()
            ids[~np.isfinite(sims)] = -1
            links[:done] = diverse(v, v[:done], ids, sims, degree)
        while done < size:
            batch = np.arange(done, min(size, done + min(done, 512)))
            visible = np.vstack([links[:done], links[size:]])
            entry = self.entries(v[batch]) if self.layers else np.zeros((len(batch), 1), np.int64)
            entry = np.where(entry < done, entry, 0)
            ids, sims = beam_search(v[:done], visible, v[batch], entry, beam)
            # Those of the same batch see each other as well.
            inside = v[batch] @ v[batch].T
            np.fill_diagonal(inside, -np.inf)
            some = min(len(batch), degree)
            near = np.argpartition(-inside, some - 1, axis=1)[:, :some]
            mine = np.take_along_axis(inside, near, 1)
            ids = np.concatenate([ids, np.where(np.isfinite(mine), batch[near], -1)], 1)
            sims = np.concatenate([sims, mine], 1)
            links[batch] = diverse(v, v[batch], ids, sims, degree)
            self._back_links(links, batch, degree)
            done = int(batch[-1]) + 1
        return links

    def _back_links(self, links: np.ndarray, batch: np.ndarray, degree: int) -> None:
        """New nodes enter their neighbours' lists, which are thinned by the same rule."""
        target = links[batch].ravel().astype(np.int64)
        source = np.repeat(batch, degree)[target >= 0]
        target = target[target >= 0]
        v = self.vectors
        # Of many new neighbours, a list looks at its nearest.
        sims = np.einsum("nd,nd->n", v[target], v[source])
        order = np.lexsort((-sims, target))
        target, source = target[order], source[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        ok = place < degree
        nodes, row = np.unique(target[ok], return_inverse=True)
        added = np.full((len(nodes), degree), -1, np.int64)
        added[row, place[ok]] = source[ok]
        for at in range(0, len(nodes), 512):
            some = nodes[at:at + 512]
            ids = np.sort(np.concatenate([links[some], added[at:at + 512]], 1), 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            found = np.einsum("qed,qd->qe", v[np.maximum(ids, 0)], v[some])
            found[ids < 0] = -np.inf
            links[some] = diverse(v, v[some], ids, found, degree)

    def searched(self, queries: np.ndarray, threshold: float, beam: int):
        """(query rows, node rows) of similarity at least the threshold that the beams found, and the query
        rows whose beams have no room for anything but links; without a beam, these are all."""
        if not beam:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.arange(len(queries))
        entry = self.entries(queries, len(self.layers) - 1) if len(self.layers) > 1 else np.zeros((len(queries), 1), np.int64)
        ids, sims = beam_search(self.vectors, self.layers[-1], queries, entry, beam)
        linked = (ids >= 0) & (sims >= threshold)
        full = linked.sum(1) >= beam // 2
        q, j = np.nonzero(linked & ~full[:, None])
        return q, ids[q, j], np.flatnonzero(full)

    def near(self, queries: np.ndarray, threshold: float, beam: int):
        """(query rows, node rows) of similarity at least the threshold, full beams compared with all nodes."""
        q, j, full = self.searched(queries, threshold, beam)
        rows, more = np.nonzero(queries[full] @ self.vectors.T >= threshold)
        return np.concatenate([q, full[rows]]), np.concatenate([j, more])

    def audited_beam(self, threshold: float, recall: float, beam: int = FIRST_BEAM, queries: int = AUDIT_QUERIES) -> int:
        """The beam at which the audit's queries, slightly turned vectors of the shard, pass; 0 if none does.

        Brute force finds each one's nearest vectors. A query's recall is the share that its search sees;
        the means over queries with few and with many of them must both pass.
        """
        n = len(self.vectors)
        if not n:
            return beam
        rng = np.random.default_rng(n)
        rows = rng.choice(n, min(n, queries), replace=False)
        turned = self.vectors[rows] + rng.normal(0, 1, (len(rows), self.vectors.shape[1])).astype(np.float32) * (
            np.sqrt(1 / max(threshold, 0.1) ** 2 - 1) / np.sqrt(self.vectors.shape[1])
        )
        turned /= np.linalg.norm(turned, axis=1, keepdims=True)
        wanted = turned @ self.vectors.T >= min(threshold, 0.9)
        often = wanted.sum(1)
        while beam < n:
            q, j, full = self.searched(turned, min(threshold, 0.9), beam)
            seen = np.zeros(wanted.shape, bool)
            seen[q, j] = True
            seen[full] = True
            share = (seen & wanted).sum(1) / np.maximum(often, 1)
            bands = [share[(often > low) & (often <= high)] for low, high in ((0, FEW_LINKS), (FEW_LINKS, n))]
            if all(not len(band) or band.mean() >= recall for band in bands):
                return beam
            beam *= 2
        return 0


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges enough to keep the components of the given ones."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _whole(exact: np.ndarray, own: np.ndarray, nodes: np.ndarray, ids: np.ndarray, copies: np.ndarray, threshold: float):
    """Queries against all nodes, in blocks: (links of each query, edges enough to keep the components)."""
    counts, edges = np.zeros(len(own), np.int64), []
    label = np.arange(len(ids))  # of each node: its component so far
    step = max(1, 4_000_000 // max(1, len(ids)))
    for at in range(0, len(own), step):
        linked = exact[at:at + step] @ nodes.T >= threshold
        linked &= own[at:at + step, None] != ids[None, :]
        counts[at:at + step] = linked @ copies
        for i in np.flatnonzero(linked.any(1)):
            parts, first = np.unique(label[linked[i]], return_index=True)
            some = np.flatnonzero(linked[i])[first]
            edges += [(own[at + i], b) for b in ids[some].tolist()]
            if len(parts) > 1:
                label[np.isin(label, parts)] = parts[0]
    return counts, edges


def _rows(table: pd.DataFrame) -> np.ndarray:
    raw = np.stack(table["vector"].to_numpy()) if len(table) else np.empty((0, 1))
    return raw.astype(np.float64)


def _build(table: pd.DataFrame) -> pd.DataFrame:
    """One shard and length: its graph, with ids, copies and exact directions."""
    table = table.sort_values("id")
    exact = _rows(table)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    # Levels fall off geometrically with the hash of the id.
    uniform = (table["level_hash"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
    levels = np.floor(-np.log(np.maximum(uniform, 1e-12)) / np.log(DEGREE)).astype(np.int64)
    graph = Graph(exact.astype(np.float32), levels)
    threshold, recall = table["threshold"].iloc[0], table["recall"].iloc[0]
    beam = graph.audited_beam(threshold - MARGIN, recall)
    ids, copies = (table[c].to_numpy()[graph.order] for c in ("id", "copies"))
    held = (graph.layers, ids, copies, exact[graph.order], beam)  # arrays only
    return pd.DataFrame({"shard": [table["shard"].iloc[0]], "width": [exact.shape[1]], "graph": [pickle.dumps(held, 5)]})


EDGE, WHOLE, LINK = range(3)
FOUND = "kind int, a long, shard int, b long, n long"


def _query(graph_rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """One shard's graph and one block of queries. An EDGE of a forest joins a and b; WHOLE gives the number n
    of all links from a to a shard; LINK is one link from a to b, which has n copies in that shard."""
    out = []

    def add(kind: int, a, shard, b, n) -> None:
        columns = np.broadcast_arrays(np.int64(kind), np.asarray(a, np.int64), shard, b, n)
        out.append(np.stack(columns).astype(np.int64))

    add(EDGE, np.empty(0), 0, 0, 0)
    if len(graph_rows) and len(block):
        layers, ids, copies, nodes, beam = pickle.loads(graph_rows["graph"].iloc[0])
        graph, shard = Graph.of(nodes.astype(np.float32), layers), int(graph_rows["shard"].iloc[0])
        threshold = block["threshold"].iloc[0]
        exact = _rows(block)
        exact /= np.linalg.norm(exact, axis=1, keepdims=True)
        own, home, owned = (block[c].to_numpy() for c in ("id", "home", "own_copies"))
        most = max(64, min(512, 64_000_000 // max(1, len(ids))))
        for at in range(0, len(own), most):
            part = slice(at, at + most)
            q, j, full = graph.searched(exact[part].astype(np.float32), threshold - MARGIN, beam)
            cosine = np.einsum("nd,nd->n", exact[part][q], nodes[j])
            good = (cosine >= threshold) & (ids[j] != own[part][q])
            q, j = q[good], j[good]
            a, b = own[part][q], ids[j]
            add(LINK, a, shard, b, copies[j])
            add(LINK, b, home[part][q], a, owned[part][q])
            counts, edges = _whole(exact[part][full], own[part][full], nodes, ids, copies, threshold)
            add(WHOLE, own[part][full], shard, 0, counts)
            for left, right in (np.array(e, np.int64).reshape(-1, 2).T for e in (_forest(a, b), edges)):
                add(EDGE, left, 0, right, 0)
    return pd.DataFrame(dict(zip(("kind", "a", "shard", "b", "n"), np.concatenate(out, 1))))


def near_vectors(
    vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95,
    recall: float = RECALL, shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, n_links, component_id) of every id in `vectors`."""
    values = F.col("vector")
    rows = vectors.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    sound = (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(sound, values)).groupBy("id").agg(F.min("vector").alias("vector"))
    # Equal vectors become one node: its smallest id stands for them, with their number.
    rows = rows.withColumn("same", F.xxhash64("vector"))
    nodes = cut(rows.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumns({
        "width": F.size("vector"), "level_hash": F.xxhash64("id", F.lit(1)), "threshold": F.lit(float(threshold)), "recall": F.lit(float(recall)),
    }))
    total = nodes.count()
    shards, blocks = max(min_shards, -(-total // shard_rows)), max(1, -(-total // block_rows))
    placed = nodes.withColumns({"shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), "block": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")})
    graphs = cut(placed.groupBy("shard", "width").applyInPandas(_build, "shard int, width int, graph binary"))
    # Every block of queries meets every shard's graph of its length.
    spread = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    index = graphs.select("shard", "width", "graph", spread("block", blocks))
    asked = placed.select("id", "vector", "width", "threshold", "block", F.col("shard").alias("home"), F.col("copies").alias("own_copies"), spread("shard", shards))
    keys = ["shard", "width", "block"]
    found = cut(index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(_query, FOUND))
    # A link may be found from both ends. What a comparison with the whole shard counted needs no links.
    links = found.filter(F.col("kind") != EDGE).groupBy("a", "shard", "kind", "b").agg(F.max("n").alias("n"))
    whole, single = (F.sum(F.when(F.col("kind") == kind, F.col("n"))) for kind in (WHOLE, LINK))
    in_shard = links.groupBy("a", "shard").agg(F.coalesce(whole, single).alias("n"))
    counts = in_shard.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("linked"))
    labels = components(found.filter(F.col("kind") == EDGE).select("a", "b"))
    of_node = nodes.join(counts, "id", "left").join(labels, "id", "left").select(
        "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    )
    joined = rows.select("id", "vector").join(of_node, "vector", "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
