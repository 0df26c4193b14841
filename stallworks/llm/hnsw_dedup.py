"""Embedding near-dedup with hierarchical navigable small-world graphs per shard.

Vectors of one label and length form a space; a space is cut into shards by row
hash, each small enough for one task, and one graph is built per shard.  Blocks of
queries (every distinct vector) meet every shard of their space.  A query whose
beam is full of links is repeated with a wider beam until the beam reaches
beyond the threshold; a sample of every block is compared with brute force over the
shard, and the whole block is repeated with a wider beam until the audit passes.
Found neighbours are verified by cosine in double precision.  Links are counted
and reduced to spanning stars inside the task; components are joined over a table.

Equal vectors of one label are one node that knows its number of copies.

Defined cases: a null label, a null or empty vector, null or non-finite components
and the zero vector link with nothing; vectors of different length do not link; a
vector without links is its own component; repeated rows and repeated ids are vectors
of their own, and all rows with the id of their component are kept; a cosine of exactly the limit links; vectors of any length are
compared whole; only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stallworks.llm.graph import components
from stallworks.llm.tables import Scratch, keyed
from stallworks.llm.words import join_labels, sorted_groups

COSINE = 0.98
#: vectors of a shard, queries of a block
SHARD, QUERIES = 20_000, 2048
#: links of a node on the upper levels (twice as many at the bottom), and first beam widths
LINKS, BUILD_BEAM, QUERY_BEAM = 12, 48, 64
#: share of true links that every audit must find, and one in how many queries it samples
AUDIT_RECALL, AUDIT_EVERY = 0.995, 20
STEP = 256
#: how far below the threshold a node may be and still be opened
SLACK = 0.04


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # keeps very small and very large components finite
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``width`` nodes (-1: none) and their cosines for all queries side by side, from entry nodes (queries, k)."""
    n_queries = len(queries)
    seen = np.zeros((n_queries, len(points)), dtype=bool)
    ids = np.full((n_queries, width), -1, dtype=np.int64)
    sims = np.full((n_queries, width), -np.inf)
    opened = np.ones((n_queries, width), dtype=bool)

    def add(rows: np.ndarray, nodes: np.ndarray) -> None:
        fresh = nodes >= 0
        fresh &= ~seen[rows[:, None], np.where(fresh, nodes, 0)]
        at, column = np.nonzero(fresh)
        node = nodes[at, column]
        seen[rows[at], node] = True
        score = np.full(nodes.shape, -np.inf)
        score[at, column] = np.einsum("ij,ij->i", points[node], queries[rows[at]])
        all_ids = np.concatenate([ids[rows], np.where(fresh, nodes, -1)], axis=1)
        all_sims = np.concatenate([sims[rows], score], axis=1)
        all_open = np.concatenate([opened[rows], ~fresh], axis=1)
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[rows] = np.take_along_axis(all_ids, top, axis=1)
        sims[rows] = np.take_along_axis(all_sims, top, axis=1)
        opened[rows] = np.take_along_axis(all_open, top, axis=1)

    rows = np.arange(n_queries)
    add(rows, entry)
    while True:
        waiting = np.where(opened, -np.inf, sims)
        rows = np.flatnonzero((waiting > -np.inf).any(axis=1))
        if not len(rows):
            return ids, sims
        best = np.argmax(waiting[rows], axis=1)
        opened[rows, best] = True
        add(rows, links[ids[rows, best]])


def chosen(points: np.ndarray, base: np.ndarray, candidates: np.ndarray, sims: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` links per base node: near ones no two of which are closer to each other, then the nearest of the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    candidates, sims = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(sims, order, axis=1)
    vectors = points[np.maximum(candidates, 0)]
    between = vectors @ vectors.transpose(0, 2, 1)
    valid = (candidates >= 0) & (candidates != base[:, None])
    taken = np.zeros(candidates.shape, dtype=bool)
    half = max(1, count // 2)
    for c in range(candidates.shape[1]):
        apart = ~((between[:, c, :] >= sims[:, c:c + 1]) & taken).any(axis=1)
        taken[:, c] = valid[:, c] & apart & (taken.sum(axis=1) < half)
    room = count - taken.sum(axis=1)
    rest = valid & ~taken
    taken |= rest & (np.cumsum(rest, axis=1) <= room[:, None])
    out = np.full((len(base), count), -1, dtype=np.int64)
    at, column = np.nonzero(taken)
    out[at, (np.cumsum(taken, axis=1) - 1)[at, column]] = candidates[at, column]
    return out


class Level:
    """Links between the nodes of one level; nodes come in batches."""

    def __init__(self, n: int, count: int):
        self.count = count
        self.links = np.full((n, count), -1, dtype=np.int64)
        self.inside = np.zeros(n, dtype=bool)

    def insert(self, points: np.ndarray, nodes: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        """Links new nodes to candidates found before and among themselves, and back."""
        own = points[nodes] @ points[nodes].T
        np.fill_diagonal(own, -np.inf)
        k = min(self.count, len(nodes))
        top = np.argpartition(-own, k - 1, axis=1)[:, :k]
        candidates = np.concatenate([near, np.where(np.take_along_axis(own, top, 1) > -np.inf, nodes[top], -1)], axis=1)
        scores = np.concatenate([sims, np.take_along_axis(own, top, 1)], axis=1)
        self.links[nodes] = chosen(points, nodes, candidates, np.where(candidates >= 0, scores, -np.inf), self.count)
        self.inside[nodes] = True
        source = np.repeat(nodes, self.count)
        target = self.links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        if not len(target):
            return
        score = np.einsum("ij,ij->i", points[source], points[target])
        order = np.lexsort((-score, target))
        source, target = source[order], target[order]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        place = np.arange(len(target)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(target)]])))
        back = np.full((len(heads), 2 * self.count), -1, dtype=np.int64)
        fits = place < back.shape[1]
        back[np.searchsorted(heads, np.arange(len(target)), side="right")[fits] - 1, place[fits]] = source[fits]
        base = target[heads]
        for at in range(0, len(base), STEP):
            part = base[at:at + STEP]
            merged = np.concatenate([self.links[part], back[at:at + STEP]], axis=1)
            twice = np.zeros(merged.shape, dtype=bool)
            ordered = np.sort(merged, axis=1)
            twice[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
            merged = np.where(twice, -1, ordered)
            closeness = np.einsum("ikj,ij->ik", points[np.maximum(merged, 0)], points[part])
            self.links[part] = chosen(points, part, merged, np.where(merged >= 0, closeness, -np.inf), self.count)


class Graph:
    """Hierarchical navigable small world over unit vectors."""

    def __init__(self, points: np.ndarray, levels: list[np.ndarray] | None = None, entry: int = 0):
        self.points, self.links, self.entry = points, levels or [], entry

    @staticmethod
    def build(points: np.ndarray, seed: int = 5) -> Graph:
        n = len(points)
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(rng.random(n) + 1e-12) / math.log(LINKS)).astype(int), 8)
        order = np.lexsort((rng.random(n), -height))  # highest nodes first: the first node is the entry of every level
        levels = [Level(n, LINKS if k else 2 * LINKS) for k in range(int(height.max()) + 1 if n else 1)]
        graph = Graph(points, [l.links for l in levels], int(order[0]))
        at = 0
        while at < n:
            batch = order[at:at + max(1, min(STEP, at))]
            entry = np.full((len(batch), 1), graph.entry)
            for k in range(len(levels) - 1, -1, -1):
                member = height[batch] >= k
                if at:
                    near, sims = beam(points, levels[k].links, points[batch], entry, BUILD_BEAM if member.any() else 1)
                    entry = near[np.arange(len(batch)), np.argmax(sims, axis=1)][:, None]
                else:
                    near, sims = np.full((len(batch), 1), -1), np.full((len(batch), 1), -np.inf)
                if member.any():
                    levels[k].insert(points, batch[member], near[member], sims[member])
            at += len(batch)
        graph.connect()
        return graph

    def _add(self, source: int, target: int) -> None:
        """One more link, in a free slot or a new one."""
        slots = np.flatnonzero(self.links[0][source] < 0)
        if not len(slots):
            self.links[0] = np.concatenate([self.links[0], np.full((len(self.points), 1), -1)], axis=1)
            slots = [self.links[0].shape[1] - 1]
        self.links[0][source, slots[0]] = target

    def connect(self) -> None:
        """Mends what pruning took: nodes that no near node leads to any more, and parts that the entry does not reach."""
        source, slot = np.nonzero(self.links[0] >= 0)
        target = self.links[0][source, slot]
        sims = np.concatenate([np.einsum("ij,ij->i", self.points[source[k:k + 65536]], self.points[target[k:k + 65536]])
                               for k in range(0, len(source), 65536)] or [np.zeros(0)])
        best_in, best_out, nearest = (np.full(len(self.points), -2.0), np.full(len(self.points), -2.0), np.full(len(self.points), -1))
        np.maximum.at(best_in, target, sims)
        order = np.argsort(sims, kind="stable")
        best_out[source[order]], nearest[source[order]] = sims[order], target[order]
        for node in np.flatnonzero((best_in < best_out - SLACK / 4) & (nearest >= 0)):
            self._add(int(nearest[node]), int(node))
        reached = np.zeros(len(self.points), dtype=bool)
        frontier = np.array([self.entry])
        while True:
            while len(frontier):
                reached[frontier] = True
                ahead = np.unique(self.links[0][frontier])
                frontier = ahead[(ahead >= 0) & ~reached[ahead]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                return
            near = int(np.argmax(np.where(reached, self.points @ self.points[lost[0]], -np.inf)))
            self._add(near, int(lost[0]))
            frontier = lost[:1]

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.entry)
        for links in self.links[:0:-1]:
            near, sims = beam(self.points, links, queries, entry, 4)
            entry = near[np.arange(len(queries)), np.argmax(sims, axis=1)][:, None]
        return beam(self.points, self.links[0], queries, entry, min(width, len(self.points)))

    def within(self, queries: np.ndarray, cosine: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """All found (query, node) with at least this cosine.

        Queries whose beam is full of links are widened together, sorted by
        their first link so that neighbours meet: one frontier for a block,
        opened as long as it leads to nodes near any of its queries.
        """
        a, b, full, first, beams = [], [], [], [], []
        for at in range(0, len(queries), STEP):
            rows = np.arange(at, min(at + STEP, len(queries)))
            ids, sims = self.search(queries[rows], width)
            crowded = (sims.min(axis=1) >= cosine) & (width < len(self.points))
            q, k = np.nonzero((sims >= cosine) & ~crowded[:, None])
            a.append(rows[q])
            b.append(ids[q, k])
            full.append(rows[crowded])
            beams.append(ids[crowded])
            first.append(ids[crowded].min(axis=1))
        full, beams = np.concatenate(full), np.concatenate(beams)
        order = np.argsort(np.concatenate(first), kind="stable")
        for at in range(0, len(order), 2 * STEP):
            part = order[at:at + 2 * STEP]
            rows, known = full[part], np.zeros(len(self.points), dtype=bool)
            frontier = np.unique(beams[part])
            while len(frontier):
                known[frontier] = True
                sims = queries[rows] @ self.points[frontier].T
                q, k = np.nonzero(sims >= cosine)
                a.append(rows[q])
                b.append(frontier[k])
                near = frontier[(sims >= cosine - SLACK).any(axis=0)]
                ahead = np.unique(self.links[0][near])
                frontier = ahead[(ahead >= 0) & ~known[ahead]]
        return np.concatenate(a), np.concatenate(b)

    def audited(self, queries: np.ndarray, own: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """``within`` with beams widened until the mean recall of a sample of queries agrees with brute force.

        Every sampled query that links with another point counts once, however many it links with; its
        link to itself (``own``: its place among the points, or -1) does not count.
        """
        width = QUERY_BEAM
        sample = np.arange(0, len(queries), max(1, min(AUDIT_EVERY, len(queries) // 32)))
        true = np.zeros(len(queries), dtype=np.int64)
        for k in range(0, len(sample), STEP):
            part = sample[k:k + STEP]
            hits = queries[part] @ self.points.T >= cosine
            held = np.flatnonzero(own[part] >= 0)
            hits[held, own[part][held]] = False
            true[part] = hits.sum(axis=1)
        linked = np.flatnonzero(true > 0)
        while True:
            a, b = self.within(queries, cosine, width)
            found = np.bincount(a[own[a] != b], minlength=len(queries))
            if not len(linked) or (found[linked] / true[linked]).mean() >= AUDIT_RECALL or width >= len(self.points):
                return a, b
            width *= 2


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (space, shard, row, copies, embedding) -> one row per shard with its graph."""
    for table in sorted_groups(batches, ["space", "shard"]):
        space, shard, row, copies = (table.column(c).to_numpy() for c in ("space", "shard", "row", "copies"))
        vectors = np.stack(table.column("embedding").to_numpy())
        cuts = np.flatnonzero(np.concatenate([[True], (space[1:] != space[:-1]) | (shard[1:] != shard[:-1])]))
        for s, e in zip(cuts, [*cuts[1:], len(row)]):
            graph = Graph.build(unit(vectors[s:e]))
            held = io.BytesIO()
            np.savez(held, row=row[s:e], copies=copies[s:e], vectors=vectors[s:e], entry=graph.entry,
                     **{f"level{k}": links.astype(np.int32) for k, links in enumerate(graph.links)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([space[s]]), pa.array([shard[s]]), pa.array([held.getvalue()], pa.binary())], names=["space", "shard", "graph"])


def _searcher(cosine: float):
    def search(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        """Links of a block of queries in one shard: row, label (smallest row linked here), n."""
        if queries.empty or index.empty:
            return pd.DataFrame({"row": [], "label": [], "n": []})
        held = np.load(io.BytesIO(index["graph"].iloc[0]))
        levels = [held[f"level{k}"].astype(np.int64) for k in range(sum(name.startswith("level") for name in held.files))]
        graph = Graph(unit(held["vectors"]), levels, int(held["entry"]))
        rows, nodes = queries["row"].to_numpy(), held["row"]
        order = np.argsort(nodes)
        place = np.minimum(np.searchsorted(nodes[order], rows), len(nodes) - 1)
        own = np.where(nodes[order][place] == rows, order[place], -1)
        a, b = graph.audited(unit(np.stack(queries["embedding"].to_numpy())), own, cosine)
        other = rows[a] != nodes[b]
        a, b = a[other], b[other]
        counts = np.bincount(a, weights=held["copies"][b], minlength=len(rows)).astype(np.int64)
        every, place = np.unique(np.concatenate([rows, nodes]), return_inverse=True)
        label = every[join_labels(len(every), place[:len(rows)][a], place[len(rows):][b])]
        n = np.zeros(len(every), dtype=np.int64)
        n[place[:len(rows)]] = counts
        told = (label != every) | (n > 0)
        return pd.DataFrame({"row": every[told], "label": label[told], "n": n[told]})

    return search


def embedding_components(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE,
    shard: int = SHARD, block: int = QUERIES,
) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per vector."""
    scratch = Scratch(vectors.sparkSession)
    source = keyed(scratch, vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("embedding")))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0)
    good = source.filter(F.coalesce(usable, F.lit(False))).select("row", "embedding", F.xxhash64("label", F.size("embedding")).alias("space"))
    nodes = scratch.write(good.groupBy("space", "embedding").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")))
    sizes = scratch.write(nodes.groupBy("space").agg(F.count(F.lit(1)).alias("size")))
    sized = nodes.withColumnRenamed("first", "row").join(sizes, "space").withColumn(
        "shards", F.ceil(F.col("size") / shard).cast("int")).withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sized.select("space", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"), "row", "copies", "embedding")
    placed = placed.repartition(spread, "space", "shard").sortWithinPartitions("space", "shard")
    graphs = scratch.write(placed.mapInArrow(_build, "space long, shard int, graph binary"))
    queries = sized.select("space", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
                           F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int").alias("part"), "row", "embedding")
    parts = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block).cast("int") - 1)))
    indexes = graphs.join(parts.select("space", "part"), "space")
    keys = ["space", "shard", "part"]
    # a number of partitions of its own: little data, but much work in each block
    queries, indexes = queries.repartition(spread, *keys), indexes.repartition(spread, *keys)
    links = scratch.write(queries.groupBy(*keys).cogroup(indexes.groupBy(*keys)).applyInPandas(
        _searcher(cosine), "row long, label long, n long"))
    labels = components(scratch, links.select(F.col("row").alias("a"), F.col("label").alias("b")))
    counts = links.groupBy("row").agg(F.sum("n").alias("n"))
    found = nodes.join(counts, nodes["first"] == counts["row"], "left").drop("row").join(
        labels.withColumnRenamed("node", "first"), "first", "left")
    found = scratch.write(found.select("space", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                       F.coalesce("label", "first").alias("top")))
    per_row = good.join(found, ["space", "embedding"]).select("row", "n_links", "top")
    done = source.select("id", "row").join(per_row, "row", "left").withColumn("top", F.coalesce("top", "row"))
    names = source.select(F.col("row").alias("top"), F.col("id").alias("component_id"))
    return done.join(names, "top").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
