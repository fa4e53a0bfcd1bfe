"""Embedding near-dedup: hierarchical navigable small-world graphs per shard, links by exact cosine, classes.

Vectors that may link (one label, finite, not zero) are made distinct first: copies of a
vector are one node with a weight. The nodes of a label are dealt to shards of bounded
expected size, each shard builds a graph, and every two shards of a label meet once, the
nodes of one as queries to the graph of the other. What leaves a task is a row for each
linked node - its links and a root - so a dense group's pairs are counted where they are found.
Graphs are built and searched for many vectors in lockstep, so each step is a few matrix
operations. Lists of edges are bounded, so in a dense group a node can drop out of all lists of
others. What no way from the entry leads to gets an edge from the closest node that is reached.
Where a beam holds vectors above the threshold, or as far again below it, the search goes on from
them along the graph's edges, in both directions, through all such vectors, each once and in no
order, so that a dense group of any size is found whole in a time that grows with its size. All queries are
searched in the graph first, whatever the shard's size; the links are those that it finds,
each verified in double precision. Then an audit measures: one query in AUDIT_SHARE, drawn at
random, is compared with every vector until AUDITED_LINKS true links, matches with themselves
aside, were seen. If the graph missed any of them, the beams of the whole shard widen and all
is searched again. A beam as wide as the graph sees all of it, and is the next one as soon as a
beam's edges would be half as many as the vectors. An audit's own links are never part of the result.

Links are counted from both sides by weights, components follow from the links.

The audits' links, and how many of them the graphs had found at the first width of the beams
and at the last, come with the links (audited_recall sums them up).

Defined results: vectors that are null, zero, hold null or non-finite components, differ in
length from those of their shard, or have no label link with nothing and are alone; repeated
rows count as vectors of their own; a null id is never the smallest; an empty table gives an
empty table; only the id of the input's columns is kept, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import NULL_ID, ordered_id, written
from lodestone.llm.components import components, smallest_reachable

#: Expected vectors of a shard, and vectors that one search step takes together. A search takes little longer in a larger graph, so larger shards make fewer searches.
SHARD, LOCKSTEP = 16384, 512
#: Shards whose queries one task takes; with its own shard, no more vectors than that are held by a task.
BLOCK = 3
#: Queries that are searched and audited together, and edges of a graph that a spreading search follows together.
QUERIES, SPREAD = 4096, 1 << 20
#: Edges that a node can hold besides its own choice, to nodes that nothing else leads to; edges that a step of a beam follows, as beams widen by.
SPARE, EDGES = 2, 32
#: Queries audited at a time, one in how many at most, true links after which an audit has seen enough, and the first width of the beams.
AUDITED, AUDIT_SHARE, AUDITED_LINKS, BEAM = 32, 8, 200, 48

AUDIT = ("audited", "first_hit", "hit")


@dataclass(frozen=True)
class Found:
    """Pairs of a query and a node that the graph found; the audit's true links, those of them that it found with the first beams and with the last, and the beams' last width."""

    query: np.ndarray
    node: np.ndarray
    audited: int
    first_hit: int
    hit: int
    width: int

    @property
    def recall(self) -> float:
        return self.hit / self.audited if self.audited else 1.0

    @property
    def first_recall(self) -> float:
        return self.first_hit / self.audited if self.audited else 1.0


def _take(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.take_along_axis(values, order, axis=1)


class SmallWorld:
    """A navigable small-world graph in layers over unit vectors (float32 for the way, float64 for results)."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = BEAM, seed: int = 1) -> None:
        self.exact = vectors
        self.near = vectors.astype(np.float32)
        n = len(vectors)
        levels = np.minimum(np.floor(-np.log1p(-np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int), 8)
        self.order = np.argsort(-levels, kind="stable")  # the highest first, so that entry points exist
        self.top = int(levels.max(initial=0))
        self.layers = [np.full((n, degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(self.order[0]) if n else -1
        self.beam = beam
        for layer in range(self.top, -1, -1):
            self._build(layer, self.order[: int((levels >= layer).sum())])
        if n:
            self._hold()
        node, column = np.nonzero(self.layers[0] >= 0)
        target = self.layers[0][node, column]
        self.holders = node[np.argsort(target, kind="stable")].astype(np.int32)  # of each node, from its first to that of the next
        self.first = np.concatenate([[0], np.cumsum(np.bincount(target, minlength=n))])

    def _build(self, layer: int, nodes: np.ndarray) -> None:
        done = min(len(nodes), 2 * self.layers[layer].shape[1])
        first = nodes[:done]
        self._link(layer, first, np.broadcast_to(first, (done, done)).copy())
        while done < len(nodes):
            batch = nodes[done : done + min(LOCKSTEP, max(16, done // 2))]
            found, _ = self._search(self.near[batch], layer, self.beam, self._descend(self.near[batch], layer))
            peers = np.broadcast_to(batch, (len(batch), len(batch)))
            self._link(layer, batch, np.concatenate([found, peers], axis=1))
            done += len(batch)

    def _hold(self) -> None:
        """Each node that no way from the entry leads to gets an edge, from the closest node that is reached and has room for one."""
        n = len(self.near)
        self.layers[0] = links = np.concatenate([self.layers[0], np.full((n, SPARE), -1, np.int32)], axis=1)
        reached, room = np.zeros(n, bool), np.full(n, SPARE)

        def walk(at: int) -> None:
            reached[at], open_ = True, np.array([at])
            while len(open_):
                new = np.unique(links[open_])
                open_ = new[(new >= 0) & ~reached[new]]
                reached[open_] = True

        walk(self.entry)
        for lost in np.flatnonzero(~reached):
            if not reached[lost]:
                by = int(np.argmax(np.where(reached & (room > 0), self.near @ self.near[lost], -np.inf)))
                links[by, -room[by]] = lost
                room[by] -= 1
                walk(lost)

    def _descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        at = np.full(len(queries), self.entry, np.int32)
        for k in range(self.top, layer, -1):
            at = self._search(queries, k, 1, at)[0][:, 0]
        return at

    def _similar(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        got = np.einsum("qd,qkd->qk", queries, self.near[nodes])
        got[nodes < 0] = -np.inf
        return got

    def _select(self, nodes: np.ndarray, candidates: np.ndarray, similar: np.ndarray, degree: int) -> np.ndarray:
        """For each node up to degree of its candidates: those closer to it than to any chosen before, then the closest others."""
        order = np.argsort(-similar, axis=1, kind="stable")[:, : 4 * degree]
        candidates, similar = _take(candidates, order), _take(similar, order)
        vectors = self.near[candidates]
        between = np.einsum("qad,qbd->qab", vectors, vectors)
        chosen = np.zeros(candidates.shape, bool)
        number = np.zeros(len(nodes), int)
        for j in range(candidates.shape[1]):
            blocked = (chosen & (between[:, j] > similar[:, j, None])).any(axis=1)
            take = ~blocked & np.isfinite(similar[:, j]) & (number < degree)
            chosen[:, j] = take
            number += take
        rank = np.argsort(np.where(chosen, 0, np.where(np.isfinite(similar), 1, 2)), axis=1, kind="stable")[:, :degree]
        picked = _take(candidates, rank)
        picked[~np.isfinite(_take(similar, rank))] = -1
        if picked.shape[1] < degree:
            picked = np.pad(picked, ((0, 0), (0, degree - picked.shape[1])), constant_values=-1)
        return picked

    def _rank(self, nodes: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        candidates = np.sort(candidates, axis=1)
        again = np.concatenate([np.zeros((len(nodes), 1), bool), candidates[:, 1:] == candidates[:, :-1]], axis=1)
        candidates = np.where(again | (candidates == nodes[:, None]), -1, candidates)
        return candidates, self._similar(self.near[nodes], candidates)

    def _link(self, layer: int, nodes: np.ndarray, candidates: np.ndarray) -> None:
        links = self.layers[layer]
        degree = links.shape[1]
        for at in range(0, len(nodes), 128):
            some = nodes[at : at + 128]
            links[some] = self._select(some, *self._rank(some, candidates[at : at + 128]), degree)
        back = links[nodes]
        source = np.repeat(nodes, degree)[back.ravel() >= 0]
        target = back.ravel()[back.ravel() >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(heads), 128):
            some, n = heads[at : at + 128], count[at : at + 128]
            incoming = np.full((len(some), int(n.max())), -1, np.int32)
            column = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            incoming[np.repeat(np.arange(len(some)), n), column] = source[first[at] : first[at] + int(n.sum())]
            links[some] = self._select(some, *self._rank(some, np.concatenate([links[some], incoming], axis=1)), degree)

    def _search(self, queries: np.ndarray, layer: int, width: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The width closest nodes that a beam search from at finds for each query, and their similarities."""
        q, links = len(queries), self.layers[layer]
        nodes = np.full((q, width), -1, np.int32)
        nodes[:, 0] = at
        similar = np.full((q, width), -np.inf, np.float32)
        similar[:, 0] = self._similar(queries, at[:, None])[:, 0]
        expanded = np.zeros((q, width), bool)
        seen = np.zeros((q, len(self.near)), bool)
        seen[np.arange(q), at] = True
        active = np.arange(q)
        while len(active):
            open_ = ~expanded[active] & (nodes[active] >= 0)
            active, open_ = active[open_.any(axis=1)], open_[open_.any(axis=1)]
            if not len(active):
                break
            best = open_.argmax(axis=1)  # beams are in order
            expanded[active, best] = True
            new = links[nodes[active, best]]
            old = seen[active[:, None], new] | (new < 0)
            seen[active[:, None], np.where(new < 0, nodes[active, best][:, None], new)] = True
            got = self._similar(queries[active], np.where(old, -1, new))
            both = np.concatenate([similar[active], got], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :width]
            similar[active] = _take(both, order)
            nodes[active] = _take(np.concatenate([nodes[active], new], axis=1), order)
            nodes[active] = np.where(np.isfinite(similar[active]), nodes[active], -1)
            expanded[active] = _take(np.concatenate([expanded[active], np.zeros(new.shape, bool)], axis=1), order)
        return nodes, similar

    def _audit(self, queries: np.ndarray, least: float, own: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries drawn AUDITED at a time until their true links, each query's own node aside, are as many as asked, or one in AUDIT_SHARE was drawn; and those links."""
        most = max(AUDITED, len(queries) // AUDIT_SHARE)
        order = np.random.Generator(np.random.PCG64(len(queries))).permutation(len(queries))[:most]
        parts, seen, at = [], 0, 0
        while at < len(order) and seen < links:
            some = order[at : at + AUDITED]
            truth = queries[some] @ self.exact.T >= least - 1e-12
            mine = np.flatnonzero(own[some] >= 0)
            truth[mine, own[some[mine]]] = False
            seen += int(truth.sum())
            parts.append(truth)
            at += AUDITED
        return order[:at], np.concatenate(parts) if parts else np.zeros((0, len(self.exact)), bool)

    def _exact(self, queries: np.ndarray, q: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs whose cosine is that large in double precision."""
        cosine = np.concatenate([np.einsum("pd,pd->p", queries[q[at : at + 65536]], self.exact[v[at : at + 65536]]) for at in range(0, len(q), 65536)] or [np.empty(0)])
        return q[cosine >= least], v[cosine >= least]

    def _spread(self, near: np.ndarray, q: np.ndarray, v: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a node of at least least, on all ways from the pairs q, v, along edges or against them, over nodes not farther below it than 1 is above."""
        n, links = len(self.exact), self.layers[0]
        held = np.diff(self.first)
        seen = np.zeros((len(near), n), bool)
        seen[q, v] = True
        found, open_ = [], [(q, v)]
        while open_:
            q, v = open_.pop()
            some = max(1, int(np.searchsorted(np.cumsum(links.shape[1] + held[v]), SPREAD)))
            if len(q) > some:
                open_.append((q[some:], v[some:]))
                q, v = q[:some], v[:some]
            count = held[v]
            against = self.holders[np.repeat(self.first[v] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            new, q = np.concatenate([links[v].ravel(), against]), np.concatenate([np.repeat(q, links.shape[1]), np.repeat(q, count)])
            q, new = q[new >= 0], new[new >= 0]
            fresh = ~seen[q, new]
            fresh = np.unique(q[fresh] * n + new[fresh])
            q, v = fresh // n, fresh % n
            seen[q, v] = True
            similar = np.concatenate([np.einsum("pd,pd->p", near[q[at : at + 32768]], self.near[v[at : at + 32768]]) for at in range(0, len(q), 32768)] or [np.empty(0)])
            close, on = similar >= least, similar >= 2 * least - 1
            found.append((q[close], v[close]))
            if on.any():
                open_.append((q[on], v[on]))
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    def _beams(self, near: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that beams of that width find, and the search that spreads from what they hold."""
        n, found = len(self.exact), []
        most = max(1, min(LOCKSTEP, (32 << 20) // max(1, n), (8 << 20) // (width + 32)))
        for at in range(0, len(near), most):
            some = near[at : at + most]
            if width >= n:  # every node
                i, v = np.nonzero(some @ self.near.T >= least)
            else:
                nodes, similar = self._search(some, 0, width, self._descend(some, 0))
                i, j = np.nonzero(similar >= 2 * least - 1)
                v, close = nodes[i, j].astype(np.int64), similar[i, j] >= least
                if len(i):
                    q, w = self._spread(some, i, v, least)
                    found.append((at + q, w))
                i, v = i[close], v[close]
            found.append((at + i, v))
        return tuple(np.concatenate([f[k] for f in found] or [np.empty(0)]).astype(np.int64) for k in (0, 1))

    def within(self, queries: np.ndarray, least: float, own: np.ndarray | None = None, links: int = AUDITED_LINKS) -> Found:
        """The pairs with cosine of at least least that the graph finds.

        own: each query's own node, which is no link, or -1. The beams of all queries widen
        until no link of the audit is missing; a beam as wide as the graph sees all of it, and
        takes less time than one whose edges are half as many.
        """
        n, width = len(self.exact), min(self.beam, len(self.exact))
        own = np.full(len(queries), -1) if own is None else own
        near = queries.astype(np.float32)
        known, first_hit = None, 0
        while True:
            q, v = self._exact(queries, *self._beams(near, width, least - 1e-4), least)
            pairs = np.unique(q * n + v)
            if known is None:
                sample, truth = self._audit(queries, least, own, links)
                i, v = np.nonzero(truth)
                sure, sure_v = self._exact(queries, sample[i], v, least)
                known = np.unique(sure * n + sure_v)
                first_hit = int(np.isin(known, pairs, assume_unique=True).sum())
            hit = int(np.isin(known, pairs, assume_unique=True).sum())
            if hit == len(known) or width >= n:
                return Found(pairs // n, pairs % n, len(known), first_hit, hit, width)
            width = width * 2 if width * 2 * EDGES * 2 < n else n


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _search_block(table: pa.Table, similarity: float) -> pa.Table:
    """The links between the vectors of one shard and a block of queries: for each node its links by weight, and a root that keeps it connected; beside the first one the audits' counts."""
    node, weight, build = (table[c].to_numpy() for c in ("node", "weight", "build"))
    vectors = _matrix(table["vector"].combine_chunks())
    base, asking = np.flatnonzero(build), np.flatnonzero(~build)
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "root", *AUDIT)})
    if not len(base) or not len(asking):
        return empty
    base, asking = base[np.argsort(node[base])], asking[np.argsort(node[asking])]
    names, index = np.unique(np.concatenate([node[base], node[asking]]), return_inverse=True)
    weights = np.zeros(len(names), np.int64)
    weights[index] = np.concatenate([weight[base], weight[asking]])
    mine, theirs = index[: len(base)], index[len(base) :]
    graph = SmallWorld(vectors[base])
    links, left, right, audits = np.zeros(len(names), np.int64), [], [], []
    for at in range(0, len(asking), QUERIES):
        some = theirs[at : at + QUERIES]
        place = np.minimum(np.searchsorted(mine, some), len(mine) - 1)
        found = graph.within(vectors[asking[at : at + QUERIES]], similarity, np.where(mine[place] == some, place, -1))
        left.append(theirs[at + found.query])
        right.append(mine[found.node])
        audits.append((found.audited, found.first_hit, found.hit))
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b))  # within the shard a link may be found from both ends
    a, b = both // len(names), both % len(names)
    a, b = a[a != b], b[a != b]
    np.add.at(links, a, weights[b])
    np.add.at(links, b, weights[a])
    some = np.flatnonzero(links)
    some = some if len(some) else np.array([0])  # what the audit saw is told even where the graph found nothing
    counts = np.zeros((len(AUDIT), len(some)), np.int64)
    counts[:, :1] = np.sum(audits, axis=0)[:, None]
    return pa.table({"node": names[some], "links": links[some], "root": names[smallest_reachable(a, b, len(names))[some]]} | dict(zip(AUDIT, counts, strict=True)))


def linked(nodes: DataFrame, similarity: float, shard: int = SHARD) -> DataFrame:
    """nodes: node, label, vector (array<double>, unit), weight. node, links, root and the columns of AUDIT: parts of each node's links, edges that connect what is linked, and the audits' counts.

    Every two shards of a label meet in one task, which counts their links for both ends;
    a task takes a shard and the queries of BLOCK shards, so that no label is too large for one.
    """
    size = F.size("vector")
    counts = nodes.groupBy("label", size.alias("d")).agg(F.count("*").alias("n"))
    shards = counts.select(F.col("label").alias("l"), "d", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    dealt = nodes.join(shards, (F.col("label") == F.col("l")) & (size == F.col("d"))).select("node", "label", "d", "vector", "weight", "shards", F.pmod(F.xxhash64("node", F.lit("shard")), "shards").cast("int").alias("own"))
    block = F.floor(F.col("own") / BLOCK).cast("int")
    queries = dealt.select("node", "label", "d", "vector", "weight", F.explode(F.sequence("own", F.col("shards") - 1)).alias("shard"), block.alias("block"), F.lit(False).alias("build"))
    builders = dealt.select("node", "label", "d", "vector", "weight", F.col("own").alias("shard"), F.explode(F.sequence(F.lit(0), block)).alias("block"), F.lit(True).alias("build"))
    return queries.unionByName(builders).groupBy("label", "d", "shard", "block").applyInArrow(lambda t: _search_block(t, similarity), "node long, links long, root long, audited long, first_hit long, hit long")


def audited_recall(links: DataFrame) -> DataFrame:
    """links: of linked. One row: audited, first_hit and hit (the true links that audits saw, and those that graphs found with their first and last beams), first_recall and recall, 1 if there was none."""
    sums = links.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in AUDIT])
    share = lambda c: F.when(F.col("audited") > 0, F.col(c) / F.col("audited")).otherwise(1.0)
    return sums.withColumns({"first_recall": share("first_hit"), "recall": share("hit")})


def vector_nodes(unit: DataFrame) -> DataFrame:
    """unit: node, doc, label, vector. Distinct vectors: node, first (the smallest id), weight, label, vector."""
    return unit.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("first"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector"))


def unit_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, doc, label, vector (array<double>, of length 1) and node, its 64-bit name; label and node are null for what links with nothing."""
    rows = vectors.select(F.col(id_col).alias("id"), ordered_id(id_col).alias("doc"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, labels, column = batch.columns
            values, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            nulls = np.asarray(pc.is_null(values))
            flat = np.where(nulls, np.nan, values.to_numpy(zero_copy_only=False)).astype(np.float64)
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            largest = np.zeros(len(sizes))
            np.maximum.at(largest, owner, np.where(np.isfinite(flat), np.abs(flat), np.inf))
            good = (largest > 0) & np.isfinite(largest) & np.asarray(pc.is_valid(labels))
            flat, owner = flat[good[owner]], owner[good[owner]]
            flat = flat / largest[owner]  # so that squares neither vanish nor overflow
            norm = np.sqrt(np.bincount(owner, flat * flat, minlength=len(sizes)))
            flat = flat / norm[owner] + 0.0  # -0.0 + 0.0 is 0.0: equal vectors must have equal bytes
            offsets = np.concatenate([[0], np.cumsum(np.where(good, sizes, 0))]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([ids, docs, pc.if_else(pa.array(good), labels, pa.scalar(None, pa.string())), out], names=["id", "doc", "label", "vector"])

    schema = T.StructType([rows.schema["id"], T.StructField("doc", T.LongType()), T.StructField("label", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema).withColumn("node", F.when(F.col("label").isNotNull(), F.xxhash64("label", "vector")))


def near_vectors(vectors: DataFrame, *, similarity: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """A row for each vector: the id, n_links, component_id and kept."""
    unit = unit_vectors(vectors, id_col, vector_col, label_col)
    nodes = written(vector_nodes(unit), "nodes")
    links = written(linked(nodes.select("node", "label", "vector", "weight"), similarity), "links")
    counted = links.groupBy("node").agg(F.sum("links").alias("others")).withColumnRenamed("node", "a")
    classes = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = nodes.select("node", "first", "weight").join(classes, "node", "left").select("node", "first", "weight", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = placed.join(least, "component").join(counted, F.col("node") == F.col("a"), "left").select(F.bitwise_not("node").alias("nn"), "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = unit.join(of_node, F.col("node") == F.bitwise_not("nn"), "left")
    component = F.nullif(F.coalesce("component_id", "doc"), F.lit(NULL_ID))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(False)).alias("kept"))
