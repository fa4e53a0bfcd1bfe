"""MinHash near-dedup by BagMinHash: weighted-Jaccard signatures, bands, exact verification, classes.

A text is the multiset of its runs of five words (words are runs of ASCII letters,
lower-cased, digits and bytes outside ASCII; a shorter text is one run of all its words).
Each run of words has Poisson processes over its weight, cut into the intervals [0, 1),
[1, 2), [2, 4), ... and generated in order of time from hashes alone: a point has a register
and a place in the interval, and counts if the text's weight reaches beyond that place. A
register keeps its earliest point, and a process stops once its time is later than the
latest register. Two texts agree in a register with probability of their weighted Jaccard
similarity, so 32 bands of 5 registers miss a pair at 0.8 with probability 3e-6.

Equal texts are one node from the start. In each bucket of a band all nodes are verified,
on their whole multisets, against the one that shares the most buckets overall; classes are
components of the verified links. Buckets that then still hold several classes are gone
through again, so that no link is lost: small ones pair by pair, large ones in blocks, every
two blocks in a task of bounded size that verifies all pairs across classes and returns no
pairs but edges that connect what they connect.

Defined results: a null text is alone; equal texts share a class, also without words;
other texts without words are alone; a null id gets class null unless it shares a text or
link with others; an empty table gives an empty table; a very long text is held whole by one
task; input columns named as results are replaced. A node is a text's 64-bit hash; where
texts of another second hash share it, both hashes name them, so no two texts are taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import released, slices, text_slices, texts_of
from lodestone.llm.common import NULL_ID, ordered_id, written
from lodestone.llm.components import components, smallest_reachable
from lodestone.llm.language_id import _folded
from lodestone.llm.suffix_dedup import RollingHash, mixed

#: Buckets up to this size have their pairs dealt one by one, larger ones in blocks of so many nodes.
FEW, BLOCK = 12, 512

_WORD = _folded()
_WORD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_C1, _C2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles_of(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct runs of size words, ordered by text and hash."""
    data = np.full(sum(map(len, texts)) + len(texts) + 1, 32, np.uint8)
    at, begins = 1, np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        begins[i] = at
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += len(t) + 1
    data = _WORD[data]
    edges = np.flatnonzero(np.diff((data != 32).view(np.int8))) + 1
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    word = RollingHash(data).of(first, last)
    owner = np.searchsorted(begins, first, "right") - 1
    number = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(number) - number
    size_of = np.minimum(number, size)
    rank = np.arange(len(word)) - begin[owner]
    start = np.flatnonzero(rank <= (number - size_of)[owner])
    h, left = np.zeros(len(start), np.uint64), size_of[owner[start]]
    for j in range(size):
        more = left > j
        h = np.where(more, mixed(h * _C1 + word[np.minimum(start + j, len(word) - 1)] + np.uint64(j)), h)
    text = owner[start]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (h[1:] != h[:-1])]))
    return text[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """texts x registers, uint64: names of the earliest points; 0 for a text without elements. Weights are whole numbers from 1.

    Names are hashes, so sums of times that round otherwise on other machines or in other batches do not change them.
    """
    levels = [np.zeros(len(text), np.int64)]
    rows = [np.arange(len(text))]
    level = 1
    while len(more := np.flatnonzero(weight > 1 << (level - 1))):
        rows.append(more)
        levels.append(np.full(len(more), level))
        level += 1
    row, lev = np.concatenate(rows), np.concatenate(levels)
    owner, w = text[row], weight[row]
    low = np.where(lev > 0, 1 << np.maximum(lev - 1, 0), 0)
    width = np.maximum(low, 1).astype(float)
    seed = mixed(element[row] * _C1 + lev.astype(np.uint64) * _C2 + np.uint64(1))
    time, drawn = np.zeros(len(row)), 0
    least, names = np.full((texts, registers), np.inf), np.zeros((texts, registers), np.uint64)
    while len(owner):
        points = max(1, min(64, 30_000 // len(owner)))
        step = np.arange(drawn, drawn + points, dtype=np.uint64)
        h = mixed(seed[:, None] + (step[None, :] + np.uint64(1)) * _C1)
        times = time[:, None] + np.cumsum(-np.log1p(-((h >> np.uint64(11)) * 2.0**-53)), axis=1) / width[:, None]
        h = mixed(h + _C2)
        register = ((h >> np.uint64(40)) * np.uint64(registers) >> np.uint64(24)).astype(np.int64)
        place = low[:, None] + (h & np.uint64(0xFFFFFFFF)) * (2.0**-32) * width[:, None]
        counts = np.floor(place) < w[:, None]
        cell, when = (owner[:, None] * registers + register)[counts], times[counts]
        np.minimum.at(least.reshape(-1), cell, when)
        first = when == least.reshape(-1)[cell]
        names.reshape(-1)[cell[first]] = h[counts][first]
        time, drawn = times[:, -1], drawn + points
        live = time < least.max(axis=1)[owner]
        if not live.all():
            owner, w, low, width, seed, time = (x[live] for x in (owner, w, low, width, seed, time))
    return names


def band_hashes(names: np.ndarray, bands: int) -> np.ndarray:
    """texts x bands, int64."""
    bits = names.reshape(len(names), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C2, bits.shape[:2])
    for k in range(bits.shape[2]):
        h = mixed(h * _C1 + bits[:, :, k])
    return h.view(np.int64)


def banded(nodes: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """nodes: node, text. node, bands array<long> of those with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(batch.schema.get_field_index("node"))
            for part, texts in text_slices(batch, "text"):
                found = shingles_of(texts, size)
                names = signatures(*found, len(part), bands * rows)
                some = np.unique(found[0])
                hashes = pa.FixedSizeListArray.from_arrays(pa.array(band_hashes(names[some], bands).ravel()), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({"node": node.take(pa.array(some + part.start)), "bands": hashes})

    return nodes.select("node", "text").mapInArrow(lambda batches: released(run(batches)), "node long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """pairs: a, b. Those whose multisets have at least that weighted Jaccard similarity. A text that many pairs share is joined last, by splittable parts."""
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i).to_numpy() for i in (0, 1))
            texts_a, texts_b = texts_of(batch, "text_a"), texts_of(batch, "text_b")
            for part in slices(texts_b, 1 << 20):
                index: dict[int, int] = {}
                own: list[bytes] = []
                for i in part:
                    for node, text in ((a[i], texts_a[i]), (b[i], texts_b[i])):
                        if node not in index:
                            index[node] = len(own)
                            own.append(text)
                text, h, n = shingles_of(own, size)
                edges = np.searchsorted(text, np.arange(len(own) + 1))
                total = np.add.reduceat(np.concatenate([n, [0]]), np.minimum(edges[:-1], len(n))) * (np.diff(edges) > 0)
                kept = []
                for i in part:
                    x, y = index[a[i]], index[b[i]]
                    sx, sy = slice(edges[x], edges[x + 1]), slice(edges[y], edges[y + 1])
                    _, ix, iy = np.intersect1d(h[sx], h[sy], assume_unique=True, return_indices=True)
                    shared = int(np.minimum(n[sx][ix], n[sy][iy]).sum())
                    if shared and shared >= similarity * (total[x] + total[y] - shared) - 1e-9:
                        kept.append(i)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[kept], pa.int64()), "b": pa.array(b[kept], pa.int64())})

    return joined.mapInArrow(lambda batches: released(run(batches)), "a long, b long")


def _units(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, unit) by text: a run of words that stands n times is n units, so multisets overlap as sets of units do."""
    text, h, n = shingles_of(texts, size)
    text, h = np.repeat(text, n), np.repeat(h, n)
    rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    return text, np.unique(mixed(h + rank.astype(np.uint64) * _C2), return_inverse=True)[1]


def _block_links(table: pa.Table, size: int, similarity: float) -> pa.Table:
    """Of two blocks of one bucket, edges that connect what the links across classes connect."""
    names, index = np.unique(table["node"].to_numpy(), return_index=True)
    component, left = table["component"].to_numpy()[index], table["i"].to_numpy()[index] == table["own"].to_numpy()[index]
    right = table["j"].to_numpy()[index] == table["own"].to_numpy()[index]
    texts = [t for t in table["text"].take(pa.array(index)).cast(pa.binary()).to_pylist()]
    text, unit = _units(texts, size)
    begin = np.searchsorted(text, np.arange(len(names) + 1))
    total = np.diff(begin)
    by_unit = np.argsort(unit, kind="stable")
    holder, first = text[by_unit], np.searchsorted(unit[by_unit], np.arange(unit.max(initial=-1) + 2))
    a, b = [], []
    for x in np.flatnonzero(left):
        mine = unit[begin[x] : begin[x + 1]]
        n = first[mine + 1] - first[mine]
        at = np.arange(n.sum()) + np.repeat(first[mine] - (np.cumsum(n) - n), n)
        shared = np.bincount(holder[at], minlength=len(names))
        linked = right & (component != component[x]) & (shared > 0) & (shared >= similarity * (total + total[x] - shared) - 1e-9)
        b.append(np.flatnonzero(linked))
        a.append(np.full(len(b[-1]), x))
    a, b = np.concatenate(a or [index[:0]]), np.concatenate(b or [index[:0]])
    root = smallest_reachable(a, b, len(names))
    some = np.flatnonzero(root != np.arange(len(names)))
    return pa.table({"a": names[some], "b": names[root[some]]})


def across_blocks(open_: DataFrame, texts: DataFrame, size: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """open_: band, node, n, component of large buckets. Links across classes, each two blocks of a bucket in a task."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = open_.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = met.join(texts, "node").select("band", "i", "j", "own", "node", "component", "text")
    return rows.groupBy("band", "i", "j").applyInArrow(lambda t: _block_links(t, size, similarity), "a long, b long")


def _node(text_col: str) -> Column:
    return F.xxhash64(text_col)


def told_apart(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own: doc, text, node, second (another hash of the text). own with nodes that no two texts share, and of every node the smallest doc and the number of copies."""

    def firsts_of(rows: DataFrame) -> DataFrame:
        clash = F.min("second") != F.max("second")
        return written(rows.where("text IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), clash.alias("clash")), "nodes", narrow=True)

    firsts = firsts_of(own)
    if not firsts.where("clash").isEmpty():
        # a table of its own, so that its size is known: next to none share a hash
        clashes = written(firsts.where("clash").select(F.bitwise_not("node").alias("nn")), "clashes", narrow=True)
        own = own.join(clashes, F.col("node") == F.bitwise_not("nn"), "left").withColumn("node", F.when(F.col("nn").isNull(), F.col("node")).otherwise(F.xxhash64("node", "second"))).drop("nn")
        firsts = firsts_of(own)
    return own, firsts.drop("clash")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 5, one_text: bool = False) -> DataFrame:
    """docs with class_id (the smallest id of the class), class_size and kept (its first row, if ids are unique).

    one_text: of a class's different texts with the smallest id only one is kept.
    """
    results = ("class_id", "class_size", "kept")
    columns = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in results}  # no name clashes, and what nobody asks for is pruned
    own = docs.select(*[F.col(c).alias(name) for c, name in columns.items()], ordered_id(id_col).alias("doc"), F.col(text_col).alias("text"), _node(text_col).alias("node"), F.xxhash64(F.lit(1), text_col).alias("second"))
    own, firsts = told_apart(own)
    named = own.where("text IS NOT NULL").select("doc", "node", "text")
    members = banded(named, size, bands, rows).groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("band").alias("nband"), "n")
    buckets = written(members.join(shared, F.col("band") == F.bitwise_not("nband")).select("band", "node", "n"), "buckets", narrow=True)
    # the text that shares the most buckets is the likeliest to be what the others were copied from
    central = buckets.groupBy("node").agg(F.sum("n").alias("met"))
    texts = written(named.join(firsts.join(central, "node", "left_semi").select("node", "doc"), ["node", "doc"]).select("node", "text"), "candidates")
    leaders = buckets.join(central, "node").groupBy("band").agg(F.max_by("node", "met").alias("leader")).select(F.bitwise_not("band").alias("nband"), "leader")
    led = buckets.join(leaders, F.col("band") == F.bitwise_not("nband")).where("node != leader")
    tested = written(led.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs", narrow=True)
    links = written(verified(tested, texts, size, similarity), "links")
    classes = components(links)

    placed = buckets.join(classes, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select(F.bitwise_not("band").alias("nband"))
    open_ = written(placed.join(several, F.col("band") == F.bitwise_not("nband")).drop("nband"), "open", narrow=True)
    few = open_.where(F.col("n") <= FEW)
    side = few.select(F.col("band").alias("b_band"), F.col("node").alias("partner"), F.col("component").alias("other"))
    untested = (
        few.join(side, (F.col("band") == F.col("b_band")) & (F.col("node") < F.col("partner")) & (F.col("component") != F.col("other")))
        .select(F.col("node").alias("a"), F.col("partner").alias("b"))
        .distinct()
        .join(tested, ["a", "b"], "left_anti")
    )
    more = written(verified(untested, texts, size, similarity), "links")
    across = written(across_blocks(open_.where(F.col("n") > FEW), texts, size, similarity), "links")
    classes = components(links.unionByName(more).unionByName(across))

    ids = firsts.join(classes, "node", "left").select("node", "doc", "copies", F.coalesce("component", "node").alias("component"))
    lead = [F.min(F.struct("doc", "node")).getField("node").alias("lead")] if one_text else []
    sizes = ids.groupBy("component").agg(F.min("doc").alias("class_id"), F.sum("copies").alias("class_size"), *lead).select(F.bitwise_not("component").alias("nc"), "class_id", "class_size", *["lead"] * one_text)
    of_node = ids.join(sizes, F.col("component") == F.bitwise_not("nc")).select(F.bitwise_not("node").alias("nn"), "class_id", "class_size", *["lead"] * one_text)
    out = own.withColumn("node", F.when(F.col("text").isNotNull(), F.col("node"))).join(of_node.hint("shuffle_hash"), F.col("node") == F.bitwise_not("nn"), "left")
    class_id = F.coalesce("class_id", "doc")
    kept = class_id == F.col("doc")
    if one_text:
        kept &= F.coalesce(F.col("lead") == F.col("node"), F.lit(True))
    return out.select(*[F.col(name).alias(c) for c, name in columns.items()], F.nullif(class_id, F.lit(NULL_ID)).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), kept.alias("kept"))
