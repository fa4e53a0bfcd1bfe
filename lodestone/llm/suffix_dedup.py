"""Suffix-array dedup: every byte covered by a long string that stands elsewhere too.

Texts are UTF-8 bytes, matches never cross texts, and strings are judged on the input. The
search is exact and shuffles no string that stands only once:

1. Every string of `length` bytes has an anchor, the rightmost of its shorter substrings with
   the smallest hash, so equal strings have equal anchors at equal places. Neighbouring
   strings with one anchor make a run; a corpus has a run for every 75 bytes or so. One
   aggregation over the anchors' hashes finds those that several runs have.
2. Runs of one anchor with one and the same content are repeats from end to end, so copies
   are counted before anything is shuffled. Each distinct content is taken once, cut out of
   its text, and dealt by anchor to shards.
3. A shard concatenates its cuttings in the order of the documents and builds their suffix
   array by doubling prefixes. The previous and next smaller positions in suffix order give
   each position's longest previous factor; where that reaches the length, the string stands
   earlier too, and the neighbour it shares the length with stands again.
4. An anchor with more than HOT_RUNS distinct contents would make its shard too large. Its
   runs are cut by the distance from string to anchor into parts, keyed by the bytes that a
   part's strings share; parts of one content are counted, the distinct ones are shards. What
   is too large even then is counted string by string in one aggregation.
5. The spans found go back to their texts, which cut them out.

keep_first leaves the earliest copy, by id, hash of the text and place, and removes those
after it; otherwise all copies go. Rows with equal id and text count as one place for that
order and so keep or lose the same bytes.

Defined results: a null or empty text has no bytes and loses none; a null id comes after all
others; texts shorter than the length stay whole; a very long text is hashed whole by one
task; an empty table gives an empty table; columns with the names of the results are replaced,
the others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe import released, text_slices, texts_of
from lodestone.llm.common import ordered_id, text_or_empty, written

#: Distinct contents from which a key is no shard, and parts into which an anchor's runs are then cut.
HOT_RUNS, HOT_PARTS = 2000, 16
#: Bytes of cuttings from which a shard is sorted.
SHARD_BYTES = 1 << 20
#: Bytes by which suffixes are ranked at first.
STEP = 7

_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base][:n]


class RollingHash:
    """64-bit hashes of substrings."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_B, len(data)), out=self.sums[1:])
        self.down = _power(_B_INVERSE, len(data) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def all(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rightmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of width values, where its last smallest one is."""
    value, place, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        right = value[step:] <= value[: len(value) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        value = np.where(right, value[step:], value[: len(value) - step])
        have += step
    return place


def runs_of(texts: list[bytes], length: int, anchor: int) -> dict[str, np.ndarray]:
    """The runs of some texts: text, lo and hi (first and last string), off (of the anchor from lo), ah and sh (hashes of the anchor, and of content and shape)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < length:
        return {k: none for k in ("text", "lo", "hi", "off", "ah", "sh")}
    text = np.repeat(np.arange(len(texts)), sizes)
    rolling = RollingHash(data)
    hashes = rolling.all(anchor)
    place = rightmost_minimum(hashes, length - anchor + 1)
    start = np.flatnonzero(np.arange(len(place)) + length <= ends[text[: len(place)]])
    if not len(start):
        return {k: none for k in ("text", "lo", "hi", "off", "ah", "sh")}
    at = place[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    lo, at = start[new], at[new].astype(np.int64)
    hi = start[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]
    shape = ((at - lo) << 20 | (hi - lo)).astype(np.uint64)
    sh = mixed(rolling.of(lo, hi + length) ^ mixed(shape + np.uint64(1)))
    base = (ends - sizes)[text[lo]]
    return {"text": text[lo], "lo": lo - base, "hi": hi - base, "off": at - lo, "ah": hashes[at].view(np.int64), "sh": sh.view(np.int64)}


class Suffixes:
    """The suffixes of some snippets, none of which reaches into the next, in lexicographic order.

    Prefixes double: ranks by STEP bytes and the length of what is shorter give those by
    twice as many, of which only groups that still tie are sorted. The ranks of all lengths are kept, so
    common prefixes of any two suffixes follow from the longest length down.
    """

    def __init__(self, snippets: list[bytes]) -> None:
        sizes = np.array([len(s) for s in snippets], np.int64)
        self.data = np.frombuffer(b"".join(snippets), np.uint8)
        n = len(self.data)
        self.end = np.repeat(np.cumsum(sizes), sizes)
        self.left = self.end - np.arange(n)
        padded = np.concatenate([self.data, np.zeros(STEP, np.uint8)]).astype(np.uint64)
        self.words = np.zeros(n, np.uint64)
        for k in range(STEP):
            self.words = self.words << np.uint64(8) | np.where(self.left > k, padded[k : n + k], np.uint64(0))
        self.words = self.words << np.uint64(8) | np.minimum(self.left, STEP).astype(np.uint64)
        order = np.argsort(self.words, kind="stable")
        ranked = self.words[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], ranked[1:] != ranked[:-1]]), np.arange(n), 0)) if n else 0
        self.ranks, width = [rank], STEP
        longest = int(sizes.max(initial=0))
        while width < longest:
            tied = self._tied(rank)
            if not len(tied):
                break
            more = tied + width < self.end[tied]
            after = np.where(more, rank[np.minimum(tied + width, n - 1)].astype(np.int64) + 1, 0)
            key = rank[tied].astype(np.int64) * (n + 1) + after
            order = np.argsort(key, kind="stable")
            key, own = key[order], rank[tied][order]
            place = np.arange(len(key))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), place, 0))
            part = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), place, 0))
            rank = rank.copy()
            rank[tied[order]] = own + (part - group)
            self.ranks.append(rank)
            width *= 2
        self.order = np.argsort(rank, kind="stable")  # equal suffixes by position

    @staticmethod
    def _tied(rank: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each two suffixes."""
        got = np.zeros(len(i), np.int64)
        last = len(self.data) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = np.minimum(i + got, last), np.minimum(j + got, last)
            same = (i + got < self.end[i]) & (j + got < self.end[j]) & (self.ranks[k][a] == self.ranks[k][b])
            got += np.where(same, np.minimum(STEP << k, self.left[a]), 0)
        a, b = np.minimum(i + got, last), np.minimum(j + got, last)
        inside = (i + got < self.end[i]) & (j + got < self.end[j])
        apart = (self.words[a] ^ self.words[b]) >> np.uint64(8)
        equal = STEP - np.ceil(np.log2(apart.astype(np.float64) + 1) / 8).astype(np.int64)
        return got + np.where(inside, np.minimum(equal, np.minimum(self.left[a], self.left[b])), 0)

    def smaller_neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position the nearest smaller positions before and after it in suffix order, or -1.

        A candidate that is not smaller passes on its own candidate: all between are larger still.
        """
        n = len(self.order)
        out = []
        for sa in (self.order, self.order[::-1]):
            sa = np.concatenate([sa, [-1]])  # place -1 is smaller than all
            at = np.arange(-1, n - 1)
            open_ = np.flatnonzero(sa[at] > sa[:n])
            while len(open_):
                at[open_] = at[at[open_]]
                open_ = open_[sa[at[open_]] > sa[open_]]
            found = np.empty(n, np.int64)
            found[sa[:n]] = sa[at]
            out.append(found)
        return out[0], out[1]

    def longest_previous_factors(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the positions some: where their previous and next smaller positions are, and the lengths in common with these; the larger length is the longest previous factor."""
        before, after = (x[some] for x in self.smaller_neighbours())
        lengths = [np.where(x >= 0, self.common(some, np.maximum(x, 0)), 0) for x in (before, after)]
        return before, after, lengths[0], lengths[1]


def repeated_strings(snippets: list[bytes], length: int, keep_first: bool) -> list[np.ndarray]:
    """For each snippet, which of its strings stand in an earlier place (keep_first) or in any other."""
    sizes = np.array([len(s) for s in snippets])
    counts = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    suffixes = Suffixes(snippets)
    starts = np.flatnonzero(suffixes.left >= length)
    before, after, shared_before, shared_after = suffixes.longest_previous_factors(starts)
    flags = np.zeros(len(suffixes.data), bool)
    flags[starts[np.maximum(shared_before, shared_after) >= length]] = True
    if not keep_first:  # the first copy is the smaller neighbour of the second
        flags[before[shared_before >= length]] = True
        flags[after[shared_after >= length]] = True
    return [flags[b : b + n] for b, n in zip(begin, counts, strict=True)]


_LONG = T.LongType()


def _schema(*names: str, **others: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _LONG) for n in names] + [T.StructField(n, t) for n, t in others.items()])


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def runs(rows: DataFrame, length: int, anchor: int, placed: bool) -> DataFrame:
    """ah, sh and, if placed, doc, th, lo, hi, off of every run."""
    names = ("ah", "sh", "doc", "th", "lo", "hi", "off") if placed else ("ah", "sh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = _columns(batch, "doc", "th")
            for part, texts in text_slices(batch, "text", 1 << 19):
                found = runs_of(texts, length, anchor)
                found |= {"doc": doc[part.start + found["text"]], "th": th[part.start + found["text"]]}
                yield pa.RecordBatch.from_pydict({n: pa.array(found[n], pa.int64()) for n in names})

    return rows.select("doc", "th", "text").mapInArrow(lambda batches: released(run(batches)), _schema(*names))


def cuttings(asked: DataFrame, length: int, anchor: int, parts: int = 1) -> DataFrame:
    """asked: rows with text, doc, th and wanted, a list of runs. A row for each run, or for each of its parts: ah (or the hash of what the part's strings share), doc, th, lo, snippet."""
    width = length - anchor + 1

    def cut(text: bytes, w: dict) -> Iterator[tuple[int, int, bytes]]:
        if parts == 1:
            yield w["ah"], w["lo"], text[w["lo"] : w["hi"] + length]
            return
        at = w["lo"] + w["off"]
        for i in range(parts):
            near, far = i * width // parts, (i + 1) * width // parts - 1  # distances from string to anchor
            lo, hi = max(w["lo"], at - far), min(w["hi"], at - near)
            if lo <= hi:
                shared = hashlib.blake2b(text[at - near : at - far + length] + bytes([i]), digest_size=8).digest()
                yield int.from_bytes(shared, "little", signed=True), lo, text[lo : hi + length]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out: list[tuple] = []
            texts = texts_of(batch, "text")
            wanted = batch.column(batch.schema.get_field_index("wanted"))
            for text, doc, th, some in zip(texts, *(c.tolist() for c in _columns(batch, "doc", "th")), wanted, strict=True):
                if (doc, th) in seen:  # a repeated row is the same place
                    continue
                seen.add((doc, th))
                out += [(key, doc, th, lo, snippet) for w in some.as_py() for key, lo, snippet in cut(text, w)]
            for at in range(0, len(out), 20_000):
                columns = list(zip(*out[at : at + 20_000], strict=True))
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.binary() if n == "snippet" else pa.int64()) for n, c in zip(("ah", "doc", "th", "lo", "snippet"), columns, strict=True)})

    return asked.mapInArrow(lambda batches: released(run(batches)), _schema("ah", "doc", "th", "lo", snippet=T.BinaryType()))


def repeats_of_parts(parts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """doc, th, b, e: the repeated strings of very common anchors' parts."""
    place = F.struct("doc", "th", "lo")
    # repeated rows may have been cut in several tasks
    pieces = written(parts.withColumn("sh", F.xxhash64("snippet")).dropDuplicates(["ah", "doc", "th", "lo"]), "hot-parts")
    contents = written(pieces.groupBy("ah", "sh").agg(F.count("*").alias("n"), F.min(place).alias("rep"), F.first("snippet").alias("snippet")), "hot-contents")
    again = contents.where("n > 1").select(F.bitwise_not("ah").alias("nah"), F.bitwise_not("sh").alias("nsh"), "rep")
    copies = pieces.join(again, (F.col("ah") == F.bitwise_not("nah")) & (F.col("sh") == F.bitwise_not("nsh")))
    if keep_first:
        copies = copies.where(place != F.col("rep"))
    large = contents.groupBy("ah").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT_RUNS).select(F.bitwise_not("ah").alias("nah"))
    once = contents.select("ah", "rep.doc", "rep.th", "rep.lo", "snippet")
    is_large = F.col("ah") == F.bitwise_not("nah")
    found = copies.select("doc", "th", F.col("lo").alias("b"), (F.col("lo") + F.octet_length("snippet")).alias("e"))
    found = found.unionByName(shards(once.join(large, is_large, "left_anti"), length, keep_first))
    return found.unionByName(repeats_one_by_one(once.join(large, is_large, "left_semi"), length, keep_first))


def repeats_one_by_one(cut: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """doc, th, b, e: the repeated strings of cuttings of very common keys, by one aggregation over the strings' hashes: no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            snippets = batch.column(batch.schema.get_field_index("snippet")).to_pylist()
            counts = np.array([len(s) - length + 1 for s in snippets], np.int64)
            hashes = [RollingHash(np.frombuffer(s, np.uint8)).all(length) for s in snippets]
            ah, doc, th, lo = (np.repeat(c, counts) for c in _columns(batch, "ah", "doc", "th", "lo"))
            at = lo + np.arange(len(lo)) - np.repeat(np.cumsum(counts) - counts, counts)
            columns = {"ah": ah, "h": np.concatenate([*hashes, np.empty(0, np.uint64)]).view(np.int64), "doc": doc, "th": th, "b": at}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in columns.items()})

    strings = written(cut.mapInArrow(lambda batches: released(run(batches)), _schema("ah", "h", "doc", "th", "b")), "hot-strings")
    place = F.struct("doc", "th", "b")
    again = strings.groupBy("ah", "h").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select(F.bitwise_not("ah").alias("nah"), F.bitwise_not("h").alias("nh"), "first")
    found = strings.join(again, (F.col("ah") == F.bitwise_not("nah")) & (F.col("h") == F.bitwise_not("nh")))
    if keep_first:
        found = found.where(place != F.col("first"))
    return found.select("doc", "th", "b", (F.col("b") + length).alias("e"))


def shards(cut: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """doc, th, b, e: the spans of bytes that the suffix arrays of the shards find."""

    def spans(waiting: list[tuple]) -> pa.RecordBatch:
        # repeated rows may have been cut in several tasks; no two strings of a text begin at one place
        waiting = sorted({w[:3]: w for w in waiting}.values(), key=lambda w: w[:3])
        found = repeated_strings([w[3] for w in waiting], length, keep_first)
        out: dict[str, list] = {"doc": [], "th": [], "b": [], "e": []}
        for (doc, th, lo, _), flags in zip(waiting, found, strict=True):
            if not flags.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for n, v in zip(out, (doc, th, lo + b, lo + e - 1 + length), strict=True):
                    out[n].append(v)
        return pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            snippets = batch.column(batch.schema.get_field_index("snippet")).to_pylist()
            for key, doc, th, lo, snippet in zip(*(c.tolist() for c in _columns(batch, "ah", "doc", "th", "lo")), snippets, strict=True):
                if key != last and size >= SHARD_BYTES:
                    yield spans(waiting)
                    waiting, size = [], 0
                last = key
                waiting.append((doc, th, lo, snippet))
                size += len(snippet)
        if waiting:
            yield spans(waiting)

    dealt = cut.repartition("ah").sortWithinPartitions("ah")
    return dealt.mapInArrow(lambda batches: released(run(batches)), _schema("doc", "th", "b", "e"))


def repeated_spans(rows: DataFrame, length: int, keep_first: bool, anchor: int | None = None) -> DataFrame:
    """rows: doc, th (which name a text) and text, null nowhere. doc, th, b, e: spans of bytes to remove, which may overlap."""
    anchor = anchor or length // 4
    common = (
        runs(rows, length, anchor, placed=False)
        .groupBy("ah")
        .agg(F.count("*").alias("n"), F.min("sh").alias("least"), F.max("sh").alias("most"))
        .where("n > 1")
        .select(F.bitwise_not("ah").alias("nah"), (F.col("least") != F.col("most")).alias("mixed"))
    )
    placed = runs(rows, length, anchor, placed=True)
    # the complement makes Spark deal both sides anew, so that it can split an anchor that many runs have
    shared = written(placed.join(common, F.col("ah") == F.bitwise_not("nah")).drop("nah"), "shared-runs", narrow=True)
    whole = ["doc", "th", F.col("lo").alias("b"), (F.col("hi") + length).alias("e")]
    place = F.struct("doc", "th", "lo")
    alike = shared.where(~F.col("mixed"))
    if keep_first:
        firsts = alike.groupBy("ah").agg(F.min(place).alias("first")).select(F.bitwise_not("ah").alias("nah"), "first")
        alike = alike.join(firsts, F.col("ah") == F.bitwise_not("nah")).where(place != F.col("first"))
    varied = shared.where("mixed")
    contents = varied.groupBy("ah", "sh").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "lo", "hi", "off")).alias("rep"))
    again = contents.where("n > 1").select(F.bitwise_not("ah").alias("nah"), F.col("sh").alias("rep_sh"), F.col("rep"))
    copies = varied.join(again, (F.col("ah") == F.bitwise_not("nah")) & (F.col("sh") == F.col("rep_sh")))
    if keep_first:
        copies = copies.where(place != F.struct("rep.doc", "rep.th", "rep.lo"))
    hot = written(contents.groupBy("ah").agg(F.count("*").alias("kinds")).where(F.col("kinds") > HOT_RUNS).select(F.bitwise_not("ah").alias("nah")), "hot-anchors", narrow=True)
    texts = rows.select("doc", "th", "text")

    def cut(some: DataFrame, parts: int = 1) -> DataFrame:
        wanted = some.select("rep.doc", "rep.th", F.struct("ah", "rep.lo", "rep.hi", "rep.off").alias("w")).groupBy("doc", "th").agg(F.collect_list("w").alias("wanted"))
        return cuttings(texts.join(wanted.hint("shuffle_hash"), ["doc", "th"]), length, anchor, parts)

    is_hot = F.col("ah") == F.bitwise_not("nah")
    found = alike.select(*whole).unionByName(copies.select(*whole)).unionByName(shards(cut(contents.join(hot, is_hot, "left_anti")), length, keep_first))
    if not hot.isEmpty():
        found = found.unionByName(repeats_of_parts(cut(contents.join(hot, is_hot, "left_semi"), HOT_PARTS), length, keep_first))
    return found


def remove_repeats(docs: DataFrame, *, length: int = 200, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """docs with kept binary (the bytes left), n_bytes, n_removed and n_spans (maximal removed runs).

    as_text: kept is a string, without what the cuts left of characters.
    """
    added = {"n_bytes": _LONG, "n_removed": _LONG, "n_spans": _LONG, "kept": T.StringType() if as_text else T.BinaryType()}
    others = [f for f in docs.schema.fields if f.name not in added]
    text = text_or_empty(text_col)
    rows = docs.select(F.struct(*[f.name for f in others]).alias("row"), ordered_id(id_col).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(rows.select("doc", "th", "text"), length, keep_first)
    removed = spans.groupBy("doc", "th").agg(F.collect_set(F.struct("b", "e")).alias("spans"))
    # hashed on the short side, so that texts are not sorted
    joined = rows.join(removed.hint("shuffle_hash"), ["doc", "th"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            row = batch.column(batch.schema.get_field_index("row"))
            out: dict[str, list] = {n: [] for n in added}
            for text, spans in zip(texts, batch.column(batch.schema.get_field_index("spans")), strict=True):
                kept, n, at = [], 0, 0
                for b, e in sorted((s["b"], s["e"]) for s in spans.as_py() or ()):
                    if b > at or not n:
                        kept.append(text[at:b])
                        n += 1
                    at = max(at, e)
                kept.append(text[at:])
                left = b"".join(kept)
                for name, v in zip(added, (len(text), len(text) - len(left), n, left.decode("utf-8", "ignore") if as_text else left), strict=True):
                    out[name].append(v)
            columns = {f.name: row.field(i) for i, f in enumerate(others)}
            columns |= {n: pa.array(v, (pa.string() if as_text else pa.binary()) if n == "kept" else pa.int64()) for n, v in out.items()}
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(lambda batches: released(run(batches)), T.StructType(others + [T.StructField(n, t) for n, t in added.items()]))
