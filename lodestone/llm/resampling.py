"""Target-distribution importance resampling over hashed runs of words.

Words are found by a byte automaton over Arrow's UTF-8 buffers, many documents at a time:
a table classes every byte (and lower-cases A-Z), the differences of neighbouring classes are
the borders of words, and the checksums of all words advance side by side, a byte a step,
by the table of CRC-32. A word beyond 256 bytes advances by zlib from there on, which gives
the same number. Features are runs of words; a run's checksum goes on from that of the run
without its last word.

A task returns one count for each bucket, so what is shuffled of the feature counts does not
grow with the texts. Buckets are a parameter, and so is what is broadcast: one whole number
for each. A document is drawn by its weight and noise of its own (a Gumbel variate of a hash of
the id), so the sample is without return and does not depend on how rows lie.
The ranks come from a range exchange of the rows at or above the last drawn score, with the
counts of its tasks; the driver holds these counts and one for each distinct score, of which
there are some 10^5 at most: weights lie within 1000 ln of the largest count, noise in -3,200
to 22,900.

Defined results: a null or empty text has no features, weight 0 and no rank; a null id is
hashed as the empty one and comes after all others; repeated rows are drawn each for itself,
ties of score and id by further hashes of the row; a very long text is classed whole in its
task; without documents there are no rows, without targets all counts of them are 0; of
columns with the names of this operator's results, the input's go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import ordered_id, written

#: Bytes of texts that are classed together, unless one text is longer.
SLICE_BYTES = 4 << 20
#: Bytes of a word that advance beside those of others.
SIDE_BY_SIDE = 256
RESULTS = ("n_words", "n_features", "weight", "score", "rank")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


CRC = _crc_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += ord("a") - ord("A")
#: Whether a byte belongs to a word, once A-Z are lower-cased: digits, a-z and all beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[ord("0") : ord("9") + 1] = IN_WORD[ord("a") : ord("z") + 1] = IN_WORD[0x80:] = True


def advanced(states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of data[start : start + length] of each."""
    order = np.argsort(-np.minimum(lengths, SIDE_BY_SIDE), kind="stable")
    state, at, length = states[order], starts[order], lengths[order]
    shorter = np.searchsorted(-np.minimum(length, SIDE_BY_SIDE), -np.arange(SIDE_BY_SIDE), side="left")  # how many are longer than 0, 1, 2...
    for step, n in enumerate(shorter.tolist()):
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ data[at[:n] + step]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    for k in np.flatnonzero(length > SIDE_BY_SIDE).tolist():
        rest = data[at[k] + SIDE_BY_SIDE : at[k] + length[k]]
        state[k] = zlib.crc32(rest, int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(states)
    out[order] = state
    return out


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of lower-cased data, and how many words lie before each document."""
    inside = IN_WORD[data]
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    filled = offsets[:-1][np.diff(offsets) > 0]  # documents begin here, the one before ends
    before[filled] = False
    after[filled[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def run_buckets(data: np.ndarray, offsets: np.ndarray, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2... words: their buckets in order, and how many lie before each document."""
    data = LOWER[data]
    starts, lengths, words_before = words_in(data, offsets)
    states = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for size in range(1, runs + 1):
        last = starts[size - 1 :]
        states = advanced(states[: len(last)], data, last, lengths[size - 1 :])
        n_runs = np.maximum(np.diff(words_before) - size + 1, 0)
        first = np.repeat(words_before[:-1], n_runs) + np.arange(n_runs.sum()) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
        yield ((states[first] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), np.concatenate([[0], np.cumsum(n_runs)])
        states = CRC[(states ^ np.uint32(ord(" "))) & np.uint32(0xFF)] ^ (states >> np.uint32(8))
        states = states[: max(0, len(starts) - size)]


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of some whole texts, one after the other, and where each begins; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offset_buffer, value_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    values = np.frombuffer(value_buffer, np.uint8) if value_buffer is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield values[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def bucket_counts(docs: DataFrame, *, text_col: str = "text", runs: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): features of all texts; a bucket without any has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, offsets in slices(batch.column(0)):
                for found, _ in run_buckets(data, offsets, runs, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, targets: DataFrame, *, docs_text: str = "text", targets_text: str = "text", runs: int = 1, buckets: int = 10_000) -> np.ndarray:
    """A whole number for each bucket: 1000 times the logarithm of how much more often targets hold it than documents do, both smoothed by one in each bucket."""
    sides = bucket_counts(docs, text_col=docs_text, runs=runs, buckets=buckets).withColumn("target", F.lit(0))
    sides = sides.unionByName(bucket_counts(targets, text_col=targets_text, runs=runs, buckets=buckets).withColumn("target", F.lit(1)))
    n = np.zeros((2, buckets))
    for r in sides.collect():  # two rows for each bucket at most
        n[r["target"], r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = n, n.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, *, text_col: str = "text", runs: int = 1, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with n_words, n_features and weight, the floored mean of the gains of a document's features."""
    kept = [c for c in docs.columns if c not in RESULTS and (keep is None or c in keep)]
    wanted = list(dict.fromkeys([*kept, text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for data, offsets in slices(batch.column(text_col)):
                words, n, total = None, np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
                for found, before in run_buckets(data, offsets, runs, len(gain)):
                    words = np.diff(before) if words is None else words
                    n += np.diff(before)
                    total += np.diff(np.concatenate([[0], np.cumsum(gain[found])])[before])
                parts.append(np.stack([words, n, total // np.maximum(n, 1)]))
            added = np.concatenate(parts, axis=1) if parts else np.empty((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, added)], names=[*kept, *RESULTS[:3]])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in RESULTS[:3]])
    return docs.select(*wanted).mapInArrow(run, schema)


def noise(id_col: str, seed: int) -> Column:
    """A Gumbel variate of the id's hash, times 1000, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def numbered(df: DataFrame, order: list[Column], number: str, name: str) -> DataFrame:
    """df with each row's number from 1 in the order of all rows: by the row's place in its task after a range exchange, and the counts of the tasks before."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct("*").alias("row"), F.spark_partition_id().alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
    placed = written(placed, name)
    counts = sorted((r["block"], r["n"]) for r in placed.groupBy("block").agg(F.count("*").alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=0)
    offsets = df.sparkSession.createDataFrame([(b, o) for (b, _), o in zip(counts, before, strict=False)], "block int, offset long")
    return placed.join(F.broadcast(offsets), "block").select("row.*", (F.col("offset") + F.col("place") + 1).alias(number))  # one row for each task


def resampled(
    docs: DataFrame,
    targets: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    min_words: int = 20,
    seed: int = 2024,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """docs with n_words, n_features, weight, score and rank.

    Of the documents with at least min_words words, percent in a hundred are drawn, those of
    the highest scores, ties by the smaller id: rank 1, 2, 3...; others have none. keep: the
    columns that stay, all by default.
    """
    gain = gains(docs, targets, docs_text=text_col, targets_text=text_col, runs=runs, buckets=buckets)
    keep = tuple(docs.columns) if keep is None else keep
    scored = written(weighed(docs, gain, text_col=text_col, runs=runs, keep=(*keep, id_col)).withColumn("score", F.col("weight") + noise(id_col, seed)), "scored")
    out = [c for c in scored.columns if c in keep or c in RESULTS]
    by_score = scored.where(F.col("n_words") >= min_words).groupBy("score").agg(F.count("*").alias("n")).collect()
    wanted = percent * sum(r["n"] for r in by_score) // 100
    least, seen = None, 0
    for score, n in sorted(((r["score"], r["n"]) for r in by_score), reverse=True):
        if seen >= wanted:
            break
        least, seen = score, seen + n
    if least is None:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    near = (F.col("n_words") >= min_words) & (F.col("score") >= least)
    plain = [c for c in scored.columns if not isinstance(scored.schema[c].dataType, T.MapType)]
    order = [F.col("score").desc(), ordered_id(id_col).asc(), F.xxhash64(*plain).asc()]
    ranked = numbered(scored.where(near), order, "rank", "drawn").withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.select(*out, "rank").unionByName(scored.where(~near).select(*out, F.lit(None).cast("long").alias("rank")))
