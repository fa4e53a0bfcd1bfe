"""Sharding by a uniform shuffle with exact shard sizes, after a hypergeometric communication matrix.

How many rows of each block (a task's rows) go to each shard of a uniform shuffle is a matrix
whose rows and columns have given sums: block sizes and shard sizes. It is drawn exactly,
before any row moves, by halving: of the rows of a run of blocks, the share of its first half
in each shard is a multivariate hypergeometric draw. A task draws only the halves above its
own block, seeded by what the run is, so all tasks agree and none needs the whole matrix.
A block's rows lie in random order, so the first of them go to the first shard and so on;
that is one exchange, and within shards the rows are put in random order again. Numbers within
a shard come from buckets of random keys, so no task holds a shard.

What the driver holds is one count for each block. Rows are placed by random keys of their
own, not of their contents, so repeated rows are spread like others. The blocks are written
once: a task that runs again finds the same rows under the same numbers.

Defined results: a null text has no bytes (size 8) and the checksum of the empty text; null ids
and repeated rows are rows like all others; equal texts form no unit, the law is of rows; an
empty table gives an empty table; of columns with the names of this operator's results, the
input's go.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import text_or_empty, written

#: Rows of a shard that are put in order together, about.
BUCKET = 1 << 14
#: Added to the bytes of a text for its length.
HEAD = 8
PLACES = (1 << 33) - 1
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws from good + bad things without return are good, for counts of any size.

    By inversion over the values within 12 deviations and 60 of the likeliest; what lies
    beyond has no weight in double precision.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode, total = (draws + 1) * (good + 1) // (good + bad + 2), good + bad
    deviation = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(12 * deviation) + 60
    first, last = max(low, min(mode, high) - reach), min(high, max(mode, low) + reach)
    k = np.arange(first, last, dtype=np.float64)
    weight = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1)))])
    cumulated = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(cumulated, rng.random() * cumulated[-1], side="right").clip(0, last - first))


def split_draw(rng: np.random.Generator, sizes: Sequence[int], draws: int) -> list[int]:
    """How many of draws without return come from each of several kinds of things."""
    rest, out = sum(sizes), []
    for size in sizes:
        rest -= size
        out.append(hypergeometric(rng, size, rest, draws))
        draws -= out[-1]
    return out


class CommunicationMatrix:
    """Rows of the matrix of block_sizes by shard_sizes, drawn by halving runs of blocks."""

    def __init__(self, block_sizes: Sequence[int], shard_sizes: Sequence[int], seed: int) -> None:
        self.before = [0, *np.cumsum(np.array(block_sizes, dtype=np.int64)).tolist()]
        self.shard_sizes, self.seed = list(shard_sizes), seed
        self.drawn: dict[tuple[int, int], list[int]] = {}

    def row(self, block: int) -> list[int]:
        """How many of the block's rows go to each shard."""
        first, end, sizes = 0, len(self.before) - 1, self.shard_sizes
        while end - first > 1:
            half = (first + end) // 2
            if (first, end) not in self.drawn:
                rng = np.random.default_rng([self.seed, first, end])
                self.drawn[first, end] = split_draw(rng, sizes, self.before[half] - self.before[first])
            left = self.drawn[first, end]
            if block < half:
                end, sizes = half, left
            else:
                first, sizes = half, [a - b for a, b in zip(sizes, left, strict=True)]
        return sizes


def even_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def in_blocks(docs: DataFrame, seed: int) -> DataFrame:
    """docs written with block (the task that wrote a row) and place, its number in a random order of the block."""
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), F.monotonically_increasing_id()).alias("key"))
    placed = keyed.sortWithinPartitions("key").select("row", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().bitwiseAND(PLACES).alias("place"))
    return written(placed, "shard-blocks")


def with_shards(blocks: DataFrame, matrix: CommunicationMatrix, numbers: dict[int, int]) -> DataFrame:
    """blocks with the shard that the block's row of the matrix gives to the place. numbers: the matrix row of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, place = batch.column("block").to_numpy(), batch.column("place").to_numpy()
            shard = np.empty(len(block), np.int32)
            for b in np.unique(block).tolist():
                here = block == b
                shard[here] = np.searchsorted(np.cumsum(matrix.row(numbers[b])), place[here], side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=[*batch.schema.names, "shard"])

    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField("shard", T.IntegerType())]))


def shard_rows(docs: DataFrame, *, shards: int = 24, seed: int = 2024, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs in a uniform random order dealt to shards whose row counts are at most one apart.

    Adds size (bytes of the text and 8), text_crc32, law, shard, slot (the row's number in its
    shard, gapless from 0) and grown_shard, which this law leaves null. keep_text=False leaves
    the text behind, so only what is short is written and exchanged.
    """
    text = text_or_empty(text_col)
    others = [c for c in docs.columns if c not in RESULTS and (keep_text or c != text_col)]
    digests = docs.select(*others, (F.octet_length(text) + F.lit(HEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    blocks = in_blocks(digests, seed)
    counts = {r["block"]: r["n"] for r in blocks.groupBy("block").agg(F.count("*").alias("n")).collect()}
    numbers = {b: k for k, b in enumerate(sorted(counts))}
    matrix = CommunicationMatrix([counts[b] for b in sorted(counts)], even_sizes(sum(counts.values()), shards), seed)
    bits = max(0, max(matrix.shard_sizes) - 1).bit_length() - (BUCKET - 1).bit_length()
    key = F.xxhash64(F.lit(seed), F.lit("slot"), "block", "place")
    bucket = F.shiftrightunsigned(key, 64 - bits) if bits > 0 else F.lit(0).cast("long")

    sizes = with_shards(blocks.select("block", "place"), matrix, numbers).groupBy("shard", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    dealt = with_shards(blocks, matrix, numbers).select("row", "shard", "block", "place", key.alias("key"), bucket.alias("bucket"))
    within = Window.partitionBy("shard", "bucket").orderBy("key", "block", "place")
    numbered = dealt.withColumn("number", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"])
    return numbered.select(
        *[F.col("row").getField(c).alias(c) for c in [*others, "size", "text_crc32"]],
        F.lit("rows").alias("law"),
        "shard",
        (F.col("offset") + F.col("number")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
