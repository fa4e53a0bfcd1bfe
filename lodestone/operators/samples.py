"""Exposure and sharpness from grey samples: a byte for each, row by row, in a binary column.

Exposure needs only how often each of 256 values occurs. Tiles of one picture, or pieces of
it in several rows, give counts that add up, so clipped and gray_mean are the same whole or by
tiles, to the last digit: they are quotients of whole numbers. Sharpness is the variance of
the Laplacian after the longer side is reduced to LONGEST by areas; a picture is one row.

Defined results: no samples (null or empty) are clipped wholly with mean 0, as an empty crop
is never well exposed, and have no sharpness; samples that are not width * height of them have
none either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to and from which values samples are clipped.
DARK, BRIGHT = 5, 250
#: The longer side that sharpness is taken at, and the shorter one at least.
LONGEST, SHORTEST = 256, 8


def value_counts(pieces: DataFrame, keys: Sequence[str], grey_col: str = "grey") -> DataFrame:
    """keys, value (0 to 255; null for a piece without samples) and n. Counts of several pieces of one key add up; a task counts each piece before anything is exchanged."""
    schema = T.StructType([pieces.schema[k] for k in keys] + [T.StructField("value", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, values, counts = [], [], []
            for i, samples in enumerate(batch.column(grey_col)):
                data = samples.as_buffer() if samples.is_valid else b""
                held = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
                some = np.flatnonzero(held)
                row.append(np.full(max(1, len(some)), i))
                values.append(some if len(some) else np.array([-1]))
                counts.append(held[some] if len(some) else np.array([0]))
            if not row:
                continue
            index, value = pa.array(np.concatenate(row)), np.concatenate(values)
            columns = [batch.column(k).take(index) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value, pa.int32(), mask=value < 0), pa.array(np.concatenate(counts), pa.int64())], schema=pa.schema([*(batch.schema.field(k) for k in keys), ("value", pa.int32()), ("n", pa.int64())]))

    found = pieces.select(*keys, F.col(grey_col).cast("binary").alias(grey_col)).mapInArrow(run, schema)
    return found.groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def exposure(pieces: DataFrame, keys: Sequence[str], grey_col: str = "grey") -> DataFrame:
    """keys, samples, clipped (the share of clipped ones) and gray_mean."""
    counts = value_counts(pieces, keys, grey_col)
    edge = (F.col("value") <= DARK) | (F.col("value") >= BRIGHT)
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("samples"), F.coalesce(F.sum(F.when(edge, F.col("n"))), F.lit(0)).alias("edge"), F.coalesce(F.sum(F.col("value") * F.col("n")), F.lit(0)).alias("light"))
    some = F.col("samples") > 0
    return sums.select(*keys, "samples", F.when(some, F.col("edge") / F.col("samples")).otherwise(1.0).alias("clipped"), F.when(some, F.col("light") / F.col("samples")).otherwise(0.0).alias("gray_mean"))


def overlaps(size: int, wanted: int) -> np.ndarray:
    """wanted x size: how much of each of size equal cells each of wanted ones covers, in whole parts of 1 / wanted; a row's sum is size."""
    first, cell = np.arange(wanted)[:, None] * size, np.arange(size) * wanted
    return np.maximum(np.minimum(first + size, cell + wanted) - np.maximum(first, cell), 0)


def reduced(grey: np.ndarray) -> np.ndarray:
    """grey with the longer side at LONGEST, each sample the mean of the area that it stands for, rounded (halves to even), by whole numbers; smaller pictures as they are."""
    h, w = grey.shape
    if max(h, w) <= LONGEST:
        return grey
    scale = LONGEST / max(h, w)
    rows, columns = (overlaps(n, max(SHORTEST, int(n * scale))) for n in (h, w))
    return np.rint(rows @ grey.astype(np.int64) @ columns.T / (h * w))


def laplacian_variance(grey: np.ndarray) -> float:
    """The variance of the four neighbours' sum less four times a sample; beyond an edge the picture is mirrored without its edge."""
    padded = np.pad(grey.astype(np.float64), [(1, 1) if n > 1 else (0, 0) for n in grey.shape], mode="reflect")
    padded = np.pad(padded, [(0, 0) if n > 1 else (1, 1) for n in grey.shape], mode="edge")
    return float((padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * padded[1:-1, 1:-1]).var())


def with_sharpness(pictures: DataFrame, grey_col: str = "grey", width_col: str = "width", height_col: str = "height") -> DataFrame:
    """pictures with blur_score, in place of a column of that name."""
    kept = [f for f in pictures.schema.fields if f.name != "blur_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for samples, w, h in zip(*(batch.column(c) for c in (grey_col, width_col, height_col)), strict=True):
                grey = np.frombuffer(samples.as_buffer(), np.uint8) if samples.is_valid else np.empty(0, np.uint8)
                shape = (h.as_py() or 0, w.as_py() or 0)
                whole = len(grey) and min(shape) > 0 and len(grey) == shape[0] * shape[1]
                scores.append(laplacian_variance(reduced(grey.reshape(shape))) if whole else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(scores, pa.float64())], names=[*(f.name for f in kept), "blur_score"])

    return pictures.mapInArrow(run, T.StructType([*kept, T.StructField("blur_score", T.DoubleType())]))
