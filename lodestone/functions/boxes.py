"""Boxes: structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def clipped(raw: Column, width: Column, height: Column) -> Column:
    """Whole numbers within the frame, at least one wide and high; halves go to the even number. Null unless finite."""
    x1, y1, x2, y2 = (F.bround(raw[s]).cast("int") for s in SIDES)
    left = F.greatest(F.lit(0), F.least(width - 1, x1))
    top = F.greatest(F.lit(0), F.least(height - 1, y1))
    all_finite = finite(raw["x1"]) & finite(raw["y1"]) & finite(raw["x2"]) & finite(raw["y2"])
    return F.when(all_finite, F.struct(left.alias("x1"), top.alias("y1"), F.greatest(left + 1, F.least(width, x2)).alias("x2"), F.greatest(top + 1, F.least(height, y2)).alias("y2")))


def padded(box: Column, width: Column, height: Column, pad: float = 0.08) -> Column:
    """The box with a margin, within the frame."""
    dx, dy = ((box["x2"] - box["x1"]) * F.lit(pad)).cast("int"), ((box["y2"] - box["y1"]) * F.lit(pad)).cast("int")
    return F.struct(
        F.greatest(F.lit(0), box["x1"] - dx).alias("x1"), F.greatest(F.lit(0), box["y1"] - dy).alias("y1"), F.least(width, box["x2"] + dx).alias("x2"), F.least(height, box["y2"] + dy).alias("y2")
    )


def area(box: Column) -> Column:
    return (box["x2"] - box["x1"]).cast("long") * (box["y2"] - box["y1"])


def iou(a: Column, b: Column) -> Column:
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.greatest(wide, F.lit(0)).cast("long") * F.greatest(high, F.lit(0))
    side = lambda box, p, q: F.greatest(F.lit(1), box[q] - box[p]).cast("long")
    union = side(a, "x1", "x2") * side(a, "y1", "y2") + side(b, "x1", "x2") * side(b, "y1", "y2") - inter
    return F.when(inter > 0, inter / union).otherwise(0.0)


def tile_starts(length: Column, size: int, overlap: float) -> Column:
    """Where tiles of that size begin along a length."""
    step = max(1, round(size * (1.0 - overlap)))
    last = length - size
    inner = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))
    return F.when(length <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(inner, F.array(last))))
