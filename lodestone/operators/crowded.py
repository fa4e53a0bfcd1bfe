"""Greedy suppression in images of very many boxes, spread over tasks.

A box is settled once all stronger boxes that it overlaps are. Each round cuts images into the cells
of a grid and deals every box that is left to the one cell of its middle. A box is the cell's own
if all boxes that it may overlap by the threshold lie in the cell too. A cell goes through its boxes
from the strongest on: one that overlaps a box that stays is dropped, an own box stays if it overlaps none
before it that is left, and all others wait for the next round, whose grid lies elsewhere or is
wider. What an own box that stays overlaps is dropped with it, so only boxes that wait go on.
No box is copied, rows cross the shuffle once for each round that they wait, and a chain of boxes
costs a round only where it leaves a cell.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.boxes import SIDES, area
from lodestone.operators.detections import suppress
from lodestone.storage import written

#: Boxes of an image that are folded as one array.
FOLDED = 2000
#: The first grid is so many powers of two wider than the small boxes (this share of all is no larger) or what they reach.
WIDE, SMALL = 6, 0.05
#: Where cells begin, as parts of their width, round by round: a box that reaches less than a third of it is at a border in x in one of them at most, and so in y.
OFFSETS = (0.5, 0.5 + 1 / 3, 0.5 + 2 / 3)
#: A grid widens by so many powers of two after a turn of offsets, as long as no cell gets more boxes than that; as few as those go to cells without borders.
LEVELS, FULL = 2, 20_000
#: Boxes that a task sorts, at most about, whatever the session's partitions are.
DEALT = 500_000
CELL = ("image", "bx", "by")
#: Boxes of a cell that are compared at a time, and with how many held ones at a time.
CHUNK, PIECE = 256, 4096


class Held:
    """Boxes that later ones are compared with."""

    def __init__(self) -> None:
        self.boxes, self.n = np.empty((64, 4)), 0

    def add(self, boxes: np.ndarray) -> None:
        end = self.n + len(boxes)
        if end > len(self.boxes):
            more = max(end, 2 * len(self.boxes)) - self.n
            self.boxes = np.concatenate([self.boxes[: self.n], np.empty((more, 4))])
        self.boxes[self.n : end] = boxes
        self.n = end

    def met(self, boxes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Which boxes overlap a held one, and which equal one."""
        hit, equal = np.zeros(len(boxes), bool), np.zeros(len(boxes), bool)
        for at in range(0, self.n, PIECE):
            i, _, same = overlaps(boxes, self.boxes[at : min(self.n, at + PIECE)], threshold)
            hit[i] = True
            equal[i[same]] = True
        return hit, equal


def overlaps(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of boxes of a and b that overlap by the threshold, and which of them are equal."""
    beside = (a[:, None, 0] < b[None, :, 2]) & (b[None, :, 0] < a[:, None, 2]) & (a[:, None, 1] < b[None, :, 3]) & (b[None, :, 1] < a[:, None, 3])
    i, j = np.nonzero(beside)
    p, q = a[i], b[j]
    inter = (np.minimum(p[:, 2], q[:, 2]) - np.maximum(p[:, 0], q[:, 0])) * (np.minimum(p[:, 3], q[:, 3]) - np.maximum(p[:, 1], q[:, 1]))
    union = (p[:, 2] - p[:, 0]) * (p[:, 3] - p[:, 1]) + (q[:, 2] - q[:, 0]) * (q[:, 3] - q[:, 1]) - inter
    enough = inter / union >= threshold
    return i[enough], j[enough], (inter == union)[enough]


class Cell:
    """A cell's boxes, from the strongest on: those that stay and those that wait."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.stay, self.wait = threshold, Held(), Held()

    def take(self, boxes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which boxes stay and which wait."""
        dead, _ = self.stay.met(boxes, self.threshold)
        behind, equal = self.wait.met(boxes, self.threshold)
        # whatever becomes of a box, no equal one after it stays
        dead |= equal
        stays = own & ~dead & ~behind
        waits = ~stays & ~dead
        later, earlier, same = overlaps(boxes, boxes, self.threshold)
        before = earlier < later
        later, earlier, same = later[before], earlier[before], same[before]
        # pairs are in order, so all earlier boxes of one are settled when its turn comes
        heads, first = np.unique(later, return_index=True)
        for n, start, end in zip(heads, first, np.append(first, len(later))[1:], strict=True):
            some = earlier[start:end]
            if dead[n]:
                continue
            if stays[some].any() or waits[some[same[start:end]]].any():
                dead[n], stays[n], waits[n] = True, False, False
            elif waits[some].any():
                stays[n], waits[n] = False, True
        self.stay.add(boxes[stays])
        self.wait.add(boxes[waits])
        return stays, waits


def _cell(low: Column, high: Column, level: float, turn: int, beyond: Column | float = 0.0) -> Column:
    """The cell, along one side, of the middle between low and high, or of a place beyond it. Cells are 2 ** level wide, those of an infinite level have no borders."""
    return F.floor(((low + high) / F.lit(2.0) + beyond) / F.lit(2.0**level) + F.lit(OFFSETS[turn % len(OFFSETS)])) if level < math.inf else F.lit(0).cast("long")


def dealt(work: DataFrame, threshold: float, turn: int, level: float = 12) -> DataFrame:
    """work with level, bx and by, which name each box's cell, and own: whether all boxes that it may overlap by the threshold lie there."""
    cells, own = {}, F.lit(True)
    for name, low, high in (("bx", F.col("x1"), F.col("x2")), ("by", F.col("y1"), F.col("y2"))):
        # the middles of boxes that overlap by the threshold are no farther apart
        reach = (high - low) * F.lit((1 - threshold) / (2 * threshold)) + F.lit(1.0)
        cells[name] = _cell(low, high, level, turn)
        own &= (_cell(low, high, level, turn, -reach) == cells[name]) & (_cell(low, high, level, turn, reach) == cells[name])
    return work.withColumns({"level": F.lit(float(level)), **cells, "own": own})


def settle(threshold: float):
    """The stage of a round: cells one after another, boxes from the strongest on. Records that stay or wait go on at once."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = {c: batch.column(c) for c in batch.schema.names}
            boxes = np.column_stack([column[s].to_numpy(zero_copy_only=False) for s in SIDES])
            own = column["own"].to_numpy(zero_copy_only=False)
            new = np.zeros(n, bool)
            for c in CELL:
                new[1:] |= pc.not_equal(column[c].slice(1), column[c].slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(new).tolist(), n]
            stays, waits = np.zeros(n, bool), np.zeros(n, bool)
            for start, end in zip(starts[:-1], starts[1:], strict=True):
                here = tuple(column[c][start].as_py() for c in CELL)
                if here != at:
                    at, cell = here, Cell(threshold)
                for first in range(start, end, CHUNK):
                    some = slice(first, min(end, first + CHUNK))
                    stays[some], waits[some] = cell.take(boxes[some], own[some])
            left = stays | waits
            yield pa.RecordBatch.from_arrays([column["r"].filter(pa.array(left)), pa.array(stays[left])], names=["r", "kept"])

    return step


def suppress_in_rounds(boxes: DataFrame, threshold: float, *keys: str, tie: tuple[str, ...] = (), full: int = FULL) -> DataFrame:
    """detections.suppress for boxes of whole numbers, however many an image has.

    Boxes without an area overlap nothing and stay. A threshold above one keeps all; it must be above zero.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above zero")
    if threshold > 1:
        return boxes
    spark, rest = boxes.sparkSession, [c for c in boxes.columns if c not in keys]
    solid = F.coalesce((F.col("bbox.x2") > F.col("bbox.x1")) & (F.col("bbox.y2") > F.col("bbox.y1")), F.lit(False))
    image = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    box = {s: F.col("bbox").getField(s).cast("double") for s in SIDES}
    side = F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"])
    ranks = {"_s": -F.col("det_score"), "_a": -area(F.col("bbox"))}
    order = [*ranks, *[F.col("r").getField(c) for c in (*tie, *rest)]]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cells(level: float, turn: int) -> list[Column]:
        return [image, _cell(box["x1"], box["x2"], level, turn), _cell(box["y1"], box["y2"], level, turn)]

    work, turn, rounds = boxes.where(solid), 0, []
    # as powers of two, so few rows
    sizes = sorted(work.groupBy(F.ceil(F.log2(side)).alias("size")).count().collect())
    left = before = sum(n for _, n in sizes)
    smaller = itertools.accumulate(n for _, n in sizes)
    level = next((size for (size, _), n in zip(sizes, smaller, strict=True) if n >= SMALL * left), 0) + WIDE + math.ceil(math.log2(max(1.0, (1 - threshold) / (2 * threshold))))
    while left:
        if turn and left <= full:
            level = math.inf
        elif turn and turn % len(OFFSETS) == 0:
            # the strongest box of all is settled in one of a turn's grids unless they are too narrow for it
            fullest = work.groupBy(*cells(level + LEVELS, turn)).count().agg(F.max("count")).first()[0]
            level, before = level + LEVELS if left == before or fullest <= full else level, left
        # only rows as they came cross the shuffle
        h = F.xxhash64(*cells(level, turn))
        spread = work.repartition(-(-left // DEALT), h) if left > DEALT * partitions else work.repartition(h)
        named = spread.select(h.alias("h"), image.alias("image"), *[b.alias(s) for s, b in box.items()], *[r.alias(c) for c, r in ranks.items()], F.struct(*boxes.columns).alias("r"))
        ranked = dealt(named, threshold, turn, level).sortWithinPartitions("h", *CELL, *order).select(*CELL, *SIDES, "own", "r")
        schema = StructType().add("r", ranked.schema["r"].dataType).add("kept", "boolean")
        rounds.append(written(ranked.mapInArrow(settle(threshold), schema), "suppressed-boxes", codec="zstd"))
        work, turn = rounds[-1].where("NOT kept").select("r.*"), turn + 1
        left = work.count()
    stay = boxes.where(~solid)
    for r in rounds:
        stay = stay.unionByName(r.where("kept").select("r.*"))
    return stay


def suppress_any(boxes: DataFrame, threshold: float, *keys: str, tie: tuple[str, ...] = (), folded: int = FOLDED) -> DataFrame:
    """detections.suppress: images of up to so many boxes are folded as arrays, larger ones go through rounds. The rows are the same."""
    named = written(boxes.withColumn("_image", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), "boxes")
    crowded = written(named.groupBy("_image").count().where(F.col("count") > folded).select("_image"), "crowded", narrow=True)
    if crowded.isEmpty():
        return suppress(named.drop("_image"), threshold, *keys, tie=tie)
    few = named.join(crowded, "_image", "left_anti").drop("_image")
    many = named.join(crowded, "_image", "left_semi").drop("_image")
    return suppress(few, threshold, *keys, tie=tie).unionByName(suppress_in_rounds(many, threshold, *keys, tie=tie))
