"""Box candidates: guards, tiles, greedy suppression and caps.

detections: item_id, image_w, image_h, raw_bbox struct<x1,y1,x2,y2: double>, kps
array<array<float>>, det_score, source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.boxes import area, clipped, finite, iou, tile_starts
from lodestone.storage import written

RESCUE = "rescue-"


def landmarks_ok(kps: Column) -> Column:
    return F.coalesce((F.size(kps) == 5) & F.forall(kps, lambda p: (F.size(p) == 2) & finite(p[0]) & finite(p[1])), F.lit(False))


def source_label(source: Column, score: Column, s: Settings) -> Column:
    return F.when(score >= s.detector_threshold, source).otherwise(F.concat(F.lit(RESCUE), source))


def inside_tile(local: Column, x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Whether a box, in its tile's coordinates, keeps off those edges of the tile that are no edges of the frame."""
    side = F.least(F.greatest(local["x2"] - local["x1"], F.lit(1.0)), F.greatest(local["y2"] - local["y1"], F.lit(1.0)))
    margin = F.greatest(F.lit(6.0), F.least(F.lit(28.0), side * 0.10))
    cut = (
        ((x > 0) & (local["x1"] <= margin))
        | ((y > 0) & (local["y1"] <= margin))
        | ((x + w < image_w) & (local["x2"] >= w - margin))
        | ((y + h < image_h) & (local["y2"] >= h - margin))
    )
    return ~cut


def shifted(local: Column, x: Column, y: Column) -> Column:
    return F.struct((local["x1"] + x).alias("x1"), (local["y1"] + y).alias("y1"), (local["x2"] + x).alias("x2"), (local["y2"] + y).alias("y2"))


def candidates(detections: DataFrame, s: Settings) -> DataFrame:
    """Detections that are strong enough and finite, with bbox within the frame and the source's final label."""
    score = F.col("det_score")
    return (
        detections.where((score >= s.lowest_score) & ~F.isnan(score) & landmarks_ok(F.col("kps")))
        .withColumn("bbox", clipped(F.col("raw_bbox"), F.col("image_w"), F.col("image_h")))
        .where("bbox IS NOT NULL")
        .withColumn("source", source_label(F.col("source"), score, s))
    )


def tile_grid(images: DataFrame, s: Settings) -> DataFrame:
    """images: item_id, image_w, image_h. A row for each tile to look at: x, y, w, h."""
    size, overlap = max(800, int(s.tile_size)), min(0.45, max(0.0, s.tile_overlap))
    w, h = F.col("image_w"), F.col("image_h")
    wanted = images.where(F.lit(s.tiles) & (F.greatest(w, h) > s.tile_trigger) & ((w > s.tile_size) | (h > s.tile_size)))
    at = wanted.withColumn("y", F.explode(tile_starts(h, size, overlap))).withColumn("x", F.explode(tile_starts(w, size, overlap)))
    tiles = at.withColumns({"w": F.least(w, F.col("x") + size) - F.col("x"), "h": F.least(h, F.col("y") + size) - F.col("y")})
    return tiles.where(~((F.col("x") == 0) & (F.col("y") == 0) & (F.col("w") == w) & (F.col("h") == h)) & (F.col("w") > 0) & (F.col("h") > 0)).select("item_id", "x", "y", "w", "h")


def suppress(boxes: DataFrame, threshold: float, *keys: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """Greedy suppression within keys: by score, area and the tie columns, a box stays if it overlaps no kept one by the threshold or more.

    A group is one image; its boxes are an array, and the fold over it stays in the JVM.
    """
    rest = [c for c in boxes.columns if c not in keys]
    record = F.struct((-F.col("det_score")).alias("_s"), (-area(F.col("bbox"))).alias("_a"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)], *rest)
    grouped = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(record)).alias("all"))
    nothing = F.slice("all", 1, 0)
    kept = F.aggregate("all", nothing, lambda acc, r: F.when(F.exists(acc, lambda k: iou(k["bbox"], r["bbox"]) >= threshold), acc).otherwise(F.concat(acc, F.array(r))))
    return grouped.select(*keys, F.explode(kept).alias("r")).select(*keys, *[F.col("r").getField(c).alias(c) for c in rest])


def cap_weak(boxes: DataFrame, s: Settings, *keys: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """All strong boxes, and of the weak ones of each image the best rescue_max_candidates."""
    # a null score is neither
    strong = F.col("det_score") >= s.detector_threshold
    order = [F.desc("det_score"), F.desc(area(F.col("bbox"))), *tie]
    # one pass, so what boxes come from is not computed for each kind; strong ones need no number and are no group
    alone = F.when(strong, F.xxhash64("bbox"))
    numbered = boxes.where(strong.isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, strong, alone).orderBy(*order)))
    return numbered.where(strong | (F.col("_n") <= max(0, s.rescue_max_candidates))).drop("_n")


def from_tiles(local: DataFrame) -> DataFrame:
    """local: detections in the coordinates of a tile (x, y, w, h). Those that its inner edges do not cut, in the frame's coordinates."""
    raw, x, y = F.col("raw_bbox"), F.col("x"), F.col("y")
    whole = local.where(inside_tile(raw, x, y, F.col("w"), F.col("h"), F.col("image_w"), F.col("image_h")))
    return whole.withColumns({"raw_bbox": shifted(raw, x, y), "kps": F.transform("kps", lambda p: F.array(p[0] + x, p[1] + y))}).drop("x", "y", "w", "h")


def detect(full: DataFrame, tiled: DataFrame, s: Settings, tie: tuple[str, ...] = (), suppressing: Callable[..., DataFrame] = suppress) -> DataFrame:
    """Candidates of whole images and of tiles, suppressed together and capped, by (y1, x1). suppressing: crowded.suppress_any where an image may have very many boxes."""
    together = full.unionByName(tiled)
    # a sort reads its input twice
    kept = written(cap_weak(suppressing(together, s.nms_iou, "item_id", tie=tie), s, "item_id", tie=tie), "detected")
    return kept.sort("item_id", "bbox.y1", "bbox.x1")


def references_with_one_box(boxes: DataFrame, s: Settings, tie: tuple[str, ...] = ()) -> DataFrame:
    """item_id, boxes and ok: of a reference exactly one box must be strong enough after suppression. Which of equally strong and large boxes stays may decide how many do, so ties are those of suppress."""
    strong = suppress(boxes.where(F.col("det_score") >= s.reference_min_score), s.nms_iou, "item_id", tie=tie)
    counts = strong.groupBy("item_id").agg(F.count("*").alias("boxes"))
    every = boxes.select("item_id").distinct()
    n = F.coalesce("boxes", F.lit(0))
    return every.join(counts, "item_id", "left").select("item_id", n.alias("boxes"), (n == 1).alias("ok"))
