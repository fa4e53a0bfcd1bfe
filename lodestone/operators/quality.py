"""Quality rules: an ordered array of reason codes for each row.

Numbers behind a reason stay in their columns; `reasons` makes texts of both. A metric that
is null or not finite gives no reason.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.boxes import finite


def stage(rows: DataFrame) -> DataFrame:
    """rows; counting them ends a compiled stage. Many rules in one make a method of over 8000 bytes, which the JVM never compiles."""
    return rows.observe(f"judged-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def _over(metric: Column, limit: float) -> Column:
    return finite(metric) & (F.abs(metric) > limit)


def _codes(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in their order, in one text: unlike a filter over an array, that is compiled."""
    return F.concat_ws(";", *[F.when(rule, F.lit(code)) for rule, code in rules])


def _listed(codes: Column) -> Column:
    return F.array_remove(F.split(codes, ";"), "")


def face_share(fw: Column, fh: Column, width: Column, height: Column) -> Column:
    """The share of the frame that a box takes."""
    return F.greatest(F.lit(1e-8), F.least(F.lit(1.0), fw * fh / F.greatest(F.lit(1.0), width.cast("double") * height.cast("double"))))


def guard_ratio(fw: Column, fh: Column, width: Column, height: Column, s: Settings) -> Column:
    """The share of the frame that must stay free around a box of that size."""
    scaled = s.guard_base * F.pow(F.lit(max(1e-8, s.guard_area)) / face_share(fw, fh, width, height), F.lit(s.guard_exponent))
    return F.greatest(F.lit(s.guard_min), F.least(F.lit(s.guard_max), scaled))


def _with_edges(boxes: DataFrame, s: Settings) -> DataFrame:
    """boxes with _guard and _edges, the codes of a box at the frame's edge. What several rules need is a column, so it is computed once."""
    raw, width, height, zero = F.col("raw_bbox"), F.col("image_w"), F.col("image_h"), F.lit(0.0)
    sized = boxes.withColumns({"_fw": F.greatest(raw["x2"] - raw["x1"], F.lit(1.0)), "_fh": F.greatest(raw["y2"] - raw["y1"], F.lit(1.0))})
    fw, fh, guard = F.col("_fw"), F.col("_fh"), F.col("_guard")
    slack_x, slack_y = F.greatest(F.lit(2.0), fw * 0.015), F.greatest(F.lit(2.0), fh * 0.015)
    near = F.least(F.greatest(zero, raw["x1"]), F.greatest(zero, width - raw["x2"]))
    direct = _codes(
        (raw["y1"] < -slack_y, "cut_top"),
        ((raw["x1"] < -slack_x) | (raw["x2"] > width + slack_x), "cut_side"),
        (raw["y2"] > height + slack_y, "cut_bottom"),
        (F.greatest(zero, raw["y1"]) < fh * s.top_margin, "tight_top"),
        (near < fw * s.side_margin, "tight_side"),
        (F.greatest(zero, height - raw["y2"]) < fh * s.bottom_margin, "tight_bottom"),
    )
    left, right = raw["x1"] - fw * s.side_margin, raw["x2"] + fw * s.side_margin
    guarded = _codes(
        (F.least(left, width - right) < width * guard, "guard_side"),
        (raw["y1"] - fh * s.top_margin < height * guard, "guard_top"),
        (height - (raw["y2"] + fh * s.bottom_margin) < height * guard, "guard_bottom"),
    )
    ruled = stage(stage(sized.withColumn("_guard", guard_ratio(fw, fh, width, height, s))).withColumn("_direct", direct))
    return ruled.withColumn("_edges", F.when(F.col("_direct") != "", F.col("_direct")).otherwise(guarded)).drop("_fw", "_fh", "_direct")


def with_clipping(boxes: DataFrame, s: Settings) -> DataFrame:
    """boxes (raw_bbox, image_w, image_h) with edge_reasons - beyond the frame's edge, too close to it or, if neither, within the guard that grows as boxes shrink - and guard."""
    return _with_edges(boxes, s).withColumns({"edge_reasons": _listed(F.col("_edges")), "guard": F.col("_guard")}).drop("_edges", "_guard")


def exposure_bad(clipped: Column, mean: Column, s: Settings) -> Column:
    return (finite(clipped) & (clipped > s.max_clipped)) | (finite(mean) & ((mean < 22.0) | (mean > 238.0)))


def with_quality(observations: DataFrame, s: Settings, *, apply_clipping: bool = True) -> DataFrame:
    """observations (bbox, raw_bbox, image_w, image_h, blur_score, clipped, gray_mean, pose, eye_left, eye_right) with quality_reasons."""
    c = F.col
    edges = s.reject_clipping and apply_clipping
    pose_known = finite(c("pose.pitch")) & finite(c("pose.yaw")) & finite(c("pose.roll"))
    eyes_known = finite(c("eye_left")) & finite(c("eye_right"))
    rules = [
        (s.reject_blur, finite(c("blur_score")) & (c("blur_score") < s.blur_threshold), "blur"),
        (s.reject_exposure, exposure_bad(c("clipped"), c("gray_mean"), s), "exposure"),
        (s.reject_pose, pose_known & _over(c("pose.yaw"), s.max_yaw), "yaw"),
        (s.reject_pose, pose_known & _over(c("pose.pitch"), s.max_pitch), "pitch"),
        (s.reject_pose, pose_known & _over(c("pose.roll"), s.max_roll), "roll"),
        (s.reject_eyes, eyes_known & (F.least(c("eye_left"), c("eye_right")) < s.eye_ratio_min), "eyes"),
    ]
    small = [(F.least(c("bbox.x2") - c("bbox.x1"), c("bbox.y2") - c("bbox.y1")) < s.min_side, "small")] if s.reject_small else []
    first = stage(stage(observations).withColumn("_rest", _codes(*[(rule, code) for on, rule, code in rules if on])))
    rows = _with_edges(first, s) if edges else first
    joined = stage(rows.withColumn("_rest", F.concat_ws(";", _codes(*small), *([c("_edges")] if edges else []), c("_rest"))).drop("_edges", "_guard"))
    return joined.withColumn("quality_reasons", _listed(c("_rest"))).drop("_rest")
