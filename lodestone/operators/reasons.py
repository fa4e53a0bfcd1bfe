"""Texts for people of the reason codes, with the numbers behind them.

Defined results: a number that is null or not finite is shown as ?; a code without a text is
shown as it is; no codes give an empty text. Numbers are rounded to nine digits, then halves to
even, so that noise of the last bits does not show.
"""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.boxes import finite
from lodestone.operators.quality import face_share, guard_ratio, stage

_MARGIN = "({share}% of the frame, about {guard}% must stay free)"
#: Texts by code. Names in braces are those of numbers().
TEXTS = {
    "small": "too small ({side} px)",
    "cut_top": "cut by the top edge",
    "cut_side": "cut by a side edge",
    "cut_bottom": "cut by the bottom edge",
    "tight_top": "too little room above",
    "tight_side": "too little room beside",
    "tight_bottom": "too little room below",
    "guard_side": f"too close to a side edge {_MARGIN}",
    "guard_top": f"too close to the top edge {_MARGIN}",
    "guard_bottom": f"too close to the bottom edge {_MARGIN}",
    "blur": "blurred ({blur})",
    "exposure": "badly exposed (clipped {clipped}%, mean {mean})",
    "yaw": "turned too far, yaw {yaw}°",
    "pitch": "tilted too far, pitch {pitch}°",
    "roll": "tilted too far, roll {roll}°",
    "eyes": "eye closed ({left}/{right})",
}


#: Codes whose texts one compiled stage fills.
STAGED = 2


def shown(number: Column, places: int) -> Column:
    text = F.bround(F.round(number.cast("double"), 9), places).cast(f"decimal(38,{places})").cast("string")
    return F.when(finite(number.cast("double")), text).otherwise("?")


def numbers(s: Settings) -> dict[str, Column]:
    """What texts may name, from the columns that with_quality takes."""
    c = F.col
    fw, fh = (F.greatest(c(f"raw_bbox.{a}2") - c(f"raw_bbox.{a}1"), F.lit(1.0)) for a in "xy")
    size = fw, fh, c("image_w"), c("image_h")
    return {
        "side": shown(F.least(c("bbox.x2") - c("bbox.x1"), c("bbox.y2") - c("bbox.y1")), 0),
        "share": shown(face_share(*size) * 100, 2),
        "guard": shown(guard_ratio(*size, s) * 100, 1),
        "blur": shown(c("blur_score"), 1),
        "clipped": shown(c("clipped") * 100, 0),
        "mean": shown(c("gray_mean"), 0),
        "yaw": shown(c("pose.yaw"), 0),
        "pitch": shown(c("pose.pitch"), 0),
        "roll": shown(c("pose.roll"), 0),
        "left": shown(c("eye_left"), 3),
        "right": shown(c("eye_right"), 3),
    }


def _filled(template: str, values: Mapping[str, Column]) -> Column:
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if name is not None and name not in values:
            raise ValueError(f"no number is named {name!r}")
        parts += [F.lit(literal)] + ([values[name]] if name is not None else [])
    return F.concat(*parts)


def reason_text(s: Settings, texts: Mapping[str, str] = TEXTS, separator: str = "; ") -> Column:
    """One text of a row's quality_reasons, in their order, from the columns beside them."""
    values = numbers(s)

    def of(code: Column) -> Column:
        shown_as = F.when(F.lit(False), code)
        for name, template in texts.items():
            shown_as = shown_as.when(code == name, _filled(template, values))
        return shown_as.otherwise(code)

    return F.array_join(F.transform("quality_reasons", of), separator)


def with_reason_text(rows: DataFrame, s: Settings, column: str = "reason", texts: Mapping[str, str] = TEXTS, separator: str = "; ") -> DataFrame:
    """rows with reason_text as a column, for many rows: codes are replaced in one text, a few in each compiled stage, where a transform of the array is interpreted.

    A code stands between two marks and its text between two others, so no part of a text is taken for a code.
    """
    values, used = numbers(s), "".join([*texts, *texts.values(), separator])
    values |= {"share": shown(F.col("_share") * 100, 2), "guard": shown(F.col("_guard") * 100, 1)}
    mark, filled = [c for c in map(chr, range(1, 32 + len(used))) if c not in used][:2]
    codes, m, f = F.col("quality_reasons"), F.lit(mark), F.lit(filled)
    # codes of the user's own that hold a mark are rare, but possible
    whole = F.array_join(codes, "")
    fw, fh = (F.greatest(F.col(f"raw_bbox.{a}2") - F.col(f"raw_bbox.{a}1"), F.lit(1.0)) for a in "xy")
    size = fw, fh, F.col("image_w"), F.col("image_h")
    rows = stage(rows.withColumns({"_share": face_share(*size), "_guard": guard_ratio(*size, s)}))
    rows = stage(rows.withColumns({"_odd": whole.contains(mark) | whole.contains(filled), "_text": F.concat(m, F.array_join(codes, mark + mark), m)}))
    names = list(texts)
    for at in range(0, len(names), STAGED):
        text = F.col("_text")
        for name in names[at : at + STAGED]:
            shown_as = F.when(F.col("_text").contains(mark + name + mark), F.concat(f, _filled(texts[name], values), f)).otherwise("")
            text = F.replace(text, F.lit(mark + name + mark), shown_as)
        rows = stage(rows.withColumn("_text", text))
    inner = F.substring(F.col("_text"), F.lit(2), F.length("_text") - 2)
    listed = F.replace(F.translate(inner, filled, mark), F.lit(mark + mark), F.lit(separator))
    return rows.withColumn(column, F.when(F.col("_odd"), reason_text(s, texts, separator)).otherwise(listed)).drop("_odd", "_text", "_share", "_guard")
