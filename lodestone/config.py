"""Thresholds and switches: defaults, presets, validation and their file."""

from __future__ import annotations

import json
import os
import tempfile
from contextlib import suppress
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Query parameters. They become literals, so what is switched off is folded away."""

    match_threshold: float = 0.45
    ambiguity_margin: float = 0.04
    review_band: float = 0.08
    recovery_band: float = 0.10
    recovery_gain: float = 0.015
    anchors_per_entity: int = 8
    anchor_cap: float = 0.34
    anchor_floor: float = 0.18
    anchor_step: float = 0.06
    anchor_min_score: float = 0.40
    detector_threshold: float = 0.18
    rescue_threshold: float = 0.10
    rescue_max_candidates: int = 80
    nms_iou: float = 0.35

    reject_small: bool = True
    reject_clipping: bool = True
    reject_blur: bool = True
    reject_exposure: bool = False
    reject_pose: bool = True
    reject_eyes: bool = True
    min_side: int = 45
    blur_threshold: float = 45.0
    max_clipped: float = 0.55
    max_yaw: float = 45.0
    max_pitch: float = 35.0
    max_roll: float = 35.0
    eye_ratio_min: float = 0.105
    top_margin: float = 0.18
    side_margin: float = 0.07
    bottom_margin: float = 0.03
    guard_base: float = 0.020
    guard_min: float = 0.008
    guard_max: float = 0.050
    guard_area: float = 0.015
    guard_exponent: float = 0.50

    tiles: bool = True
    tile_size: int = 2200
    tile_overlap: float = 0.18
    tile_trigger: int = 1800

    series_gap_seconds: float = 12.0
    series_gap_numbers: int = 5
    foreign_frames: int = 2
    reference_min_score: float = 0.45
    reference_warn: float = 0.55

    @property
    def anchor_limit(self) -> float:
        return min(self.anchor_cap, max(self.anchor_floor, self.match_threshold - self.anchor_step))

    @property
    def lowest_score(self) -> float:
        return min(self.detector_threshold, self.rescue_threshold)


#: What quality presets and search modes set.
QUALITY = {
    "soft": {
        "min_side": 35, "max_yaw": 55.0, "max_pitch": 45.0, "max_roll": 45.0, "eye_ratio_min": 0.080, "blur_threshold": 25.0, "max_clipped": 0.70,
        "top_margin": 0.12, "side_margin": 0.05, "bottom_margin": 0.02, "guard_base": 0.012, "guard_min": 0.006, "guard_max": 0.035,
    },
    "normal": {
        "min_side": 45, "max_yaw": 45.0, "max_pitch": 35.0, "max_roll": 35.0, "eye_ratio_min": 0.105, "blur_threshold": 45.0, "max_clipped": 0.55,
        "top_margin": 0.18, "side_margin": 0.07, "bottom_margin": 0.03, "guard_base": 0.020, "guard_min": 0.008, "guard_max": 0.050,
    },
    "strict": {
        "min_side": 65, "max_yaw": 30.0, "max_pitch": 25.0, "max_roll": 25.0, "eye_ratio_min": 0.125, "blur_threshold": 75.0, "max_clipped": 0.35,
        "top_margin": 0.24, "side_margin": 0.10, "bottom_margin": 0.05, "guard_base": 0.030, "guard_min": 0.012, "guard_max": 0.065,
    },
}
SEARCH = {
    "fast": {"tiles": False, "tile_size": 1400, "tile_overlap": 0.18, "tile_trigger": 1600, "rescue_threshold": 0.12, "rescue_max_candidates": 40},
    "enhanced": {"tiles": True, "tile_size": 1400, "tile_overlap": 0.20, "tile_trigger": 1600, "rescue_threshold": 0.10, "rescue_max_candidates": 80},
    "maximum": {"tiles": True, "tile_size": 1000, "tile_overlap": 0.24, "tile_trigger": 1200, "rescue_threshold": 0.08, "rescue_max_candidates": 120},
}
#: Ranges of what a user may enter.
RANGES = {"match_threshold": (0.05, 1.0), "ambiguity_margin": (0.0, 0.5), "detector_threshold": (0.05, 0.8)}


def number(name: str, value: object) -> float:
    """A number within the range of its setting; a comma may separate decimals."""
    low, high = RANGES[name]
    try:
        x = float(str(value).replace(",", "."))
    except ValueError:
        raise ValueError(f"{name}: not a number") from None
    if not low <= x <= high:
        raise ValueError(f"{name}: must be from {low} to {high}")
    return x


def settings_for(quality: str = "normal", search: str = "enhanced", **entered: object) -> Settings:
    """Settings of presets, with entered numbers checked and switches taken over."""
    base = replace(Settings(), **QUALITY[quality], **SEARCH[search])
    chosen = replace(base, **{k: number(k, v) if k in RANGES else v for k, v in entered.items()})
    return replace(chosen, rescue_threshold=min(chosen.detector_threshold, chosen.rescue_threshold))


VERSION = 1


def load_values(path: str | Path) -> dict[str, Any]:
    """The values saved; none where the file does not hold this version's record of them."""
    with suppress(OSError, ValueError):
        match json.loads(Path(path).read_bytes()):
            case {"version": version, "values": dict(values)} if version == VERSION:
                return values
    return {}


def save_values(values: dict[str, Any], path: str | Path) -> None:
    """The file is replaced as a whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=path.parent, suffix=".part", delete=False) as f:
        try:
            json.dump({"version": VERSION, "values": values}, f, ensure_ascii=False, indent=2)
            f.flush()
            os.fsync(f.fileno())
            os.replace(f.name, path)
        except BaseException:
            os.unlink(f.name)
            raise
