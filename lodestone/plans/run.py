"""A whole run: from prepared inputs to accepted, rejected, review and best rows, and their files."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import identity, matching, quality, reasons, routing, series
from lodestone.sources import delimited
from lodestone.storage import written


@dataclass(frozen=True)
class Results:
    matched: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    review: DataFrame
    best: DataFrame | None
    errors: DataFrame


def gallery_of(references: DataFrame) -> DataFrame:
    """references: path, stem, boxes, embedding, quality_reasons, error. The gallery: entity_id by the names of all files, ref_id (the path) and embedding of the usable ones."""
    groups = identity.group_references(references.select("path", "stem"))
    named = references.join(groups, "path").withColumn("ref_id", F.col("path"))
    return matching.usable_references(named)


def analyse(observations: DataFrame, gallery: DataFrame, s: Settings, *, order: DataFrame | None = None, provider: Callable[[DataFrame], DataFrame] | None = None, texts: Mapping[str, str] | None = None) -> Results:
    """observations: obs_id, path, error and what quality and matching need.

    order: item_order of the paths; with it the best frame of each series is chosen.
    provider: a stage of the user's own that adds embeddings and metrics, such as operators.provider.batched over decoded items.
    texts: texts by reason code, such as reasons.TEXTS, for the reasons of rejected rows; codes by default.
    The provider sees each row once: what it gives is written before anything reads it. Rows that it gives an error are among the errors.
    """
    rows, errors = routing.without_errors(observations)
    if provider is not None:
        rows, failed = routing.without_errors(written(provider(rows), "provided"))
        errors = errors.unionByName(failed, allowMissingColumns=True)
    judged = quality.with_quality(rows, s)
    found = matching.match_two_pass(judged, gallery, s)
    matched = written(judged.drop("embedding").join(found, "obs_id"), "run")
    accepted = routing.accepted(matched)
    best = None
    if order is not None:
        metrics = matched.select("obs_id", "det_score", "blur_score", "eye_left", "eye_right", "pose")
        frames = accepted.join(order, "path").join(metrics, "obs_id")
        best = series.best_frames(frames, s)
    return Results(matched, accepted, routing.rejected(matched, None if texts is None else reasons.reason_text(s, texts)), routing.review(matched, s), best, errors)


def write(results: Results, folder: str | Path, name: str = "result") -> None:
    """The result files side by side, each replaced as a whole."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    delimited.write_single(results.accepted, folder / f"{name}.csv", delimited.ACCEPTED)
    delimited.write_single(results.rejected, folder / f"{name}_rejected.csv", delimited.REJECTED)
    delimited.write_single(results.review, folder / f"{name}_review.csv", delimited.REVIEW, ("path", "best_id", "distance", "obs_id"))
    if results.best is not None:
        delimited.write_single(results.best, folder / f"{name}_best.csv", delimited.BEST, ("entity_id", "series_index"))


def summary(results: Results, s: Settings) -> DataFrame:
    base = routing.run_summary(results.matched, s)
    errors = results.errors.agg(F.count("*").alias("errors"))
    return base.join(F.broadcast(errors))  # one row
