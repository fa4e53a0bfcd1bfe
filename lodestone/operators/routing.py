"""Routing of matched observations: accepted, rejected and for review.

matched: obs_id, path, source, quality_reasons, and what match_two_pass gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.text import stem

ANCHORED = "session-anchor"


def without_errors(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items to go on with, and those with an error."""
    return items.where("error IS NULL"), items.where("error IS NOT NULL")


def _closest(rows: DataFrame, *columns: str) -> DataFrame:
    """For each entity and path the closest row; equal distances go by observation. Combined on the map side."""
    least = F.min(F.struct("best_dist", "obs_id", *columns)).alias("r")
    return rows.groupBy(F.col("accepted_id").alias("entity_id"), "path").agg(least).select("entity_id", "path", F.col("r.best_dist").alias("distance"), *[F.col(f"r.{c}").alias(c) for c in ("obs_id", *columns)])


def final_source(matched: DataFrame) -> DataFrame:
    return matched.withColumn("source", F.when(F.col("recovered"), ANCHORED).otherwise(F.col("source")))


def accepted(matched: DataFrame) -> DataFrame:
    """entity_id, path, distance, obs_id, source, photo_id: one row for each entity and path."""
    rows = final_source(matched).where(F.col("accepted_id").isNotNull() & (F.size("quality_reasons") == 0))
    return _closest(rows, "source").withColumn("photo_id", stem(F.col("path")))


def rejected(matched: DataFrame, reason: Column | None = None) -> DataFrame:
    """As accepted, with reasons (codes, unless a column for them is given); an entity accepted on a path is not rejected there."""
    rows = final_source(matched).where(F.col("accepted_id").isNotNull() & (F.size("quality_reasons") > 0))
    closest = _closest(rows.withColumn("reason", F.array_join("quality_reasons", "; ") if reason is None else reason), "reason", "source")
    return closest.join(accepted(matched).select("entity_id", "path"), ["entity_id", "path"], "left_anti").withColumn("photo_id", stem(F.col("path")))


def review(matched: DataFrame, s: Settings) -> DataFrame:
    """Rows that are not accepted but within the review band, by path, candidate, distance and observation."""
    rows = matched.where(F.col("accepted_id").isNull() & (F.col("best_dist") <= s.match_threshold + s.review_band))
    return rows.select("obs_id", stem(F.col("path")).alias("photo_id"), "path", "best_id", F.col("best_dist").alias("distance"), "second_id", F.col("second_dist").alias("distance2"), "problem", "source")


def item_diagnostics(matched: DataFrame, s: Settings) -> DataFrame:
    """For each path: observations by kind and outcome."""
    count = lambda c, name: F.count_if(c).alias(name)
    hit = F.col("accepted_id").isNotNull()
    return matched.groupBy("path").agg(
        F.count("*").alias("observations"),
        count(F.col("source").endswith("full"), "full"),
        count(F.col("source").endswith("tile"), "tile"),
        count(F.col("source").startswith("rescue-"), "rescue"),
        count(hit & (F.size("quality_reasons") == 0), "accepted"),
        count(hit & (F.size("quality_reasons") > 0), "rejected"),
        count(~hit & (F.col("best_dist") <= s.match_threshold + s.review_band), "review"),
        count(F.col("recovered"), "recovered"),
    )


def run_summary(matched: DataFrame, s: Settings) -> DataFrame:
    """One row of counts of a run."""
    parts = [df.agg(F.count("*").alias(name)) for df, name in ((accepted(matched), "accepted"), (rejected(matched), "rejected"), (review(matched, s), "review"))]
    base = matched.agg(F.count_distinct("path").alias("items"), F.count("*").alias("observations"), F.count_if("recovered").alias("recovered"))
    for p in parts:
        base = base.join(F.broadcast(p))  # one row each
    return base
