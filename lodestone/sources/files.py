"""File listings and capture times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import base_name, camera_time, folder, sequence_number, sequence_prefix, stem, suffix

#: Suffixes of files that are certainly no images.
SKIPPED = (
    ".csv", ".txt", ".json", ".xml", ".yaml", ".yml", ".ini", ".log", ".md",
    ".py", ".pyw", ".bat", ".cmd", ".ps1", ".exe", ".dll", ".zip", ".7z",
    ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".xmp",
)


def image_like(path: Column) -> Column:
    """Neither hidden nor of a suffix that is certainly no image; unknown suffixes stay."""
    return ~base_name(path).startswith(".") & ~suffix(path).isin(*SKIPPED)


def candidates(listing: DataFrame, *, recursive: bool = True) -> DataFrame:
    """listing: path, relative to its root. What may be an image, in order of the paths without regard to case."""
    rows = listing.where(image_like(F.col("path")))
    if not recursive:
        rows = rows.where(F.instr("path", "/") == 0)
    return rows.sort(F.lower("path"), "path")


def files_at(spark: SparkSession, root: str, *, recursive: bool = True) -> DataFrame:
    """path (relative to root), uri, length, modified. Contents are not read. Spark's listing hides names that begin with _ or a dot, and empty files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file:"))
    plain = F.regexp_replace("path", "^file:(//)?", "")
    return found.select(F.substring(plain, F.length(base) + 2, F.length(plain)).alias("path"), F.col("path").alias("uri"), "length", F.col("modificationTime").alias("modified"))


def list_files(spark: SparkSession, root: str, *, recursive: bool = True) -> DataFrame:
    """path, length, modified of the files below root."""
    return files_at(spark, root, recursive=recursive).drop("uri")


def item_order(items: DataFrame) -> DataFrame:
    """items: path, exif_original, exif_digitized, exif_datetime, mtime. What series are ordered by.

    The first capture time that can be read counts as metadata; else the file's time does without.
    """
    noted = F.coalesce(*[camera_time(F.col(c)) for c in ("exif_original", "exif_digitized", "exif_datetime")])
    name = stem(F.col("path"))
    return items.select(
        "path",
        folder(F.col("path")).alias("dir"),
        base_name(F.col("path")).alias("name"),
        F.coalesce(noted, F.col("mtime").cast("timestamp")).alias("capture_time"),
        noted.isNotNull().alias("time_is_metadata"),
        sequence_number(name).alias("seq"),
        sequence_prefix(name).alias("prefix"),
    )
