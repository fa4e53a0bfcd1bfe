"""Delimited files: manifests in, results out."""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.logical_rows import numbered_rows
from lodestone.sources.single_file import write_lines

#: Headers by which columns of a manifest are known, in order of preference.
ENTITY_HEADERS = ("Идентификатор цели", "Идентификатор человека", "Идентификатор ребенка", "Идентификатор ребёнка")
PHOTO_HEADERS = ("номер фото с этой целью", "номер фото с этим человеком", "номер фото с этим ребенком", "номер фото с этим ребёнком", "номер фото")
SOURCE_HEADERS = ("Исходный файл", "Относительный путь", "Source file")
#: Headers of the result files.
ACCEPTED = {"entity_id": "Идентификатор цели", "photo_id": "номер фото с этой целью", "path": "Исходный файл"}
REJECTED = {"entity_id": "Идентификатор цели", "photo_id": "номер фото", "path": "Исходный файл", "reason": "Причина", "distance": "Cosine distance", "source": "Источник"}
REVIEW = {"photo_id": "номер фото", "path": "Исходный файл", "best_id": "Лучший кандидат", "distance": "Distance", "second_id": "Второй кандидат", "distance2": "Distance 2", "problem": "Причина", "source": "Источник"}
BEST = {
    "entity_id": "Идентификатор цели",
    "photo_id": "номер фото с этой целью",
    "path": "Исходный файл",
    "series_index": "Серия",
    "series_size": "Кадров в серии",
    "score": "Best score",
    "distance": "Cosine distance",
    "blur_score": "Резкость лица",
    "eye": "Открытость глаз",
    "pose_part": "Pose score",
    "source": "Источник",
}
REPORT = {"row_number": "Строка CSV", "entity": "Цель", "source": "Исходный файл/номер", "status": "Статус", "detail": "Результат/причина"}
#: How a report names what became of a row.
STATUSES = {"copied": "скопировано", "skipped": "пропущено", "error": "ошибка", "cancelled": "отменено"}
DECIMALS = {"blur_score": 2}


def delimiter(sample: str) -> str:
    """The more frequent of both; of equals the semicolon."""
    return max(";,", key=sample.count)


def _plain(header: str) -> str:
    return " ".join(header.split()).casefold()


def find_column(header: Sequence[str], names: Sequence[str], fallback: int | None = None) -> int | None:
    """The place of the first name that the header has, without regard to case and white space; else the fallback, if there is such a column."""
    places = {_plain(h): i for i, h in reversed(list(enumerate(header)))}
    known = [places[n] for n in map(_plain, names) if n in places]
    spare = [] if fallback is None else range(len(header))[fallback : fallback + 1]
    return next(iter([*known, *spare]), None)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """(row_number, entity, photo_id, source, width; whether there is a source column).

    Only the head is read here, for the delimiter and the header; the file is read in chunks.
    Rows are numbered from 2 without blank ones, in file order, and are as wide as they are written.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    head = lines.where("_metadata.file_block_start = 0").limit(200).collect()
    if not head:
        raise ValueError("the manifest is empty")
    text = "\n".join(r["value"] for r in head).removeprefix("\ufeff")
    sep = delimiter(text[:4096])
    header = [c.strip() for c in next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])]
    entity, photo = find_column(header, ENTITY_HEADERS, 0), find_column(header, PHOTO_HEADERS, 1)
    source = find_column(header, SOURCE_HEADERS)
    if entity is None or photo is None:
        raise ValueError("the manifest has no columns of entity and item")
    cell = lambda k: F.lit(None).cast("string") if k is None else F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    rows = numbered_rows(spark, path, sep)
    return rows.select(F.col("number").cast("int").alias("row_number"), cell(entity).alias("entity"), cell(photo).alias("photo_id"), cell(source).alias("source"), F.size("cells").alias("width")), source is not None


def shown(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """The columns as text: four decimals, or what DECIMALS says, and nothing for null."""
    out = []
    for name, header in headers.items():
        c = F.col(name)
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            # halves of the last digit as binary numbers have them, like other printers do
            places = DECIMALS.get(name, 4)
            c = F.bround(F.col(name), places).cast(f"decimal(38,{places})").cast("string")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(header))
    return df.select(*out)


def order_keys(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Texts without regard to case first, then as they are; other types as they are."""
    return [k for c in order for k in ([F.lower(c), F.col(c)] if isinstance(df.schema[c].dataType, T.StringType) else [F.col(c)])]


def write_delimited(df: DataFrame, path: str, headers: dict[str, str], order: Sequence[str] = ("entity_id", "path")) -> None:
    """A folder of delimited files in order: the distributed form of a result."""
    keys = order_keys(df, order)
    shown(df.sort(*keys), headers).write.mode("overwrite").csv(path, sep=";", header=True, quote='"', escape='"', emptyValue="", nullValue="", encoding="UTF-8")


def _quoted(cell: Column, sep: str) -> Column:
    """A cell in quotes where it holds what would end it."""
    return F.when(cell.rlike(f'[{sep}"\\r\\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def as_lines(rows: DataFrame, sep: str = ";") -> DataFrame:
    """rows of texts as the lines of a delimited file, each with its line end; formatted by Spark."""
    cells = [_quoted(F.col(f"`{c}`"), sep) for c in rows.columns]
    if len(cells) == 1:  # an empty line would be no row
        cells = [F.when(cells[0] == "", '""').otherwise(cells[0])]
    return rows.select(F.concat(F.concat_ws(sep, *cells), F.lit("\n")).alias("line"))


def write_single(df: DataFrame, path: str | Path, headers: dict[str, str], order: Sequence[str] = ("entity_id", "path")) -> None:
    """One file with a byte order mark, in order, replaced as a whole. Tasks write its parts; no row passes the driver.

    The folder is one that the driver and all executors share.
    """
    rows = shown(df.sort(*order_keys(df, order)), headers)
    head = io.StringIO()
    csv.writer(head, delimiter=";", lineterminator="\n").writerow(rows.columns)
    write_lines(as_lines(rows), path, codecs.BOM_UTF8 + head.getvalue().encode())


def write_report(outcomes: DataFrame, path: str | Path) -> None:
    """outcomes: row_number, entity, source, status and detail, as copying gives them, also where it was cancelled."""
    status = F.col("status")
    named = F.coalesce(*[F.when(status == k, F.lit(v)) for k, v in STATUSES.items()], status)
    write_single(outcomes.withColumn("status", named), path, REPORT, ("row_number",))
