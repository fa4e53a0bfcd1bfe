"""Collection: rows of a manifest resolved against a file listing, and a plan of copies.

manifest: row_number, entity, photo_id, source (null without that column), width and, where
it is known, has_source. files: path (relative to the source folder). The plan has a status
and a reason for each row; copying is a step of its own.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import base_name, casefold, folder_name, inner_path, stem
from lodestone.storage import written


def stem_index(files: DataFrame, destination: str | None = None) -> DataFrame:
    """stem (case-folded), found (the first path) and files (how many there are): files by name, without those that are hidden or in the destination. Combined on the map side, however many share a name."""
    seen = files.where(~base_name(F.col("path")).startswith("."))
    if destination:
        seen = seen.where(~F.col("path").startswith(destination.rstrip("/") + "/"))
    return seen.groupBy(casefold(stem(F.col("path"))).alias("stem")).agg(F.min("path").alias("found"), F.count("*").alias("files"))


def _first_free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by scope, root and tail in their order, after the names that are taken there (they have no id). What one root's names are is all that is remembered."""
    group, held, ahead = None, set(), {}
    for batch in batches:
        ids, unique = [], []
        for scope, root, tail, own, name, low, end in batch[["scope", "root", "tail", "id", "name", "low", "end"]].itertuples(index=False):
            if (scope, root, tail) != group:
                group, held, ahead = (scope, root, tail), set(), {}
            if own is None:
                held.add(low)
                continue
            n = next(k for k in count(ahead.get(low, 1)) if (low + _mark(k)) not in held)
            ahead[low] = n + 1
            held.add(low + _mark(n))
            ids.append(own)
            unique.append(name + _mark(n) + end)
        yield pd.DataFrame({"id": ids, "unique": unique})


def _mark(n: int) -> str:
    return f" ({n})" if n > 1 else ""


def unique_names(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """rows: id (string, unique), scope, name, end and place. id, unique: in order of place each row gets its name or, where that is taken, the first free number between name and end.

    taken: scope, name, end of what stands there already. Names can only meet within a scope
    if they agree but for case and numbers at their end. Where all that do are one name and
    none is taken, ranks are the numbers; the others are gone through in order, as a stream.
    """
    keyed = lambda df: df.withColumns({"low": casefold(F.col("name")), "tail": casefold(F.col("end"))}).withColumn("root", F.regexp_replace("low", r"( \([0-9]+\))+$", ""))
    own = keyed(rows).withColumn("mine", F.lit(True))
    if taken is not None:
        nothing = {c: F.lit(None).cast(own.schema[c].dataType) for c in ("id", "place")}
        own = own.unionByName(keyed(taken.select("scope", "name", "end")).withColumns(nothing).withColumn("mine", F.lit(False)))
    key = ["scope", "root", "tail"]
    kinds = own.groupBy(*key).agg((F.min("low") == F.max("low")).alias("one"), F.min("mine").alias("free"))
    both = own.join(kinds, key).withColumn("ranked", F.col("one") & F.col("free"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    ranked = both.where("ranked").withColumn("n", n).select("id", F.concat("name", F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n"), F.lit(")"))).otherwise(""), "end").alias("unique"))
    stream = both.where("NOT ranked").repartition(*key).sortWithinPartitions(*key, "mine", "place")
    return ranked.unionByName(stream.select(*key, "id", "name", "low", "end").mapInPandas(_first_free, "id string, unique string"))


def folder_names(entities: DataFrame) -> DataFrame:
    """entity, folder: names that differ without regard to case, numbered in order of the entities where they would not."""
    named = entities.select("entity").distinct().where("entity <> ''")
    rows = named.select(F.col("entity").alias("id"), F.lit("").alias("scope"), folder_name(F.col("entity")).alias("name"), F.lit("").alias("end"), F.struct(casefold(F.col("entity")).alias("cf"), "entity").alias("place"))
    return unique_names(rows).select(F.col("id").alias("entity"), F.col("unique").alias("folder"))


def resolve(manifest: DataFrame, files: DataFrame, *, has_source: bool, destination: str | None = None) -> DataFrame:
    """manifest rows with path, status (found or skipped) and reason."""
    blank = (F.coalesce("entity", F.lit("")) == "") | (F.coalesce("photo_id", F.lit("")) == "")
    if has_source:
        known = files.select(F.col("path").alias("found"))
        rows = manifest.withColumn("wanted", inner_path(F.trim("source"))).join(known, F.col("wanted") == F.col("found"), "left").withColumn("path", F.col("found"))
        why = F.when(F.col("path").isNull(), "source missing or outside")
    else:
        index = stem_index(files, destination)
        rows = manifest.withColumn("wanted", casefold(stem(F.col("photo_id")))).join(index, F.col("wanted") == F.col("stem"), "left")
        rows = rows.withColumn("path", F.when(F.col("files") == 1, F.col("found")))
        why = F.when(F.col("files").isNull(), "no such file").when(F.col("files") > 1, "several files")
    short = F.coalesce(F.col("width") < 2, F.lit(False))
    reason = F.when(short, "short row").when(blank, "empty entity or item").otherwise(why)
    out = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "found").otherwise("skipped"))
    return out.select("row_number", "entity", "photo_id", F.when(F.col("status") == "found", F.col("path")).alias("path"), "status", "reason")


def _parts(path: Column) -> tuple[Column, Column]:
    """The name of a path without its suffix, and the rest."""
    name, plain = base_name(path), stem(path)
    return plain, F.substr(name, F.length(plain) + 1)


def copy_plan(manifest: DataFrame, files: DataFrame, *, has_source: bool, destination: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """resolve with target: a path within the destination that no other row and no existing file (folder, name) has. Rows of one number, as a listing that repeats a path makes them, go one by one."""
    rows = resolve(manifest, files, has_source=has_source, destination=destination)
    again = F.row_number().over(Window.partitionBy("row_number").orderBy("path"))
    named = rows.join(folder_names(manifest), "entity", "left").withColumn("again", again).withColumn("own", F.concat_ws("#", "row_number", "again"))
    name, end = _parts(F.col("path"))
    wanted = named.where("status = 'found'").select(F.col("own").alias("id"), F.col("folder").alias("scope"), name.alias("name"), end.alias("end"), F.struct("row_number", "again").alias("place"))
    taken = None
    if existing is not None:
        name, end = _parts(F.col("name"))
        taken = existing.select(F.col("folder").alias("scope"), name.alias("own"), end.alias("end")).withColumnRenamed("own", "name")
    targets = unique_names(wanted, taken)
    planned = named.join(targets, F.col("own") == F.col("id"), "left")
    return planned.select("row_number", "entity", "photo_id", "path", "status", "reason", F.concat("folder", F.lit("/"), "unique").alias("target"))


def collect_summary(plan: DataFrame) -> DataFrame:
    ok = F.col("status") == "found"
    return plan.agg(F.count_if(ok).alias("copied"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_distinct(F.when(ok, F.col("entity"))).alias("targets"))


def copy_file(source: str, target: str, cancelled: Callable[[], bool] = lambda: False, chunk: int = 1 << 20) -> None:
    """Copies a file piece by piece beside its place and puts it there whole; a cancelled or failed copy leaves nothing behind."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}.part"
    try:
        with open(source, "rb") as a, open(part, "wb") as b:
            while not cancelled():
                data = a.read(chunk)
                if not data:
                    break
                b.write(data)
            else:
                raise InterruptedError("copying was cancelled")
        shutil.copystat(source, part)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def copy_files(plan: DataFrame, source_root: str, destination_root: str, *, cancel_file: str | None = None) -> DataFrame:
    """Carries the plan out and gives row_number, entity, source, status (copied, skipped, error or cancelled) and detail of every row.

    Each file is copied by one task; both folders must be reachable from every executor. A
    task that runs again copies again. Where cancel_file exists, what is not copied yet is
    cancelled; the outcomes of all rows come back all the same.
    """

    def outcome(row) -> tuple[str, str]:  # noqa: ANN001
        if row.status != "found":
            return "skipped", row.reason
        try:
            copy_file(os.path.join(source_root, row.path), os.path.join(destination_root, row.target), cancelled=lambda: cancel_file is not None and os.path.exists(cancel_file))
        except InterruptedError as e:
            return "cancelled", str(e)
        except OSError as e:
            return "error", str(e)
        return "copied", row.target

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [outcome(r) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"row_number": batch["row_number"], "entity": batch["entity"], "source": batch["path"].fillna(batch["photo_id"]), "status": [f[0] for f in found], "detail": [f[1] for f in found]})

    number = plan.schema["row_number"].dataType.simpleString()
    return written(plan.mapInPandas(run, f"row_number {number}, entity string, source string, status string, detail string"), "copied")


def copy_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts, and whether copying was cancelled."""
    status = F.col("status")
    return outcomes.agg(*[F.count_if(status == k).alias(name) for k, name in (("copied", "copied"), ("skipped", "skipped"), ("error", "errors"))], F.count_distinct(F.when(status == "copied", F.col("entity"))).alias("targets"), (F.count_if(status == "cancelled") > 0).alias("cancelled"))
