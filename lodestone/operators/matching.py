"""Matching of observations to a gallery by cosine distance, in one pass or two.

gallery: entity_id, embedding. observations: obs_id, embedding and what else there is.
The gallery's matrix is broadcast while its size, which is checked, stays within a bound. A
larger gallery and its observations are dealt into blocks, every two of which meet in one
task, and the blocks' best two candidates are merged for each observation; nothing of them
passes the driver. Observations are never multiplied by references in the plan. Vectors are
normalised where they are multiplied. Those without a direction (null, zero, not finite, of
another length than the gallery's first) are left out on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.config import Settings
from lodestone.functions.text import casefold
from lodestone.functions.vectors import unit
from lodestone.storage import written

#: Bytes of a gallery's matrix, in double precision, that are broadcast at a time.
GALLERY_BYTES = 128 << 20
PAIRS = ("best_id", "best_dist", "second_id", "second_dist")


def entity_index(gallery: DataFrame) -> DataFrame:
    """entity_id and entity_idx, from 1 in order of the names, without regard to case. Only names are ranked, within their first letters and then over one row for each of these."""
    names = gallery.select("entity_id").distinct().withColumn("_cf", casefold(F.col("entity_id").cast("string"))).withColumn("_head", F.substring("_cf", 1, 3))
    heads = names.groupBy("_head").agg(F.count("*").alias("_n"))
    before = heads.select("_head", F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_head").orderBy("_cf", "entity_id"))
    return names.withColumn("_own", own).join(before, "_head").select("entity_id", (F.col("_own") + F.col("_before")).cast("int").alias("entity_idx"))


def _units(column: pa.Array | pa.ChunkedArray, width: int, normalise: bool) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the rows that have a direction and that many numbers, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    places = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    values = column.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(places), width)
    norm = np.sqrt((values * values).sum(axis=1))
    good = (norm > 1e-12) & np.isfinite(norm)
    return places[good], values[good] / norm[good, None] if normalise else values[good]


def _best_two(vectors: np.ndarray, matrix: np.ndarray, first: np.ndarray, names: np.ndarray) -> Iterator[tuple[slice, list[pa.Array]]]:
    """For stretches of vectors: best_id, best_dist, second_id, second_dist over references that stand by entity."""
    block = max(1, (32 << 20) // (8 * len(matrix)))
    for at in range(0, len(vectors), block):
        part = slice(at, min(at + block, len(vectors)))
        least = np.minimum.reduceat(1.0 - vectors[part] @ matrix.T, first, axis=1)
        order = np.argsort(least, axis=1, kind="stable")[:, :2]
        dist = np.take_along_axis(least, order, axis=1)
        n, two = len(order), order.shape[1] > 1
        yield part, [pa.array(names[order[:, 0]], pa.string()), pa.array(dist[:, 0]), pa.array(names[order[:, 1]], pa.string()) if two else pa.nulls(n, pa.string()), pa.array(dist[:, 1]) if two else pa.nulls(n, pa.float64())]


def _by_entity(table: pa.Table, width: int, normalise: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, first, names): the references' vectors by entity, where each entity begins, and its name."""
    places, vectors = _units(table["embedding"], width, normalise)
    owner = np.array(table["entity_id"].to_pylist(), dtype=object)[places]
    order = np.argsort(owner, kind="stable") if len(owner) else places
    names, first = np.unique(owner[order], return_index=True) if len(owner) else (owner, places)
    return vectors[order], first, names


def _against_all(observations: DataFrame, refs: DataFrame, width: int, obs_col: str, normalise: bool, schema: T.StructType) -> DataFrame:
    """Observations against a gallery of checked size, which is broadcast."""
    shared = observations.sparkSession.sparkContext.broadcast(_by_entity(refs.toArrow(), width, normalise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, first, names = shared.value
        for batch in batches:
            places, vectors = _units(batch.column(1), width, normalise)
            if not len(matrix):
                continue
            for part, columns in _best_two(vectors, matrix, first, names):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places[part])), *columns], names=schema.names)

    return observations.select(obs_col, "embedding").mapInArrow(run, schema)


def _in_blocks(observations: DataFrame, refs: DataFrame, width: int, obs_col: str, normalise: bool, schema: T.StructType, blocks: int) -> DataFrame:
    """Every block of observations against every block of references; the candidates of an observation are merged."""
    n = observations.count()
    parts = max(1, -(-8 * n * width // GALLERY_BYTES))
    spread = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    deal = lambda c, k: F.pmod(F.xxhash64(*c), F.lit(k)).cast("int")
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    own = observations.select(F.col(obs_col).alias("obs"), F.lit(None).cast("string").alias("entity_id"), vector, deal([obs_col], parts).alias("part"), F.explode(spread(blocks)).alias("block"))
    theirs = refs.select(F.lit(None).cast(observations.schema[obs_col].dataType).alias("obs"), "entity_id", vector, F.explode(spread(parts)).alias("part"), deal(["entity_id", "embedding"], blocks).alias("block"))
    kind = observations.schema[obs_col].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        mine = pc.is_null(table["entity_id"])
        asked, held = table.filter(mine), table.filter(pc.invert(mine))
        matrix, first, names = _by_entity(held, width, normalise)
        places, vectors = _units(asked["embedding"], width, normalise)
        out = [pa.table([asked["obs"].take(pa.array(places[part])), *columns], names=schema.names) for part, columns in _best_two(vectors, matrix, first, names)] if len(matrix) else []
        return pa.concat_tables([pa.table({f: pa.array([], t) for f, t in zip(schema.names, (table.schema.field("obs").type, pa.string(), pa.float64(), pa.string(), pa.float64()), strict=True)}), *out])

    pairs = own.unionByName(theirs).groupBy("part", "block").applyInArrow(run, f"{obs_col} {kind}, best_id string, best_dist double, second_id string, second_dist double")
    # the two best entities overall are among the two best of the blocks that hold their closest references
    both = pairs.select(obs_col, F.explode(F.array(*[F.struct(F.col(f"{w}_dist").alias("d"), F.col(f"{w}_id").alias("id")) for w in ("best", "second")])).alias("c")).where("c.id IS NOT NULL")
    closest = both.groupBy(obs_col, "c.id").agg(F.min("c.d").alias("d"))
    best = closest.groupBy(obs_col).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, 2).alias("c"))
    pick = lambda i, f: F.get("c", F.lit(i))[f]
    return best.select(obs_col, pick(0, "id").alias("best_id"), pick(0, "d").alias("best_dist"), pick(1, "id").alias("second_id"), pick(1, "d").alias("second_dist"))


def top2(observations: DataFrame, gallery: DataFrame, *, obs_col: str = "obs_id", normalise: bool = True) -> DataFrame:
    """For each observation the closest two different entities and their smallest distances; equal distances go by name."""
    refs = gallery.select(F.col("entity_id").cast("string").alias("entity_id"), "embedding").where("entity_id IS NOT NULL AND embedding IS NOT NULL")
    size = refs.agg(F.sum(F.size("embedding").cast("long")).alias("values"), F.min_by(F.size("embedding"), F.struct("entity_id", F.size("embedding"))).alias("width")).first()
    schema = T.StructType([observations.schema[obs_col], T.StructField("best_id", T.StringType()), T.StructField("best_dist", T.DoubleType()), T.StructField("second_id", T.StringType()), T.StructField("second_dist", T.DoubleType())])
    if not size["values"]:
        return observations.where("embedding IS NOT NULL").select(obs_col, *[F.lit(None).cast("string" if c.endswith("id") else "double").alias(c) for c in PAIRS])
    obs = observations.select(obs_col, "embedding").where("embedding IS NOT NULL")
    blocks = -(-8 * size["values"] // GALLERY_BYTES)
    if blocks == 1:
        return _against_all(obs, refs, size["width"], obs_col, normalise, schema)
    return _in_blocks(obs, refs, size["width"], obs_col, normalise, schema, blocks)


def problem(s: Settings) -> Column:
    """Null for a match; the distance is tested before the margin, and a gallery of one entity has no margin."""
    too_far = F.col("best_dist") > s.match_threshold
    too_close = F.coalesce(F.col("second_dist") - F.col("best_dist") < s.ambiguity_margin, F.lit(False))
    return F.when(too_far, "distance").when(too_close, "margin")


def match(observations: DataFrame, gallery: DataFrame, s: Settings, *, obs_col: str = "obs_id") -> DataFrame:
    """obs, best_id, best_dist, second_id, second_dist, problem, accepted_id."""
    found = top2(observations, gallery, obs_col=obs_col).where("best_id IS NOT NULL").withColumn("problem", problem(s))
    return found.withColumn("accepted_id", F.when(F.col("problem").isNull(), F.col("best_id")))


def anchors(observations: DataFrame, matched: DataFrame, s: Settings, *, obs_col: str = "obs_id") -> DataFrame:
    """entity_id, embedding of the surest matches, up to anchors_per_entity for each entity.

    observations: also det_score, source and quality_reasons.
    """
    sure = (
        matched.where(F.col("accepted_id").isNotNull() & (F.col("best_dist") <= s.anchor_limit))
        .join(observations.select(obs_col, "embedding", "det_score", "source", "quality_reasons"), obs_col)
        .where((F.size("quality_reasons") == 0) & ~F.col("source").startswith("rescue-") & (F.col("det_score") >= max(s.anchor_min_score, s.detector_threshold)))
    )
    order = Window.partitionBy("accepted_id").orderBy("best_dist", obs_col)
    return sure.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= s.anchors_per_entity).select(F.col("accepted_id").alias("entity_id"), "embedding")


def match_two_pass(observations: DataFrame, gallery: DataFrame, s: Settings, *, obs_col: str = "obs_id") -> DataFrame:
    """The result of match with recovered: rows near the threshold are matched again with anchors added, which come from the first pass alone.

    A row is recovered if the larger gallery accepts the entity that was best before, closer by recovery_gain.
    """
    # narrow rows that anchors, border and result all need
    first = written(match(observations, gallery, s, obs_col=obs_col), "matched", narrow=True)
    extra = anchors(observations, first, s, obs_col=obs_col)
    larger = gallery.select(F.col("entity_id").cast("string").alias("entity_id"), F.col("embedding").cast("array<double>").alias("embedding")).unionByName(extra.select("entity_id", F.col("embedding").cast("array<double>").alias("embedding")))
    border = first.where(F.col("accepted_id").isNull() & (F.col("best_dist") <= s.match_threshold + s.recovery_band)).select(obs_col, F.col("best_id").alias("was_id"), F.col("best_dist").alias("was_dist"))
    again = match(observations.join(border.select(obs_col), obs_col, "left_semi"), larger, s, obs_col=obs_col)
    better = (
        again.where("accepted_id IS NOT NULL")
        .join(border, obs_col)
        .where((F.col("best_id") == F.col("was_id")) & (F.col("best_dist") <= F.col("was_dist") - s.recovery_gain))
        .select(obs_col, F.struct("best_id", "best_dist", "second_id", "second_dist", "problem", "accepted_id").alias("new"))
    )
    joined = first.join(better, obs_col, "left")
    recovered = F.col("new").isNotNull()
    columns = ["best_id", "best_dist", "second_id", "second_dist", "problem", "accepted_id"]
    return joined.select(obs_col, *[F.when(recovered, F.col("new").getField(c)).otherwise(F.col(c)).alias(c) for c in columns], recovered.alias("recovered"))


def _farthest(table: pa.Table) -> pa.Table:
    """The pair farthest apart of two blocks of an entity's references, or within one; of equals the first."""
    refs, own = np.array(table["ref"].to_pylist(), dtype=object), table["own"].to_numpy()
    values = table["v"].combine_chunks()
    vectors = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
    left, right = np.flatnonzero(own == table["i"][0].as_py()), np.flatnonzero(own == table["j"][0].as_py())
    best = None
    if len(left) and len(right):
        dots = vectors[left] @ vectors[right].T
        same = np.unique(refs, return_inverse=True)[1]
        dots[same[left][:, None] == same[right][None, :]] = np.inf
        # what a matrix product rounds differently is computed anew for the pairs that may be farthest
        x, y = np.nonzero(dots <= dots.min() + 1e-12)
        for at in range(0, len(x) if np.isfinite(dots.min()) else 0, 65536):
            a, b = left[x[at : at + 65536]], right[y[at : at + 65536]]
            exact = np.einsum("pd,pd->p", vectors[a], vectors[b])
            for d, k, m in zip(exact.tolist(), refs[a].tolist(), refs[b].tolist(), strict=True):
                pair = (d - 1, min(k, m), max(k, m))
                best = pair if best is None or pair < best else best
    rows = [] if best is None else [best]
    return pa.table({"entity_id": table["entity_id"][: len(rows)], "d": pa.array([r[0] for r in rows], pa.float64()), "a": pa.array([r[1] for r in rows], table.schema.field("ref").type), "b": pa.array([r[2] for r in rows], table.schema.field("ref").type)})


def reference_consistency(gallery: DataFrame, s: Settings, *, ref_col: str = "ref_id", block: int = 1024) -> DataFrame:
    """Of each entity with several references the pair farthest apart, the first of equals: entity_id, refs, ref_a, ref_b, worst_dist, warn.

    Every two blocks of an entity's references meet in one task, which returns one pair.
    """
    g = gallery.select("entity_id", F.col(ref_col).alias("ref"), unit(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    counts = g.groupBy("entity_id").agg(F.count("*").alias("refs"))
    sizes = counts.select(F.col("entity_id").alias("of"), F.ceil(F.col("refs") / block).cast("int").alias("blocks"))
    dealt = g.join(sizes, F.col("entity_id") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("ref"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = met.select("entity_id", "ref", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    ref = g.schema["ref"].dataType.simpleString()
    pairs = rows.groupBy("entity_id", "i", "j").applyInArrow(_farthest, f"entity_id {g.schema['entity_id'].dataType.simpleString()}, d double, a {ref}, b {ref}")
    worst = pairs.groupBy("entity_id").agg(F.min(F.struct("d", "a", "b")).alias("p"))
    return worst.join(counts, "entity_id").select("entity_id", "refs", F.col("p.a").alias("ref_a"), F.col("p.b").alias("ref_b"), (-F.col("p.d")).alias("worst_dist"), (-F.col("p.d") > s.reference_warn).alias("warn"))


def usable_references(references: DataFrame) -> DataFrame:
    """entity_id, ref_id, embedding of references without an error, with exactly one box and no reason against them.

    references: entity_id, ref_id, boxes, embedding, quality_reasons, error.
    """
    return references.where(F.col("error").isNull() & (F.col("boxes") == 1) & (F.size("quality_reasons") == 0)).select("entity_id", "ref_id", "embedding")


def gallery_sizes(gallery: DataFrame) -> DataFrame:
    return gallery.agg(F.count_distinct("entity_id").alias("entities"), F.count("*").alias("refs"))
