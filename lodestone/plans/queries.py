"""Queries of the operators over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.boxes import clipped, padded
from lodestone.functions.text import camera_time, identifier, identity_key, sequence_number, sequence_prefix, stem, suffix
from lodestone.functions.vectors import openness
from lodestone.operators import collect, detections, identity, matching, quality, reasons, routing, series
from lodestone.operators.crowded import suppress_in_rounds
from lodestone.operators.samples import exposure
from lodestone.plans import inputs
from lodestone.plans.inputs import SETTINGS
from lodestone.sources.delimited import ACCEPTED, read_manifest, write_single
from lodestone.sources.exif import dates_of_heads
from lodestone.sources.files import candidates, item_order
from lodestone.storage import shared_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    """Registers a query under its name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- matching ---

FIRST_PASS = f"""
WITH {inputs.OBSERVATIONS_SQL},
d1 AS (SELECT obs_id, entity_id, min(1 - list_dot_product(o.e, g.e)) AS d FROM obs o, gallery g GROUP BY obs_id, entity_id),
n1 AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY d, entity_id) AS n FROM d1),
t1 AS (
  SELECT obs_id, max(entity_id) FILTER (WHERE n = 1) AS best_id, max(d) FILTER (WHERE n = 1) AS best_dist,
         max(entity_id) FILTER (WHERE n = 2) AS second_id, max(d) FILTER (WHERE n = 2) AS second_dist
  FROM n1 GROUP BY obs_id),
p1 AS (
  SELECT *, CASE WHEN best_dist > 0.70 THEN 'distance' WHEN coalesce(second_dist - best_dist < 0.04, false) THEN 'margin' END AS problem FROM t1),
first AS (SELECT *, CASE WHEN problem IS NULL THEN best_id END AS accepted_id FROM p1)
"""
BOTH_PASSES = (
    FIRST_PASS
    + """,
sure AS (
  SELECT f.accepted_id AS entity_id, o.e, row_number() OVER (PARTITION BY f.accepted_id ORDER BY f.best_dist, f.obs_id) AS n
  FROM first f JOIN obs o USING (obs_id)
  WHERE f.accepted_id IS NOT NULL AND f.best_dist <= 0.64 AND len(o.reasons) = 0 AND NOT starts_with(o.source, 'rescue-') AND o.det_score >= 0.40),
larger AS (SELECT entity_id, e FROM gallery UNION ALL SELECT entity_id, e FROM sure WHERE n <= 8),
border AS (SELECT * FROM first WHERE accepted_id IS NULL AND best_dist <= 0.80),
d2 AS (SELECT obs_id, g.entity_id, min(1 - list_dot_product(o.e, g.e)) AS d FROM obs o JOIN border USING (obs_id), larger g GROUP BY 1, 2),
n2 AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY d, entity_id) AS n FROM d2),
t2 AS (
  SELECT obs_id, max(entity_id) FILTER (WHERE n = 1) AS best_id, max(d) FILTER (WHERE n = 1) AS best_dist,
         max(entity_id) FILTER (WHERE n = 2) AS second_id, max(d) FILTER (WHERE n = 2) AS second_dist
  FROM n2 GROUP BY obs_id),
better AS (
  SELECT t2.* FROM t2 JOIN border b USING (obs_id)
  WHERE t2.best_dist <= 0.70 AND NOT coalesce(t2.second_dist - t2.best_dist < 0.04, false)
    AND t2.best_id = b.best_id AND t2.best_dist <= b.best_dist - 0.015),
matched AS (
  SELECT f.obs_id, coalesce(n.best_id, f.best_id) AS best_id, coalesce(n.best_dist, f.best_dist) AS best_dist,
         CASE WHEN n.obs_id IS NULL THEN f.second_id ELSE n.second_id END AS second_id,
         CASE WHEN n.obs_id IS NULL THEN f.second_dist ELSE n.second_dist END AS second_dist,
         CASE WHEN n.obs_id IS NULL THEN f.problem END AS problem,
         CASE WHEN n.obs_id IS NULL THEN f.accepted_id ELSE n.best_id END AS accepted_id, n.obs_id IS NOT NULL AS recovered
  FROM first f LEFT JOIN better n USING (obs_id))
"""
)
ROUTED = (
    BOTH_PASSES
    + """,
rows AS (
  SELECT m.*, o.path, parse_filename(o.path, true) AS photo_id, o.reasons,
         CASE WHEN m.recovered THEN 'session-anchor' ELSE o.source END AS final_source, o.source
  FROM matched m JOIN obs o USING (obs_id)),
good AS (
  SELECT *, row_number() OVER (PARTITION BY accepted_id, path ORDER BY best_dist, obs_id) AS n FROM rows
  WHERE accepted_id IS NOT NULL AND len(reasons) = 0),
accepted AS (SELECT accepted_id AS entity_id, path, best_dist AS distance, obs_id, final_source AS source, photo_id FROM good WHERE n = 1),
bad AS (
  SELECT *, row_number() OVER (PARTITION BY accepted_id, path ORDER BY best_dist, obs_id) AS n FROM rows
  WHERE accepted_id IS NOT NULL AND len(reasons) > 0),
rejected AS (
  SELECT accepted_id AS entity_id, path, best_dist AS distance, obs_id, array_to_string(reasons, '; ') AS reason, final_source AS source, photo_id
  FROM bad WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM accepted a WHERE a.entity_id = bad.accepted_id AND a.path = bad.path)),
review AS (
  SELECT obs_id, photo_id, path, best_id, best_dist AS distance, second_id, second_dist AS distance2, problem, source
  FROM rows WHERE accepted_id IS NULL AND best_dist <= 0.78)
"""
)


@query(FIRST_PASS + "SELECT obs_id, best_id, round(best_dist, 6) AS best_dist, second_id, round(second_dist, 6) AS second_dist, problem, accepted_id FROM first")
def match_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match(inputs.observations(spark, sf_dir), inputs.gallery(spark, sf_dir), SETTINGS)
    return rounded(found, "best_dist", "second_dist")


@query(BOTH_PASSES + "SELECT obs_id, best_id, round(best_dist, 6) AS best_dist, second_id, round(second_dist, 6) AS second_dist, problem, accepted_id, recovered FROM matched")
def two_pass_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.match_two_pass(inputs.observations(spark, sf_dir), inputs.gallery(spark, sf_dir), SETTINGS)
    return rounded(found, "best_dist", "second_dist")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = inputs.observations(spark, sf_dir)
    found = matching.match_two_pass(obs, inputs.gallery(spark, sf_dir), SETTINGS).join(obs.select("obs_id", "path", "source", "quality_reasons"), "obs_id")
    return written(found, "routed", narrow=True)  # what follows reads it several times


@query(ROUTED + "SELECT entity_id, path, round(distance, 6) AS distance, obs_id, source, photo_id FROM accepted")
def route_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(routing.accepted(_matched(spark, sf_dir)), "distance")


@query(ROUTED + "SELECT entity_id, path, round(distance, 6) AS distance, obs_id, reason, source, photo_id FROM rejected")
def route_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(routing.rejected(_matched(spark, sf_dir)), "distance")


@query(ROUTED + "SELECT obs_id, photo_id, path, best_id, round(distance, 6) AS distance, second_id, round(distance2, 6) AS distance2, problem, source FROM review")
def route_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(routing.review(_matched(spark, sf_dir), SETTINGS), "distance", "distance2")


@query(
    ROUTED
    + """SELECT path, count(*) AS observations, count(*) FILTER (WHERE source LIKE '%full') AS "full", count(*) FILTER (WHERE source LIKE '%tile') AS tile,
  count(*) FILTER (WHERE source LIKE 'rescue-%') AS rescue, count(*) FILTER (WHERE accepted_id IS NOT NULL AND len(reasons) = 0) AS accepted,
  count(*) FILTER (WHERE accepted_id IS NOT NULL AND len(reasons) > 0) AS rejected,
  count(*) FILTER (WHERE accepted_id IS NULL AND best_dist <= 0.78) AS review, count(*) FILTER (WHERE recovered) AS recovered
FROM rows GROUP BY path"""
)
def item_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.item_diagnostics(_matched(spark, sf_dir), SETTINGS)


@query(
    ROUTED
    + """SELECT (SELECT count(DISTINCT path) FROM rows) AS items, (SELECT count(*) FROM rows) AS observations, (SELECT count(*) FROM rows WHERE recovered) AS recovered,
  (SELECT count(*) FROM accepted) AS accepted, (SELECT count(*) FROM rejected) AS rejected, (SELECT count(*) FROM review) AS review"""
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.run_summary(_matched(spark, sf_dir), SETTINGS)


@query(
    f"""WITH {inputs.OBSERVATIONS_SQL},
pairs AS (
  SELECT a.entity_id, a.ref_id AS ref_a, b.ref_id AS ref_b, 1 - list_dot_product(a.e, b.e) AS d
  FROM refs a JOIN refs b ON a.entity_id = b.entity_id AND a.ref_id < b.ref_id),
worst AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY d DESC, ref_a, ref_b) AS n FROM pairs)
SELECT entity_id, (SELECT count(*) FROM refs g WHERE g.entity_id = worst.entity_id) AS refs, ref_a, ref_b, round(d, 6) AS worst_dist, d > 0.55 AS warn
FROM worst WHERE n = 1"""
)
def reference_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.reference_consistency(inputs.references(spark, sf_dir), SETTINGS), "worst_dist")


@query(
    """WITH r AS (
  SELECT label::VARCHAR AS entity_id, vec_id AS ref_id FROM embeddings
  WHERE vec_id % 70 <> 0 AND vec_id % 4 <> 2 AND vec_id % 120 <> 0)
SELECT count(DISTINCT entity_id) AS entities, count(*) AS refs FROM r"""
)
def reference_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = inputs.references(spark, sf_dir).withColumns(
        {
            "boxes": F.when(F.col("ref_id") % 4 == 2, 2).otherwise(1),
            "quality_reasons": F.expr("filter(array(CASE WHEN ref_id % 120 = 0 THEN 'small' END), x -> x IS NOT NULL)"),
            "error": F.when(F.col("ref_id") % 70 == 0, "unreadable"),
        }
    )
    return matching.gallery_sizes(matching.usable_references(refs))


@query("SELECT DISTINCT label::VARCHAR AS entity_id, dense_rank() OVER (ORDER BY label::VARCHAR)::INT AS entity_idx FROM embeddings")
def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.entity_index(inputs.references(spark, sf_dir))


# --- series ---


def _series_sql(numbered: bool) -> str:
    return f"""
WITH {inputs.frames_sql(numbered=numbered)},
modes AS (
  SELECT entity_id, count(*) AS frames, avg(CASE WHEN seq IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share, count(DISTINCT CASE WHEN seq IS NOT NULL THEN dir END) AS sources,
         max(seq) - min(seq) AS span
  FROM frames GROUP BY entity_id),
ruled AS (SELECT *, coalesce(frames > 1 AND share >= 0.80 AND sources = 1 AND span <= 5000, false) AS by_number FROM modes),
keyed AS (
  SELECT f.*, CASE WHEN by_number THEN coalesce(seq, 10::BIGINT ** 15) ELSE micros END AS k1, CASE WHEN by_number THEN micros ELSE coalesce(seq, 10::BIGINT ** 15) END AS k2,
         CASE WHEN by_number THEN lower(name) ELSE lower(path) END AS k3
  FROM frames f JOIN ruled USING (entity_id)),
adjacent AS (
  SELECT *, lag(path) OVER w AS p_path, lag(dir) OVER w AS p_dir, lag(seq) OVER w AS p_seq, lag(micros) OVER w AS p_micros, lag(meta) OVER w AS p_meta
  FROM keyed WINDOW w AS (PARTITION BY entity_id ORDER BY k1, k2, k3, path)),
joined AS (
  SELECT *, coalesce(dir = p_dir
      AND (CASE WHEN seq IS NOT NULL AND p_seq IS NOT NULL THEN seq - p_seq > 0 AND seq - p_seq <= 5 ELSE true END)
      AND (CASE WHEN (meta AND p_meta) OR seq IS NULL OR p_seq IS NULL THEN greatest(0, micros - p_micros) <= 1200000000 ELSE true END), false) AS joins
  FROM adjacent),
between_frames AS (
  SELECT j.entity_id, j.path, f.entity_id AS target, count(*) AS n
  FROM joined j JOIN frames f ON f.dir = j.dir AND f.entity_id <> j.entity_id AND CASE
    WHEN j.seq IS NOT NULL AND j.p_seq IS NOT NULL AND j.p_seq < j.seq THEN f.seq > j.p_seq AND f.seq < j.seq
    ELSE f.micros > least(j.micros, j.p_micros) AND f.micros < greatest(j.micros, j.p_micros) END
  WHERE j.joins GROUP BY 1, 2, 3),
guard AS (SELECT DISTINCT entity_id, path FROM between_frames WHERE n >= 2),
cut AS (SELECT j.*, CASE WHEN j.joins AND g.path IS NULL THEN 0 ELSE 1 END AS breaks FROM joined j LEFT JOIN guard g ON g.entity_id = j.entity_id AND g.path = j.path),
numbered AS (SELECT *, sum(breaks) OVER (PARTITION BY entity_id ORDER BY k1, k2, k3, path ROWS UNBOUNDED PRECEDING)::BIGINT AS series_index FROM cut),
series AS (SELECT *, count(*) OVER (PARTITION BY entity_id, series_index) AS series_size FROM numbered)
"""


@query(_series_sql(True) + "SELECT entity_id, path, series_index, series_size FROM series")
def series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.split(inputs.frames(spark, sf_dir).select(*series.ORDERING), SETTINGS).select("entity_id", "path", "series_index", "series_size")


@query(_series_sql(False) + "SELECT entity_id, path, series_index, series_size FROM series")
def series_split_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that some frames lack: the guard also looks between times."""
    return series.split(inputs.frames(spark, sf_dir, numbered=False).select(*series.ORDERING), SETTINGS).select("entity_id", "path", "series_index", "series_size")


@query(
    _series_sql(True)
    + """,
eyes AS (SELECT *, least(eye_left, eye_right) AS eye FROM (SELECT * FROM series WHERE eye_left IS NOT NULL AND eye_right IS NOT NULL) UNION ALL SELECT *, NULL FROM series WHERE eye_left IS NULL OR eye_right IS NULL),
pool AS (SELECT * FROM (SELECT *, bool_or(coalesce(eye >= 0.105, false)) OVER (PARTITION BY entity_id, series_index) AS opened FROM eyes) WHERE NOT opened OR coalesce(eye >= 0.105, false)),
logs AS (SELECT *, CASE WHEN blur_score IS NOT NULL THEN ln(1 + greatest(0, blur_score)) END AS lb FROM pool),
ranks AS (
  SELECT *, count(eye) OVER s AS eyes, count(lb) OVER s AS blurs, max(eye) OVER s - min(eye) OVER s AS eye_span, max(lb) OVER s - min(lb) OVER s AS blur_span,
         rank() OVER (s ORDER BY eye NULLS LAST) AS eye_rank, rank() OVER (s ORDER BY lb NULLS LAST) AS blur_r,
         count(eye) OVER (s ORDER BY eye RANGE BETWEEN 1e-9::DOUBLE PRECEDING AND 1e-9::DOUBLE FOLLOWING) AS eye_eq,
         count(lb) OVER (s ORDER BY lb RANGE BETWEEN 1e-9::DOUBLE PRECEDING AND 1e-9::DOUBLE FOLLOWING) AS blur_eq
  FROM (SELECT * REPLACE (eye::DOUBLE AS eye) FROM logs) WINDOW s AS (PARTITION BY entity_id, series_index)),
parts AS (
  SELECT *, CASE WHEN eye IS NULL THEN CASE WHEN eyes > 0 THEN 0.35 ELSE 0.5 END WHEN eyes > 1 THEN CASE WHEN eye_span <= 1e-9 THEN 0.5 ELSE (eye_rank - 1 + greatest(0, eye_eq - 1) / 2) / (eyes - 1) END ELSE 0.75 END AS eye_part,
         CASE WHEN lb IS NULL THEN CASE WHEN blurs > 0 THEN 0.35 ELSE 0.5 END WHEN blurs <= 1 OR blur_span <= 1e-9 THEN 0.5 ELSE (blur_r - 1 + greatest(0, blur_eq - 1) / 2) / (blurs - 1) END AS blur_rank,
         CASE WHEN NOT posed THEN 0.65 ELSE greatest(0, least(1, 1 - greatest(abs(yaw) / 45, abs(pitch) / 35, abs(roll) / 35))) END AS pose_part
  FROM ranks),
scores AS (
  SELECT *, 0.40 * blur_rank::DOUBLE + 0.32 * eye_part::DOUBLE + 0.13 * greatest(0, least(1, 1 - distance::DOUBLE / 0.70)) + 0.10 * pose_part::DOUBLE + 0.05 * greatest(0, least(1, det_score::DOUBLE)) AS score FROM parts),
best AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id, series_index ORDER BY round(score, 12) DESC, round(distance, 12), round(coalesce(blur_score, -1), 12) DESC, lower(path), path) AS n FROM scores)
SELECT entity_id, path, series_index, series_size, round(score, 6) AS score, round(eye, 6) AS eye, round(blur_rank, 6) AS blur_rank, round(pose_part, 6) AS pose_part FROM best WHERE n = 1"""
)
def series_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = series.best_frames(inputs.frames(spark, sf_dir), SETTINGS)
    return rounded(best.select("entity_id", "path", "series_index", "series_size", "score", "eye", "blur_rank", "pose_part"), "score", "eye", "blur_rank", "pose_part")


@query(_series_sql(False) + "SELECT entity_id, frames, round(share, 6) AS share, sources, span::BIGINT AS span, by_number FROM ruled")
def order_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.order_modes(inputs.frames(spark, sf_dir, numbered=False)), "share").withColumn("span", F.col("span").cast("long"))


# --- boxes ---


@query(
    f"""WITH RECURSIVE {inputs.BOXES_SQL},
b AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY det_score DESC, (x2 - x1) * (y2 - y1) DESC, line, part, supp) AS i FROM boxes),
fold AS (
  SELECT item_id, i, [struct_pack(i := i, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM b WHERE i = 1
  UNION ALL
  SELECT b.item_id, b.i, CASE WHEN len(list_filter(f.kept, lambda k:
      greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))
      >= 0.35 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
         - greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))))) > 0
    THEN f.kept ELSE list_append(f.kept, struct_pack(i := b.i, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) END
  FROM fold f JOIN b ON b.item_id = f.item_id AND b.i = f.i + 1),
last AS (SELECT item_id, unnest(kept) AS k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i DESC) AS n FROM fold) WHERE n = 1)
SELECT b.item_id, b.line, b.part, b.supp, b.x1, b.y1, b.x2, b.y2, b.det_score FROM last JOIN b ON b.item_id = last.item_id AND b.i = last.k.i"""
)
def nms_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = detections.suppress(inputs.boxes(spark, sf_dir), SETTINGS.nms_iou, "item_id", tie=("line", "part", "supp"))
    return kept.select("item_id", "line", "part", "supp", *[F.col(f"bbox.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], "det_score")


@query(
    f"""WITH kept AS ({SQL['nms_keep']})
SELECT item_id % 4 AS sheet, item_id, line, part, supp, x1 + 400 * (item_id // 4 % 1000) AS x1, y1 + 300 * (item_id // 4000) AS y1, x2 + 400 * (item_id // 4 % 1000) AS x2, y2 + 300 * (item_id // 4000) AS y2, det_score FROM kept"""
)
def nms_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of nms_keep side by side on four sheets, each of which is one image: what is kept is the same, but no image is a group."""
    right, down = F.col("item_id") / 4 % 1000, F.col("item_id") / 4000
    at = lambda side, step, size: (F.col(f"bbox.{side}") + F.floor(step).cast("int") * size).alias(side)
    box = F.struct(at("x1", right, 400), at("y1", down, 300), at("x2", right, 400), at("y2", down, 300))
    sheets = inputs.boxes(spark, sf_dir).withColumns({"sheet": F.col("item_id") % 4, "bbox": box})
    kept = suppress_in_rounds(sheets, SETTINGS.nms_iou, "sheet", tie=("line", "part", "supp"))
    return kept.select("sheet", "item_id", "line", "part", "supp", *[F.col(f"bbox.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], "det_score")


@query(
    f"""WITH {inputs.BOXES_SQL},
w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY det_score DESC, (x2 - x1) * (y2 - y1) DESC, line, part, supp) AS n FROM boxes WHERE det_score < 0.18)
SELECT item_id, line, part, supp, det_score FROM boxes WHERE det_score >= 0.18
UNION ALL SELECT item_id, line, part, supp, det_score FROM w WHERE n <= 1"""
)
def weak_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = detections.cap_weak(inputs.boxes(spark, sf_dir), replace(SETTINGS, rescue_max_candidates=1), "item_id", tie=("line", "part", "supp"))
    return kept.select("item_id", "line", "part", "supp", "det_score")


@query(
    """WITH images AS (SELECT p_partkey AS item_id, 1500 + p_size * 60 AS w, 1200 + p_partkey % 40 * 50 AS h FROM part),
wanted AS (SELECT * FROM images WHERE greatest(w, h) > 1800 AND (w > 1400 OR h > 1400)),
xs AS (SELECT DISTINCT item_id, w, h, x FROM (
  SELECT item_id, w, h, unnest(CASE WHEN w <= 1400 THEN [0::BIGINT] ELSE list_append(range(0, w - 1400 + 1, 1120), w - 1400) END) AS x FROM wanted)),
ys AS (SELECT DISTINCT item_id, y FROM (
  SELECT item_id, unnest(CASE WHEN h <= 1400 THEN [0::BIGINT] ELSE list_append(range(0, h - 1400 + 1, 1120), h - 1400) END) AS y FROM wanted))
SELECT item_id, x, y, least(w, x + 1400) - x AS w, least(h, y + 1400) - y AS h FROM xs JOIN ys USING (item_id)"""
)
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = inputs.table(spark, sf_dir, "part").selectExpr("p_partkey AS item_id", "CAST(1500 + p_size * 60 AS INT) AS image_w", "CAST(1200 + p_partkey % 40 * 50 AS INT) AS image_h")
    tiles = detections.tile_grid(images, replace(SETTINGS, tile_size=1400, tile_overlap=0.2))
    return tiles.select("item_id", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h")])


@query(
    f"""WITH {inputs.MEASURED_SQL}
SELECT item_id, line, part, bx1::INT AS x1, by1::INT AS y1, greatest(bx1 + 1, least(w, round_even(x2, 0)::BIGINT))::INT AS x2,
       greatest(by1 + 1, least(h, round_even(y2, 0)::BIGINT))::INT AS y2, CASE WHEN clip / 2 >= 0.18 THEN 'full' ELSE 'rescue-full' END AS source, round(clip / 2, 6) AS det_score
FROM m WHERE clip / 2 >= 0.10"""
)
def box_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.array(F.lit(1.0), F.lit(2.0))
    rows = inputs.measured(spark, sf_dir).withColumns({"det_score": F.col("clipped") / 2, "source": F.lit("full"), "kps": F.array(*[point] * 5)})
    found = detections.candidates(rows, SETTINGS)
    return rounded(found.select("item_id", "line", "part", *[F.col(f"bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], "source", "det_score"), "det_score")


@query(
    f"""WITH {inputs.MEASURED_SQL},
c AS (SELECT *, greatest(bx1 + 1, least(w, round_even(x2, 0)::BIGINT)) AS bx2, greatest(by1 + 1, least(h, round_even(y2, 0)::BIGINT)) AS by2 FROM m)
SELECT item_id, line, part, greatest(0, bx1 - trunc((bx2 - bx1) * 0.08::DOUBLE)::INT)::INT AS x1, greatest(0, by1 - trunc((by2 - by1) * 0.08::DOUBLE)::INT)::INT AS y1,
       least(w, bx2 + trunc((bx2 - bx1) * 0.08::DOUBLE)::INT)::INT AS x2, least(h, by2 + trunc((by2 - by1) * 0.08::DOUBLE)::INT)::INT AS y2
FROM c"""
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measured(spark, sf_dir)
    box = clipped(F.col("raw_bbox"), F.col("image_w"), F.col("image_h"))
    return rows.withColumn("crop", padded(box, F.col("image_w"), F.col("image_h"))).select("item_id", "line", "part", *[F.col(f"crop.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    f"""WITH {inputs.BOXES_SQL},
inside AS (
  SELECT *, greatest(6, least(28, least(greatest(x2 - x1, 1), greatest(y2 - y1, 1)) * 0.10)) AS margin, line % 3 * 100 AS tx, part % 2 * 80 AS ty FROM boxes)
SELECT item_id, line, part, supp, NOT ((tx > 0 AND x1 <= margin) OR (ty > 0 AND y1 <= margin) OR (tx + 240 < 500 AND x2 >= 240 - margin) OR (ty + 200 < 300 AND y2 >= 200 - margin)) AS inside
FROM inside"""
)
def tile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.boxes(spark, sf_dir)
    ok = detections.inside_tile(F.col("bbox"), F.col("line") % 3 * 100, F.col("part") % 2 * 80, F.lit(240), F.lit(200), F.lit(500), F.lit(300))
    return b.select("item_id", "line", "part", "supp", ok.alias("inside"))


@query(
    f"""WITH RECURSIVE {inputs.BOXES_SQL},
strong AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY det_score DESC, (x2 - x1) * (y2 - y1) DESC, line, part, supp) AS i FROM boxes WHERE det_score >= 0.45),
fold AS (
  SELECT item_id, i, [struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM strong WHERE i = 1
  UNION ALL
  SELECT b.item_id, b.i, CASE WHEN len(list_filter(f.kept, lambda k:
      greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))
      >= 0.35 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
         - greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))))) > 0
    THEN f.kept ELSE list_append(f.kept, struct_pack(x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) END
  FROM fold f JOIN strong b ON b.item_id = f.item_id AND b.i = f.i + 1),
counts AS (SELECT item_id, max(len(kept)) AS boxes FROM fold GROUP BY item_id)
SELECT DISTINCT b.item_id, coalesce(c.boxes, 0)::BIGINT AS boxes, coalesce(c.boxes, 0) = 1 AS ok FROM boxes b LEFT JOIN counts c USING (item_id)"""
)
def reference_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.references_with_one_box(inputs.boxes(spark, sf_dir).select("item_id", "bbox", "det_score", "line", "part", "supp"), SETTINGS, tie=("line", "part", "supp"))


@query(
    f"""WITH RECURSIVE {inputs.BOXES_SQL},
local AS (
  SELECT *, supp % 2 = 1 AS tiled, line % 3 * 100 AS tx, part % 2 * 80 AS ty, greatest(6, least(28, least(greatest(x2 - x1, 1), greatest(y2 - y1, 1)) * 0.10)) AS margin
  FROM boxes WHERE part % 13 <> 0 AND part % 17 <> 0 AND det_score >= 0.10),
whole AS (
  SELECT item_id, line, part, supp, det_score, CASE WHEN tiled THEN 'tile' ELSE 'full' END AS seen, CASE WHEN tiled THEN tx ELSE 0 END AS dx, CASE WHEN tiled THEN ty ELSE 0 END AS dy, x1, y1, x2, y2
  FROM local WHERE NOT tiled OR NOT ((tx > 0 AND x1 <= margin) OR (ty > 0 AND y1 <= margin) OR (tx + 240 < 500 AND x2 >= 240 - margin) OR (ty + 200 < 300 AND y2 >= 200 - margin))),
corners AS (SELECT *, greatest(0, least(499, x1 + dx)) AS a1, greatest(0, least(299, y1 + dy)) AS b1 FROM whole),
framed AS (
  SELECT item_id, line, part, supp, det_score, CASE WHEN det_score >= 0.18 THEN seen ELSE 'rescue-' || seen END AS source, a1 AS x1, b1 AS y1,
         greatest(a1 + 1, least(500, x2 + dx)) AS x2, greatest(b1 + 1, least(300, y2 + dy)) AS y2 FROM corners),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY det_score DESC, (x2 - x1) * (y2 - y1) DESC, line, part, supp) AS i FROM framed),
fold AS (
  SELECT item_id, i, [struct_pack(i := i, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS kept FROM b WHERE i = 1
  UNION ALL
  SELECT b.item_id, b.i, CASE WHEN len(list_filter(f.kept, lambda k:
      greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))
      >= 0.35 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
         - greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))))) > 0
    THEN f.kept ELSE list_append(f.kept, struct_pack(i := b.i, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) END
  FROM fold f JOIN b ON b.item_id = f.item_id AND b.i = f.i + 1),
last AS (SELECT item_id, unnest(kept) AS k FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i DESC) AS n FROM fold) WHERE n = 1),
kept AS (SELECT b.* FROM last JOIN b ON b.item_id = last.item_id AND b.i = last.k.i),
capped AS (SELECT *, row_number() OVER (PARTITION BY item_id, det_score >= 0.18 ORDER BY i) AS n FROM kept)
SELECT item_id, line, part, supp, source, x1, y1, x2, y2, det_score FROM capped WHERE det_score >= 0.18 OR n <= 1"""
)
def detect_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of whole frames and of tiles together: landmarks, inner edges, shifting, suppression and the cap on weak ones."""
    full, tiled = inputs.frame_boxes(spark, sf_dir)
    s = replace(SETTINGS, rescue_max_candidates=1)
    found = detections.detect(detections.candidates(full, s), detections.candidates(detections.from_tiles(tiled), s), s, tie=("line", "part", "supp"))
    return found.select("item_id", "line", "part", "supp", "source", *[F.col(f"bbox.{c}").cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], "det_score")


# --- quality ---


JUDGED_SQL = f"""WITH {inputs.MEASURED_SQL}, {inputs.CLIPPING_SQL},
q AS (
  SELECT *, greatest(bx1 + 1, least(w, round_even(x2, 0)::BIGINT)) AS bx2, greatest(by1 + 1, least(h, round_even(y2, 0)::BIGINT)) AS by2 FROM clipping),
judged AS (
  SELECT *, list_filter([CASE WHEN least(bx2 - bx1, by2 - by1) < 45 THEN 'small' END], lambda x: x IS NOT NULL) || edge_reasons ||
  list_filter([CASE WHEN blur < 45 THEN 'blur' END, CASE WHEN clip > 0.55 OR gray < 22 OR gray > 238 THEN 'exposure' END,
    CASE WHEN posed AND abs(yaw) > 45 THEN 'yaw' END, CASE WHEN posed AND abs(pitch) > 35 THEN 'pitch' END, CASE WHEN posed AND abs(roll) > 35 THEN 'roll' END,
    CASE WHEN eye_l IS NOT NULL AND least(eye_l, eye_r) < 0.105 THEN 'eyes' END], lambda x: x IS NOT NULL) AS reasons
  FROM q)
"""


@query(JUDGED_SQL + "SELECT item_id, line, part, array_to_string(reasons, ';') AS reasons FROM judged")
def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measured(spark, sf_dir).withColumn("bbox", clipped(F.col("raw_bbox"), F.col("image_w"), F.col("image_h")))
    return quality.with_quality(rows, replace(SETTINGS, reject_exposure=True)).select("item_id", "line", "part", F.concat_ws(";", "quality_reasons").alias("reasons"))


def _shown_sql(x: str, places: int) -> str:
    """A number of that many places: nine digits, then halves to even, in whole numbers."""
    units = f"round_even(round_even({x} * 1e9, 0)::BIGINT / 1e{9 - places}, 0)::BIGINT"
    return f"printf('%.{places}f', {units} / 1e{places})" if places else f"({units})::VARCHAR"


def _texts_sql() -> str:
    values = {
        "side": "least(bx2 - bx1, by2 - by1)::VARCHAR",
        "share": _shown_sql("least(1.0, fw * fh / (w * h)) * 100", 2),
        "guard": _shown_sql("guard * 100", 1),
        "blur": _shown_sql("blur", 1),
        "clipped": _shown_sql("clip * 100", 0),
        "mean": _shown_sql("gray", 0),
        "yaw": "yaw::VARCHAR",
        "pitch": "pitch::VARCHAR",
        "roll": "roll::VARCHAR",
        "left": _shown_sql("eye_l", 3),
        "right": _shown_sql("eye_r", 3),
    }
    filled = {code: "'" + re.sub(r"\{(\w+)\}", lambda m: f"' || {values[m[1]]} || '", text) + "'" for code, text in reasons.TEXTS.items()}
    return " ".join(f"WHEN '{code}' THEN {text}" for code, text in filled.items())


@query(JUDGED_SQL + f"SELECT item_id, line, part, array_to_string(list_transform(reasons, lambda code: CASE code {_texts_sql()} END), '; ') AS reason FROM judged WHERE len(reasons) > 0")
def quality_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measured(spark, sf_dir).withColumn("bbox", clipped(F.col("raw_bbox"), F.col("image_w"), F.col("image_h")))
    s = replace(SETTINGS, reject_exposure=True)
    return reasons.with_reason_text(quality.with_quality(rows, s).where(F.size("quality_reasons") > 0), s).select("item_id", "line", "part", "reason")


@query(f"WITH {inputs.MEASURED_SQL}, {inputs.CLIPPING_SQL} SELECT item_id, line, part, array_to_string(edge_reasons, ';') AS reasons, round(guard, 6) AS guard FROM clipping")
def edge_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.measured(spark, sf_dir)
    return quality.with_clipping(rows, SETTINGS).select("item_id", "line", "part", F.concat_ws(";", "edge_reasons").alias("reasons"), F.round("guard", 6).alias("guard"))


@query(
    """WITH p AS (SELECT vec_id, unnest(range(1, 20, 2)) AS i, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT vec_id, e[i] AS x, e[i + 1] AS y FROM p),
s AS (SELECT vec_id, var_pop(x) * 10 AS sxx, var_pop(y) * 10 AS syy, covar_pop(x, y) * 10 AS sxy FROM c GROUP BY vec_id)
SELECT vec_id, round(sqrt((sxx + syy - sqrt((sxx - syy) ** 2 + 4 * sxy * sxy)) / (sxx + syy + sqrt((sxx - syy) ** 2 + 4 * sxy * sxy))), 6) AS openness FROM s"""
)
def eye_openness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "embeddings")
    points = F.transform(F.sequence(F.lit(1), F.lit(19), F.lit(2)), lambda i: F.slice("embedding", i, 2))
    return e.select("vec_id", F.round(openness(points), 6).alias("openness"))


# --- names ---


@query(
    """WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || c_custkey || '  ' || c_mktsegment || ' ' || c_name WHEN 1 THEN 'B ' || c_name WHEN 2 THEN c_custkey::VARCHAR ELSE 'ab ' || c_mktsegment END AS stem FROM customer),
s AS (SELECT c_custkey, trim(regexp_replace(stem, '\\s+', ' ', 'g')) AS s FROM n),
d AS (SELECT c_custkey, CASE WHEN regexp_matches(s, '^[0-9]+ .') THEN regexp_replace(s, '^[0-9]+ ', '') WHEN regexp_matches(s, '^[A-Z] .') THEN s[3:] ELSE s END AS display FROM s)
SELECT c_custkey, display, lower(display) AS key FROM d"""
)
def ident_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN concat('  ', c_custkey, '  ', c_mktsegment, ' ', c_name) WHEN 1 THEN concat('B ', c_name) WHEN 2 THEN CAST(c_custkey AS STRING) ELSE concat('ab ', c_mktsegment) END AS stem"
    )
    named = c.select("c_custkey", identifier(F.col("stem")).alias("display"))
    return named.withColumn("key", identity_key(F.col("display")))


@query(
    """WITH n AS (
  SELECT 'r/' || c_custkey || '.jpg' AS path, 'K' || c_custkey % 300 || ' N' || c_custkey % 300 AS base,
         CASE (c_custkey // 300) % 3 WHEN 1 THEN ' portrait' WHEN 2 THEN ' street' ELSE '' END AS more FROM customer)
SELECT path, base || CASE WHEN min(more) OVER b = max(more) OVER b THEN more ELSE '' END AS entity_id FROM n WINDOW b AS (PARTITION BY base)"""
)
def ident_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of files named after customers: the two words that different names share."""
    return identity.group_references(inputs.named_files(spark, sf_dir)).select("path", "entity_id")


@query(
    """WITH s AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages),
t AS (SELECT page_id, CASE WHEN length(name) > 1 THEN regexp_replace(name, '(.)\\.[^.]*$', '\\1') ELSE name END AS stem FROM s)
SELECT page_id, stem, nullif(regexp_extract(stem, '([0-9]+)[^0-9]*$', 1), '')::BIGINT AS number, lower(regexp_replace(stem, '[0-9]+$', '')) AS prefix FROM t"""
)
def sequence_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.table(spark, sf_dir, "pages").select("page_id", stem(F.col("url")).alias("stem"))
    return p.select("page_id", "stem", sequence_number(F.col("stem")).cast("long").alias("number"), sequence_prefix(F.col("stem")).alias("prefix"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN NULL ELSE ts END AS capture_time, event_id % 4 < 2 AS time_is_metadata,
  ('img' || event_id) AS stem_, event_id AS number FROM events"""
)
def capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    items = e.select(
        "event_id",
        F.concat(F.lit("d/img"), "event_id", F.lit(".jpg")).alias("path"),
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).otherwise("broken").alias("exif_original"),
        F.lit(None).cast("string").alias("exif_digitized"),
        F.when(F.col("event_id") % 4 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".5+02:00"))).alias("exif_datetime"),
        F.when(F.col("event_id") % 4 != 2, F.col("ts")).alias("mtime"),
    )
    out = item_order(items)
    number = F.col("seq").cast("long")
    return out.select(number.alias("event_id"), F.col("capture_time").cast("timestamp_ntz").alias("capture_time"), "time_is_metadata", stem(F.col("path")).alias("stem_"), number.alias("number"))


@query(f"WITH {inputs.PAGE_FILES_SQL} SELECT path, parse_filename(path, true) AS stem, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix FROM files WHERE page_id % 4 <> 2")
def file_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(inputs.page_files(spark, sf_dir)).select("path", stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("suffix"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(replace(substr(o_orderdate::VARCHAR, 1, 19), '-', ':'), '^....:..:..') THEN date_trunc('second', o_orderdate) END AS t FROM (SELECT o_orderkey AS c_custkey, o_orderdate FROM orders)")
def camera_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("c_custkey"), camera_time(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz").alias("t"))


@query(
    """WITH h AS (SELECT 'd/img' || event_id || '.jpg' AS path, ts, event_id % 6 IN (0, 1, 2, 4) AS dated FROM events)
SELECT path, CASE WHEN dated THEN date_trunc('second', ts) ELSE ts END AS capture_time, dated AS time_is_metadata FROM h"""
)
def photo_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture times out of the first bytes of files of several kinds, some of them cut or no pictures."""
    files = inputs.photo_files(spark, sf_dir)
    out = item_order(dates_of_heads(files).join(files.select("path", "mtime"), "path"))
    return out.select("path", F.col("capture_time").cast("timestamp_ntz").alias("capture_time"), "time_is_metadata")


@query(
    f"""WITH r AS (SELECT {inputs.RESULT_ENTITY} AS entity, c_custkey::VARCHAR AS photo_id, {inputs.RESULT_PATH_SQL} AS source FROM customer)
SELECT (row_number() OVER (ORDER BY lower(entity), entity, lower(source), source) + 1)::INT AS row_number, entity, photo_id, source, 3 AS width FROM r"""
)
def result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as one ordered file by all tasks, and read back in chunks as a manifest; cells hold quotes, delimiters and line ends."""
    path = f"{shared_path(spark)}/result-{uuid.uuid4().hex}.csv"
    write_single(inputs.results(spark, sf_dir), path, ACCEPTED)
    return read_manifest(spark, path)[0]


@query(
    """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
v AS (SELECT doc_id, ('0x' || substr(h, 2 * i + 1, 2))::INT AS v FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d))
SELECT d.doc_id, count(v) AS samples, round(CASE WHEN count(v) = 0 THEN 1 ELSE count(*) FILTER (WHERE v <= 5 OR v >= 250) / count(v) END, 6) AS clipped, round(coalesce(avg(v), 0), 6) AS gray_mean
FROM d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id"""
)
def exposure_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' bytes as grey samples, in tiles of up to 500 characters."""
    text = F.coalesce("text", F.lit(""))
    starts = F.sequence(F.lit(0), F.char_length(text), F.lit(500))
    tiles = inputs.table(spark, sf_dir, "documents").select("doc_id", text.alias("t"), F.explode(starts).alias("at")).select("doc_id", F.encode(F.substr("t", F.col("at") + 1, F.lit(500)), "UTF-8").alias("grey"))
    return rounded(exposure(tiles, ["doc_id"]), "clipped", "gray_mean")


# --- collection ---

RESOLVED = f"""
WITH {inputs.PAGE_FILES_SQL}, {inputs.MANIFEST_SQL},
folders AS (
  SELECT entity, base, row_number() OVER (PARTITION BY lower(base) ORDER BY lower(entity), entity) AS n
  FROM (SELECT DISTINCT entity, regexp_replace(entity, '[:?]', '_', 'g') AS base FROM manifest WHERE entity <> '')),
by_path AS (
  SELECT m.*, f.path FROM (SELECT *, CASE WHEN source NOT LIKE '../%' THEN replace(source, '\\', '/') END AS wanted FROM manifest) m LEFT JOIN (SELECT path FROM files) f ON m.wanted = f.path),
with_source AS (
  SELECT row_number, entity, photo_id, CASE WHEN width < 2 THEN 'short row' WHEN entity = '' THEN 'empty entity or item' WHEN path IS NULL THEN 'source missing or outside' END AS reason, path FROM by_path),
stems AS (SELECT lower(parse_filename(path, true)) AS stem, list(path) AS paths FROM files GROUP BY 1),
by_stem AS (
  SELECT m.row_number, m.entity, m.photo_id, CASE WHEN width < 2 THEN 'short row' WHEN entity = '' THEN 'empty entity or item' WHEN paths IS NULL THEN 'no such file' WHEN len(paths) > 1 THEN 'several files' END AS reason, paths[1] AS path
  FROM manifest m LEFT JOIN stems s ON lower(m.photo_id) = s.stem)
"""


@query(RESOLVED + "SELECT row_number, entity, photo_id, CASE WHEN reason IS NULL THEN path END AS path, CASE WHEN reason IS NULL THEN 'found' ELSE 'skipped' END AS status, reason FROM with_source")
def manifest_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.resolve(inputs.manifest(spark, sf_dir), inputs.page_files(spark, sf_dir).select("path"), has_source=True)


@query(RESOLVED + "SELECT row_number, entity, photo_id, CASE WHEN reason IS NULL THEN path END AS path, CASE WHEN reason IS NULL THEN 'found' ELSE 'skipped' END AS status, reason FROM by_stem")
def manifest_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.resolve(inputs.manifest(spark, sf_dir), inputs.page_files(spark, sf_dir).select("path"), has_source=False)


@query(
    RESOLVED
    + """,
found AS (
  SELECT w.row_number, w.path, f.base || CASE WHEN f.n > 1 THEN ' (' || f.n || ')' ELSE '' END AS folder, parse_filename(w.path) AS name, parse_filename(w.path, true) AS stem
  FROM with_source w JOIN folders f USING (entity) WHERE reason IS NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(name) ORDER BY row_number) AS k FROM found)
SELECT row_number, path, folder || '/' || CASE WHEN k = 1 THEN name ELSE stem || ' (' || k || ')' || name[length(stem) + 1:] END AS target FROM numbered"""
)
def collect_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = collect.copy_plan(inputs.manifest(spark, sf_dir), inputs.page_files(spark, sf_dir).select("path"), has_source=True)
    return plan.where("status = 'found'").select("row_number", "path", "target")


@query(
    """WITH RECURSIVE wanted AS (
  SELECT *, regexp_extract(name, '^(.*)(\\.[^.]*)$', 1) AS stem, regexp_extract(name, '^(.*)(\\.[^.]*)$', 2) AS ending, row_number() OVER (PARTITION BY folder ORDER BY row_number) AS i
  FROM (SELECT (c_custkey + 1)::INT AS row_number, 'E' || c_custkey % 5 AS folder, """
    + inputs.CLASH_NAME
    + """ AS name, c_custkey FROM customer)),
existing AS (SELECT 'E' || r_regionkey AS folder, unnest(CASE WHEN r_regionkey % 2 = 0 THEN ['a.jpg', 'A (4).jpg'] ELSE ['a.jpg'] END) AS name FROM region),
fold AS (
  SELECT folder, 0::BIGINT AS i, list(lower(name)) AS taken, NULL::VARCHAR AS target, NULL::INT AS row_number, NULL::VARCHAR AS path FROM existing GROUP BY folder
  UNION ALL
  SELECT folder, i, list_append(taken, lower(target)), target, row_number, path FROM (
    SELECT f.folder, w.i, f.taken, w.row_number, 'd' || c_custkey || '/' || name AS path, list_filter(list_transform(range(1, w.i + 5),
        lambda n: stem || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || ending), lambda t: NOT list_contains(f.taken, lower(t)))[1] AS target
    FROM fold f JOIN wanted w ON w.folder = f.folder AND w.i = f.i + 1))
SELECT row_number, path, folder || '/' || target AS target FROM fold WHERE i > 0"""
)
def collect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that clash with each other and with existing files: every target is free when its row comes."""
    rows, there = inputs.clashing(spark, sf_dir)
    return collect.copy_plan(rows, rows.select(F.col("source").alias("path")), has_source=True, existing=there).select("row_number", "path", "target")


@query(RESOLVED + "SELECT count(*) FILTER (WHERE reason IS NULL) AS copied, count(*) FILTER (WHERE reason IS NOT NULL) AS skipped, count(DISTINCT entity) FILTER (WHERE reason IS NULL) AS targets FROM with_source")
def collect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect.collect_summary(manifest_resolve(spark, sf_dir))


@query(
    """WITH e AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'Team: ' || (s_suppkey % 20) WHEN 1 THEN 'team? ' || (s_suppkey % 20 - 1) WHEN 2 THEN s_name || ' .' ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'con.' || s_suppkey ELSE 'Nul' END END AS entity FROM supplier),
b AS (SELECT DISTINCT entity, CASE WHEN entity LIKE 'con.%' OR entity = 'Nul' THEN '_' || entity ELSE rtrim(regexp_replace(entity, '[:?]', '_', 'g'), ' .') END AS base FROM e)
SELECT entity, base || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS folder FROM (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY lower(entity), entity) AS n FROM b)"""
)
def folder_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inputs.table(spark, sf_dir, "supplier").selectExpr(
        "CASE s_suppkey % 4 WHEN 0 THEN concat('Team: ', s_suppkey % 20) WHEN 1 THEN concat('team? ', s_suppkey % 20 - 1) WHEN 2 THEN concat(s_name, ' .') ELSE CASE WHEN s_suppkey % 3 = 0 THEN concat('con.', s_suppkey) ELSE 'Nul' END END AS entity"
    )
    return collect.folder_names(s)
