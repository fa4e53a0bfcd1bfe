"""The logical inputs of the operators, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings

#: Vectors of the test tables lie far apart, so their queries match with wide thresholds.
SETTINGS = Settings(match_threshold=0.70, anchor_cap=0.64, series_gap_seconds=1200.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as references."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("entity_id"), F.col("vec_id").alias("ref_id"), "embedding")


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the references; the other nine are the observations matched to it."""
    return references(spark, sf_dir).where("ref_id % 10 = 0")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 10 <> 0")
    return e.selectExpr(
        "vec_id AS obs_id",
        "embedding",
        "CAST(0.35 + (vec_id % 7) / 10.0 AS DOUBLE) AS det_score",
        "CASE WHEN vec_id % 11 = 0 THEN 'rescue-full' WHEN vec_id % 5 = 0 THEN 'tile' ELSE 'full' END AS source",
        "filter(array(CASE WHEN vec_id % 13 = 0 THEN 'blur' END, CASE WHEN vec_id % 17 = 0 THEN 'yaw' END), x -> x IS NOT NULL) AS quality_reasons",
        "concat('shoot/img_', lpad(CAST(vec_id % 60 AS STRING), 2, '0'), '.jpg') AS path",
    )


OBSERVATIONS_SQL = """
vectors AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e
  FROM embeddings),
refs AS (SELECT label::VARCHAR AS entity_id, vec_id AS ref_id, e FROM vectors),
gallery AS (SELECT * FROM refs WHERE ref_id % 10 = 0),
obs AS (
  SELECT vec_id AS obs_id, e, 0.35 + (vec_id % 7) / 10.0 AS det_score,
         CASE WHEN vec_id % 11 = 0 THEN 'rescue-full' WHEN vec_id % 5 = 0 THEN 'tile' ELSE 'full' END AS source,
         list_filter([CASE WHEN vec_id % 13 = 0 THEN 'blur' END, CASE WHEN vec_id % 17 = 0 THEN 'yaw' END], lambda x: x IS NOT NULL) AS reasons,
         'shoot/img_' || lpad((vec_id % 60)::VARCHAR, 2, '0') || '.jpg' AS path
  FROM vectors WHERE vec_id % 10 <> 0)
"""


def frames(spark: SparkSession, sf_dir: str, *, numbered: bool = True) -> DataFrame:
    """events as frames: an entity is a type, a folder is a day; numbered: every event has a number, else a third have none and some no time of their own."""
    seq = "CAST(event_id AS DECIMAL(38,0))" if numbered else "CAST(CASE WHEN event_id % 3 <> 0 THEN event_id END AS DECIMAL(38,0))"
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS entity_id",
        "concat(CAST(date(ts) AS STRING), '/e', event_id) AS path",
        "CAST(date(ts) AS STRING) AS dir",
        "concat('e', event_id) AS name",
        "ts AS capture_time",
        "true AS time_is_metadata" if numbered else "event_id % 5 <> 0 AS time_is_metadata",
        f"{seq} AS seq",
        "'e' AS prefix",
        "CAST((event_id % 45) / 100.0 AS DOUBLE) AS distance",
        "CAST((user_id % 100) / 100.0 AS DOUBLE) AS det_score",
        "CASE WHEN event_id % 9 <> 0 THEN value END AS blur_score",
        "CAST(CASE WHEN user_id % 7 <> 0 THEN (user_id % 100) / 400.0 END AS DOUBLE) AS eye_left",
        "CAST((event_id % 90) / 360.0 AS DOUBLE) AS eye_right",
        "CASE WHEN event_id % 11 <> 0 THEN named_struct('pitch', CAST(event_id % 50 - 25 AS DOUBLE), 'yaw', CAST(user_id % 80 - 40 AS DOUBLE), 'roll', CAST(event_id % 30 - 15 AS DOUBLE)) END AS pose",
    )


def frames_sql(*, numbered: bool = True) -> str:
    seq, meta = ("event_id", "true") if numbered else ("CASE WHEN event_id % 3 <> 0 THEN event_id END", "event_id % 5 <> 0")
    return f"""
frames AS (
  SELECT event_type AS entity_id, ts::DATE::VARCHAR || '/e' || event_id AS path, ts::DATE::VARCHAR AS dir, 'e' || event_id AS name,
         epoch_us(ts) AS micros, {meta} AS meta, {seq} AS seq,
         (event_id % 45) / 100.0 AS distance, (user_id % 100) / 100.0 AS det_score,
         CASE WHEN event_id % 9 <> 0 THEN value END AS blur_score,
         CASE WHEN user_id % 7 <> 0 THEN (user_id % 100) / 400.0 END AS eye_left, (event_id % 90) / 360.0 AS eye_right,
         event_id % 11 <> 0 AS posed, event_id % 50 - 25 AS pitch, user_id % 80 - 40 AS yaw, event_id % 30 - 15 AS roll
  FROM events)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as suppressed boxes: an order is an image."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS item_id",
        "l_linenumber AS line",
        "l_partkey AS part",
        "l_suppkey AS supp",
        "named_struct('x1', CAST((l_partkey * 7 + l_linenumber * 13) % 200 AS INT), 'y1', CAST(l_suppkey * 11 % 150 AS INT), 'x2', CAST((l_partkey * 7 + l_linenumber * 13) % 200 + 40 + l_partkey % 90 AS INT), 'y2', CAST(l_suppkey * 11 % 150 + 40 + l_partkey % 60 AS INT)) AS bbox",
        "round(l_discount * 5 + l_tax, 6) AS det_score",
    )


BOXES_SQL = """
boxes AS (
  SELECT l_orderkey AS item_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
         (l_partkey * 7 + l_linenumber * 13) % 200 AS x1, l_suppkey * 11 % 150 AS y1,
         (l_partkey * 7 + l_linenumber * 13) % 200 + 40 + l_partkey % 90 AS x2, l_suppkey * 11 % 150 + 40 + l_partkey % 60 AS y2,
         round(l_discount * 5 + l_tax, 6) AS det_score
  FROM lineitem)
"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as observations with quality metrics."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS item_id",
        "l_linenumber AS line",
        "l_partkey AS part",
        "CAST(1000 + l_partkey % 5 * 200 AS INT) AS image_w",
        "CAST(800 + l_suppkey % 7 * 100 AS INT) AS image_h",
        "l_extendedprice % 1100 - 20.5D AS rx",
        "l_partkey * 3 % 900 - 10.5D AS ry",
        "20 + l_quantity * 4 AS rw",
        "24 + l_quantity * 5.5D AS rh",
        "CASE WHEN l_linenumber <> 7 THEN l_extendedprice % 120 END AS blur_score",
        "l_discount * 7 AS clipped",
        "CAST(l_partkey % 256 AS DOUBLE) AS gray_mean",
        "CASE WHEN l_partkey % 11 <> 0 THEN named_struct('pitch', CAST(l_partkey % 100 - 50 AS DOUBLE), 'yaw', CAST(l_suppkey % 120 - 60 AS DOUBLE), 'roll', CAST(l_orderkey % 100 - 50 AS DOUBLE)) END AS pose",
        "CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_partkey % 40 / 100.0 AS DOUBLE) END AS eye_left",
        "CAST(l_suppkey % 40 / 100.0 AS DOUBLE) AS eye_right",
    ).withColumn("raw_bbox", F.struct(F.col("rx").alias("x1"), F.col("ry").alias("y1"), (F.col("rx") + F.col("rw")).alias("x2"), (F.col("ry") + F.col("rh")).alias("y2")))


MEASURED_SQL = """
m0 AS (
  SELECT l_orderkey AS item_id, l_linenumber AS line, l_partkey AS part, 1000 + l_partkey % 5 * 200 AS w, 800 + l_suppkey % 7 * 100 AS h,
         l_extendedprice % 1100 - 20.5 AS x1, l_partkey * 3 % 900 - 10.5 AS y1, 20 + l_quantity * 4 AS rw, 24 + l_quantity * 5.5 AS rh,
         CASE WHEN l_linenumber <> 7 THEN l_extendedprice % 120 END AS blur, l_discount * 7 AS clip, (l_partkey % 256)::DOUBLE AS gray,
         l_partkey % 11 <> 0 AS posed, l_partkey % 100 - 50 AS pitch, l_suppkey % 120 - 60 AS yaw, l_orderkey % 100 - 50 AS roll,
         CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 40 / 100.0 END AS eye_l, l_suppkey % 40 / 100.0 AS eye_r
  FROM lineitem),
m1 AS (SELECT *, (x1 + rw)::DOUBLE AS x2, (y1 + rh)::DOUBLE AS y2 FROM m0),
m2 AS (SELECT *, greatest(x2 - x1, 1) AS fw, greatest(y2 - y1, 1) AS fh FROM m1),
m AS (
  SELECT *, greatest(0, least(w - 1, round_even(x1, 0)))::BIGINT AS bx1, greatest(0, least(h - 1, round_even(y1, 0)))::BIGINT AS by1,
         greatest(0.008, least(0.05, 0.02 * pow(0.015 / greatest(1e-8, least(1.0, fw * fh / (w * h))), 0.5))) AS guard
  FROM m2)
"""

CLIPPING_SQL = """
edges AS (
  SELECT *, list_filter([
    CASE WHEN y1 < -greatest(2, fh * 0.015) THEN 'cut_top' END,
    CASE WHEN x1 < -greatest(2, fw * 0.015) OR x2 > w + greatest(2, fw * 0.015) THEN 'cut_side' END,
    CASE WHEN y2 > h + greatest(2, fh * 0.015) THEN 'cut_bottom' END,
    CASE WHEN greatest(0, y1) < fh * 0.18 THEN 'tight_top' END,
    CASE WHEN least(greatest(0, x1), greatest(0, w - x2)) < fw * 0.07 THEN 'tight_side' END,
    CASE WHEN greatest(0, h - y2) < fh * 0.03 THEN 'tight_bottom' END], lambda x: x IS NOT NULL) AS direct,
  list_filter([
    CASE WHEN least(x1 - fw * 0.07, w - (x2 + fw * 0.07)) < w * guard THEN 'guard_side' END,
    CASE WHEN y1 - fh * 0.18 < h * guard THEN 'guard_top' END,
    CASE WHEN h - (y2 + fh * 0.03) < h * guard THEN 'guard_bottom' END], lambda x: x IS NOT NULL) AS guarded
  FROM m),
clipping AS (SELECT *, CASE WHEN len(direct) > 0 THEN direct ELSE guarded END AS edge_reasons FROM edges)
"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: paths with numbers, some without a suffix or of a document's."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "concat(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+/[0-9]+)', 1), CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '' WHEN 2 THEN '.txt' ELSE '.x' END) AS path")


PAGE_FILES_SQL = """
files AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+/[0-9]+)', 1) || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '' WHEN 2 THEN '.txt' ELSE '.x' END AS path
  FROM pages)
"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files(spark, sf_dir).selectExpr(
        "CAST(page_id + 2 AS INT) AS row_number",
        "CASE WHEN page_id % 21 = 0 THEN '' ELSE concat('Team', CASE WHEN page_id % 2 = 0 THEN ': ' ELSE '? ' END, page_id % 5) END AS entity",
        "regexp_extract(path, '/([0-9]+)', 1) AS photo_id",
        "CASE WHEN page_id % 9 = 0 THEN concat('../', path) WHEN page_id % 6 = 0 THEN replace(path, '/', '\\\\') ELSE path END AS source",
        "CASE WHEN page_id % 33 = 0 THEN 1 ELSE 3 END AS width",
    )


MANIFEST_SQL = """
manifest AS (
  SELECT (page_id + 2)::INT AS row_number,
         CASE WHEN page_id % 21 = 0 THEN '' ELSE 'Team' || CASE WHEN page_id % 2 = 0 THEN ': ' ELSE '? ' END || (page_id % 5) END AS entity,
         regexp_extract(path, '/([0-9]+)', 1) AS photo_id,
         CASE WHEN page_id % 9 = 0 THEN '../' || path WHEN page_id % 6 = 0 THEN replace(path, '/', '\\') ELSE path END AS source,
         CASE WHEN page_id % 33 = 0 THEN 1 ELSE 3 END AS width
  FROM files)
"""

CLASH_NAME = "CASE c_custkey % 7 WHEN 0 THEN 'a.jpg' WHEN 1 THEN 'A.JPG' WHEN 2 THEN 'a (2).jpg' WHEN 3 THEN concat('a (', c_custkey % 40, ').jpg') WHEN 4 THEN 'b.jpg' WHEN 5 THEN 'a (2) (2).jpg' ELSE 'b (3).x' END"


def clashing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, existing): customers as files of five entities whose names clash, also when numbered, and files that stand in their folders already."""
    rows = table(spark, sf_dir, "customer").selectExpr("CAST(c_custkey + 1 AS INT) AS row_number", "concat('E', c_custkey % 5) AS entity", "CAST(c_custkey AS STRING) AS photo_id", f"concat('d', c_custkey, '/', {CLASH_NAME}) AS source", "3 AS width")
    there = table(spark, sf_dir, "region").selectExpr("concat('E', r_regionkey) AS folder", "explode(IF(r_regionkey % 2 = 0, array('a.jpg', 'A (4).jpg'), array('a.jpg'))) AS name")
    return rows, there


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reference files: two words name one of 300 entities, some files have a third word or an index."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('r/', c_custkey, '.jpg') AS path",
        "concat(CASE WHEN c_custkey % 2 = 0 THEN concat(c_custkey, ' ') ELSE '' END, 'K', c_custkey % 300, ' N', c_custkey % 300, CASE CAST(c_custkey / 300 AS INT) % 3 WHEN 1 THEN ' portrait' WHEN 2 THEN ' street' ELSE '' END) AS stem",
    )


def frame_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(full, tiled): boxes of whole frames, and boxes in the coordinates of a tile; some landmarks are broken."""
    raw = F.struct(*[F.col(f"bbox.{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    point = F.array(F.when(F.col("part") % 13 == 0, float("nan")).otherwise(1.0), F.lit(2.0))
    kps = F.when(F.col("part") % 17 == 0, F.array(*[point] * 4)).otherwise(F.array(*[point] * 5))
    rows = boxes(spark, sf_dir).withColumns({"raw_bbox": raw, "kps": kps, "image_w": F.lit(500), "image_h": F.lit(300)}).drop("bbox")
    tiled = rows.where("supp % 2 = 1").withColumns({"source": F.lit("tile"), "x": F.col("line") % 3 * 100, "y": F.col("part") % 2 * 80, "w": F.lit(240), "h": F.lit(200)})
    return rows.where("supp % 2 = 0").withColumn("source", F.lit("full")), tiled


def photo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, head, mtime: events as the first bytes of picture files that hold their times, of six kinds by turns."""
    text = F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss").cast("binary"), F.unhex(F.lit("00")))
    raw = lambda digits: F.unhex(F.lit(digits.replace(" ", "")))
    small = F.concat(raw("49492A00 08000000 0100 3201 0200 14000000 1A000000 00000000"), text)
    big = F.concat(raw("4D4D002A 00000008 0001 9003 0002 00000014 0000001A 00000000"), text)
    pointing = F.concat(raw("49492A00 08000000 0100 6987 0400 01000000 1A000000 00000000 0100 0490 0200 14000000 2C000000 00000000"), text)
    jpeg = F.concat(raw("FFD8 FFE0 0004 0000 FFE1 0036 457869660000"), big, raw("FFDA0002"))
    png = F.concat(raw("89504E470D0A1A0A 00000003 49444154 010203 00000000 0000002E 65584966"), small, raw("00000000"))
    kinds = [small, jpeg, pointing, F.substring(jpeg, 1, 40), png, F.lit("no picture").cast("binary")]
    head = F.coalesce(*[F.when(F.col("event_id") % len(kinds) == k, head) for k, head in enumerate(kinds)])
    return table(spark, sf_dir, "events").select(F.concat(F.lit("d/img"), "event_id", F.lit(".jpg")).alias("path"), head.alias("head"), F.col("ts").alias("mtime"))


RESULT_ENTITY = "concat(CASE c_custkey % 3 WHEN 0 THEN 'Team; ' WHEN 1 THEN 'team ' ELSE 'A \"B\" ' END, c_custkey % 40)"
RESULT_PATH_SQL = "concat('d', c_custkey % 7, CASE c_custkey % 4 WHEN 0 THEN '/x\";' || chr(10) || 'y ' ELSE '/IMG ' END, c_custkey, '.jpg')"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as accepted rows."""
    path = F.concat(F.lit("d"), F.col("c_custkey") % 7, F.when(F.col("c_custkey") % 4 == 0, '/x";\ny ').otherwise("/IMG "), "c_custkey", F.lit(".jpg"))
    return table(spark, sf_dir, "customer").select(F.expr(RESULT_ENTITY.replace("\"", "\\\"")).alias("entity_id"), F.col("c_custkey").cast("string").alias("photo_id"), path.alias("path"))
