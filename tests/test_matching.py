import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.vectors import openness, unit
from lodestone.operators import matching
from lodestone.operators.quality import with_quality
from lodestone.plans.run import analyse, summary, write

S = Settings(match_threshold=0.5, ambiguity_margin=0.04)


def vectors(spark, rows, key, id_type="string"):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows], f"{key} {id_type}, embedding array<float>")


def test_one_entity_has_no_margin(spark):
    g = vectors(spark, [("a", (1, 0)), ("a", (0, 1))], "entity_id")
    o = vectors(spark, [(1, (1, 0)), (2, (-1, -1)), (3, (0, 0))], "obs_id", "long")
    got = {r["obs_id"]: (r["best_id"], r["second_id"], r["problem"]) for r in matching.match(o, g, S).collect()}
    assert got == {1: ("a", None, None), 2: ("a", None, "distance")}


def test_distance_is_told_before_margin(spark):
    g = vectors(spark, [("a", (1, 0)), ("b", (1, 0.01))], "entity_id")
    o = vectors(spark, [(1, (1, 0)), (2, (0, 1))], "obs_id", "long")
    got = {r["obs_id"]: r["problem"] for r in matching.match(o, g, S).collect()}
    assert got == {1: "margin", 2: "distance"}


def test_blocks_of_a_large_gallery_agree_with_one(spark, monkeypatch):
    rng = np.random.default_rng(0)
    g = vectors(spark, [(f"e{i % 9}", v) for i, v in enumerate(rng.normal(size=(60, 8)))], "entity_id")
    o = vectors(spark, list(enumerate(rng.normal(size=(40, 8)))), "obs_id", "long")
    whole = sorted(map(tuple, matching.top2(o, g).collect()))
    monkeypatch.setattr(matching, "GALLERY_BYTES", 1000)
    blocks = sorted(map(tuple, matching.top2(o, g).collect()))
    assert [(r[0], r[1], r[3]) for r in whole] == [(r[0], r[1], r[3]) for r in blocks]
    assert np.allclose([r[2] for r in whole], [r[2] for r in blocks])


def test_an_empty_gallery_matches_nothing(spark):
    g = vectors(spark, [], "entity_id")
    o = vectors(spark, [(1, (1, 0))], "obs_id", "long")
    assert matching.match(o, g, S).collect() == []


def test_openness_is_the_ratio_of_singular_values(spark):
    p = np.random.default_rng(1).normal(size=(10, 2))
    sv = np.linalg.svd(p - p.mean(axis=0), compute_uv=False)
    df = spark.createDataFrame([(p.tolist(),), ([[1.0, 1.0]] * 10,), ([[1.0, 2.0]] * 9,)], "p array<array<double>>")
    got = [r["o"] for r in df.select(openness(F.col("p")).alias("o")).collect()]
    assert got[0] == pytest.approx(sv[1] / sv[0])
    assert got[1:] == [None, None]


def test_vectors_without_direction_have_no_unit(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],)], "v array<float>")
    assert [r["u"] for r in df.select(unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], None, None, None]


OBS = (
    "obs_id long, path string, error string, embedding array<float>, image_w int, image_h int, bbox struct<x1:int,y1:int,x2:int,y2:int>, raw_bbox struct<x1:double,y1:double,x2:double,y2:double>, "
    "det_score double, source string, blur_score double, clipped double, gray_mean double, eye_left double, eye_right double, pose struct<pitch:double,yaw:double,roll:double>"
)


def observation(i, path, v, box=(400, 400, 500, 520), error=None, **m):
    d = {"score": 0.9, "source": "full", "blur": 90.0, "left": 0.3, "right": 0.3, "pose": (0.0, 0.0, 0.0)} | m
    return (i, path, error, [float(x) for x in v], 1000, 1000, box, tuple(map(float, box)), d["score"], d["source"], d["blur"], 0.1, 100.0, d["left"], d["right"], d["pose"])


def test_missing_metrics_give_no_reason_and_order_is_kept(spark):
    nan = float("nan")
    rows = [
        observation(1, "p", (1, 0), blur=None, left=None, right=0.0, pose=None),
        observation(2, "p", (1, 0), blur=nan, pose=(nan, 90.0, 0.0)),
        observation(3, "p", (1, 0), box=(0, 400, 30, 430), blur=1.0, left=0.0, pose=(40.0, 50.0, 60.0)),
    ]
    got = {r["obs_id"]: r["quality_reasons"] for r in with_quality(spark.createDataFrame(rows, OBS), Settings()).collect()}
    assert got == {1: [], 2: [], 3: ["small", "tight_side", "blur", "yaw", "pitch", "roll", "eyes"]}


def test_whole_run(spark, tmp_path):
    rows = [
        observation(1, "d/i1.jpg", (1, 0.1)),
        observation(2, "d/i1.jpg", (1, 0.3)),
        observation(3, "d/i2.jpg", (1, 0.2), blur=1.0),
        observation(4, "d/i3.jpg", (1, -1.3)),
        observation(5, "d/i4.jpg", (0, 0), error="unreadable"),
        observation(6, "d/i1.jpg", (1, 0.0), blur=1.0),
    ]
    g = vectors(spark, [("a", (1, 0)), ("b", (-1, 0))], "entity_id")
    order = spark.sql("SELECT concat('d/i', id, '.jpg') AS path, 'd' AS dir, concat('i', id) AS name, timestamp_seconds(id) AS capture_time, true AS time_is_metadata, CAST(id AS DECIMAL(38,0)) AS seq, 'i' AS prefix FROM range(1, 9)")
    out = analyse(spark.createDataFrame(rows, OBS), g, Settings(match_threshold=0.35), order=order)
    assert [(r["entity_id"], r["path"], r["obs_id"]) for r in out.accepted.collect()] == [("a", "d/i1.jpg", 1)]
    assert [(r["path"], r["reason"]) for r in out.rejected.collect()] == [("d/i2.jpg", "blur")]
    assert [r["obs_id"] for r in out.review.collect()] == [4]
    assert [(r["path"], r["series_size"]) for r in out.best.collect()] == [("d/i1.jpg", 1)]
    assert out.errors.count() == 1
    write(out, tmp_path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["result.csv", "result_best.csv", "result_rejected.csv", "result_review.csv"]
    assert (tmp_path / "result.csv").read_text("utf-8-sig").splitlines()[1] == "a;i1;d/i1.jpg"
    row = summary(out, Settings(match_threshold=0.35)).first()
    assert (row["accepted"], row["rejected"], row["review"], row["errors"]) == (1, 1, 1, 1)


def test_farthest_references_of_a_whole_table(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("CAST(label AS STRING) AS entity_id", "vec_id AS ref_id", "embedding")
    rows = e.collect()
    expected = {}
    for entity in {r["entity_id"] for r in rows}:
        mine = sorted((r["ref_id"], r["embedding"]) for r in rows if r["entity_id"] == entity)
        v = np.array([x for _, x in mine], float)
        v /= np.linalg.norm(v, axis=1)[:, None]
        pairs = [(round(float(1 - v[i] @ v[j]), 9), mine[i][0], mine[j][0]) for i in range(len(mine)) for j in range(i + 1, len(mine))]
        if pairs:
            d = max(p[0] for p in pairs)
            expected[entity] = (len(mine), d, {p[1:] for p in pairs if p[0] == d})
    found = matching.reference_consistency(e, Settings(), block=7)
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()  # blocks, no join of pairs
    got = {r["entity_id"]: r for r in found.collect()}
    assert got.keys() == expected.keys()
    for entity, (refs, d, pairs) in expected.items():
        r = got[entity]
        assert r["refs"] == refs and abs(r["worst_dist"] - d) < 1e-8 and (r["ref_a"], r["ref_b"]) in pairs


@pytest.mark.parametrize("limit", [128 << 20, 16])
def test_vectors_of_other_lengths_match_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "GALLERY_BYTES", limit)
    g = vectors(spark, [("a", (1, 0)), ("b", (0, 1)), ("c", (1, 0, 0, 0))], "entity_id")
    o = vectors(spark, [(1, (1, 0, 0)), (2, (1, 0.1)), (3, ()), (4, (float("nan"), 1))], "obs_id", "long")
    assert [(r["obs_id"], r["best_id"], r["second_id"]) for r in matching.top2(o, g).collect()] == [(2, "a", "b")]
