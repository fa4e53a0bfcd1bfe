from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.boxes import clipped, tile_starts
from lodestone.operators.detections import cap_weak, references_with_one_box, suppress

box = st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 20), st.integers(1, 20), st.integers(1, 5))
SCHEMA = "item_id int, n int, bbox struct<x1:int,y1:int,x2:int,y2:int>, det_score double"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter) if inter else 0.0


def greedy(boxes, threshold):
    kept = []
    for n, b, _ in sorted(boxes, key=lambda x: (-x[2], -(x[1][2] - x[1][0]) * (x[1][3] - x[1][1]), x[0])):
        if all(overlap(b, k) < threshold for _, k in kept):
            kept.append((n, b))
    return {n for n, _ in kept}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(images=st.lists(st.lists(box, max_size=9), min_size=1, max_size=20))
def test_suppression_is_greedy(spark, images):
    rows = [(i, n, (x, y, x + w, y + h), s / 10) for i, boxes in enumerate(images) for n, (x, y, w, h, s) in enumerate(boxes)]
    df = spark.createDataFrame(rows, SCHEMA)
    got: dict[int, set[int]] = {}
    for r in suppress(df, 0.35, "item_id", tie=("n",)).collect():
        got.setdefault(r["item_id"], set()).add(r["n"])
    for i, boxes in enumerate(images):
        assert got.get(i, set()) == greedy([(n, (x, y, x + w, y + h), s / 10) for n, (x, y, w, h, s) in enumerate(boxes)], 0.35)


def test_overlap_of_exactly_the_threshold_suppresses(spark):
    df = spark.createDataFrame([(1, 0, (0, 0, 10, 10), 0.9), (1, 1, (0, 0, 10, 5), 0.8)], SCHEMA)
    assert {r["n"] for r in suppress(df, 0.5, "item_id").collect()} == {0}
    assert {r["n"] for r in suppress(df, 0.51, "item_id").collect()} == {0, 1}


def test_caps_never_touch_strong_boxes(spark):
    rows = [(1, n, (0, 0, 10 + n, 10), 0.05 if n < 4 else 0.9) for n in range(8)]
    kept = cap_weak(spark.createDataFrame(rows, SCHEMA), Settings(rescue_max_candidates=2), "item_id")
    assert {r["n"] for r in kept.collect()} == {2, 3, 4, 5, 6, 7}


def test_a_cap_reads_its_boxes_once(spark):
    rows = [(1, n, (0, 0, 10 + n, 10), 0.05 if n < 4 else 0.9) for n in range(8)] + [(1, 8, (0, 0, 1, 1), None), (None, 9, (0, 0, 1, 1), 0.01)]
    capped = cap_weak(suppress(spark.createDataFrame(rows, SCHEMA), 1.1, "item_id", tie=("n",)), Settings(rescue_max_candidates=1), "item_id")
    assert capped._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert {r["n"] for r in capped.collect()} == {3, 4, 5, 6, 7, 9}


def test_references_need_one_box(spark):
    rows = [(1, 0, (0, 0, 9, 9), 0.9), (2, 0, (0, 0, 9, 9), 0.9), (2, 1, (20, 20, 29, 29), 0.9), (3, 0, (0, 0, 9, 9), 0.1)]
    got = {r["item_id"]: (r["boxes"], r["ok"]) for r in references_with_one_box(spark.createDataFrame(rows, SCHEMA), Settings()).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (0, False)}


def test_ties_decide_how_many_boxes_a_reference_has(spark):
    # the middle box overlaps both others, which do not meet; all are equally strong and large
    left, middle, right = (0, 0, 10, 10), (5, 0, 15, 10), (10, 0, 20, 10)
    rows = [(1, 0, middle, 0.9), (1, 1, left, 0.9), (1, 2, right, 0.9), (2, 0, left, 0.9), (2, 1, middle, 0.9), (2, 2, right, 0.9)]
    s = Settings(nms_iou=0.3)
    got = {r["item_id"]: (r["boxes"], r["ok"]) for r in references_with_one_box(spark.createDataFrame(rows, SCHEMA), s, tie=("n",)).collect()}
    assert got == {1: (1, True), 2: (2, False)}


def test_clipping_goes_to_even_halves_and_refuses_what_is_not_finite(spark):
    rows = [((0.5, 1.5, 2.5, 3.5),), ((-5.0, -5.0, 300.0, 300.0),), ((float("nan"), 0.0, 1.0, 1.0),), ((99.9, 99.9, 99.9, 99.9),)]
    df = spark.createDataFrame(rows, "raw struct<x1:double,y1:double,x2:double,y2:double>")
    got = [r["b"] and tuple(r["b"]) for r in df.select(clipped(F.col("raw"), F.lit(100), F.lit(80)).alias("b")).collect()]
    assert got == [(0, 2, 2, 4), (0, 0, 100, 80), None, (99, 79, 100, 80)]


def test_tiles_cover_the_length(spark):
    df = spark.createDataFrame([(100,), (1400,), (1401,), (5000,)], "n int")
    got = [r["t"] for r in df.select(tile_starts(F.col("n"), 1400, 0.2).alias("t")).collect()]
    assert got == [[0], [0], [0, 1], [0, 1120, 2240, 3360, 3600]]
