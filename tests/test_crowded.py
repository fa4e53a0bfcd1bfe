import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import crowded
from lodestone.operators.crowded import dealt, suppress_any, suppress_in_rounds
from tests.test_boxes import SCHEMA, greedy


def frame(spark, images):
    return spark.createDataFrame([(i, n, b, float(s)) for i, boxes in images.items() for n, b, s in boxes], SCHEMA)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["item_id"], []).append(r["n"])
    return {i: sorted(ns) for i, ns in out.items()}


def random_boxes(rng, n, room, sides):
    out = []
    for i in range(n):
        x, y, w, h = rng.randrange(room), rng.randrange(room), rng.choice(sides), rng.choice(sides)
        out.append((i, (x, y, x + w, y + h), rng.randrange(50)))
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.35, 0.6])
def test_rounds_are_the_greedy_fold(spark, threshold):
    rng = random.Random(3)
    images = {
        1: random_boxes(rng, 1200, 300, [9, 10, 12, 15]),
        2: random_boxes(rng, 1200, 2000, [1, 3, 40, 300, 900]),
        3: random_boxes(rng, 300, 4, [6, 7, 8]),  # one pile, with equal boxes
        None: random_boxes(rng, 20, 20, [5]),
    }
    got = found(suppress_in_rounds(frame(spark, images), threshold, "item_id", tie=("n",)))
    assert got == {i: sorted(greedy(boxes, threshold)) for i, boxes in images.items()}


def test_a_chain_through_many_blocks(spark):
    chain = [(n, (4 * n, 0, 4 * n + 10, 10), 5000 - n) for n in range(1500)]
    got = found(suppress_in_rounds(frame(spark, {1: chain}), 0.4, "item_id", tie=("n",)))
    assert got == {1: list(range(0, 1500, 2))}


def test_small_and_large_images_together(spark):
    rng = random.Random(5)
    images = {i: random_boxes(rng, n, 60, [8, 9, 11]) for i, n in enumerate((3, 40, 400, 1))}
    df = frame(spark, images)
    want = {i: sorted(greedy(boxes, 0.35)) for i, boxes in images.items()}
    assert found(suppress_any(df, 0.35, "item_id", tie=("n",), folded=50)) == want
    assert found(suppress_any(df, 0.35, "item_id", tie=("n",))) == want


def test_boxes_without_an_area_and_odd_thresholds(spark):
    df = frame(spark, {1: [(0, (5, 5, 5, 9), 1), (1, (5, 5, 5, 9), 1), (2, None, 1), (3, (0, 0, 4, 4), 2), (4, (0, 0, 4, 4), 1)]})
    assert found(suppress_in_rounds(df, 1.0, "item_id", tie=("n",))) == {1: [0, 1, 2, 3]}
    assert found(suppress_in_rounds(df, 1.1, "item_id")) == {1: [0, 1, 2, 3, 4]}
    assert suppress_in_rounds(df.limit(0), 0.5, "item_id").collect() == []
    with pytest.raises(ValueError, match="above zero"):
        suppress_in_rounds(df, 0.0, "item_id")


def test_blocks_without_boxes_of_their_own_get_none(spark):
    # boxes of one size: what larger and smaller levels would hold is all foreign
    rows = [(n, "1", 400.0 * (n % 60), 300.0 * (n // 60), 400.0 * (n % 60) + 100, 300.0 * (n // 60) + 90, False) for n in range(3600)]
    spread = dealt(spark.createDataFrame(rows, "place long, image string, x1 double, y1 double, x2 double, y2 double, kept boolean"), 0.35, 0)
    blocks = spread.groupBy("level", "bx", "by").agg(F.count("place").alias("n"), F.max("own").alias("own")).collect()
    assert all(b["own"] for b in blocks if b["n"] > 20)
    assert max(b["n"] for b in blocks) < 500


def test_a_box_is_dealt_to_one_cell(spark):
    rng = random.Random(7)
    rows = [(n, "1", float(x), float(y), float(x + rng.choice((3, 40, 500))), float(y + 30), False) for n in range(500) for x, y in [(rng.randrange(9000), rng.randrange(9000))]]
    spread = dealt(spark.createDataFrame(rows, "place long, image string, x1 double, y1 double, x2 double, y2 double, kept boolean"), 0.35, 0)
    assert sorted(r["place"] for r in spread.collect()) == list(range(500))


def test_only_boxes_that_wait_are_written_again(spark, monkeypatch):
    rng = random.Random(8)
    sheet = [(i, (x, y, x + rng.randrange(40, 130), y + rng.randrange(40, 100)), rng.randrange(50)) for i in range(2400) for x, y in [(400 * (i // 4 % 25) + rng.randrange(200), 300 * (i // 100) + rng.randrange(150))]]
    rows = []

    def counted(df, *args, **options):
        rows.append((table := written(df, *args, **options)).count())
        return table

    written = crowded.written
    monkeypatch.setattr(crowded, "written", counted)
    assert found(suppress_in_rounds(frame(spark, {1: sheet}), 0.35, "item_id", tie=("n",))) == {1: sorted(greedy(sheet, 0.35))}
    assert sum(rows) < 1.3 * len(sheet)


@pytest.mark.parametrize("threshold", [0.35, 0.6])
def test_grids_alone_are_the_greedy_fold(spark, threshold):
    rng = random.Random(9)
    images = {
        1: random_boxes(rng, 600, 500, [1, 2, 3, 5]),
        2: random_boxes(rng, 500, 1500, [2, 3, 40, 300]),
        3: [(n, (128 * (n % 3) - 2, 85 * (n % 5) - 2, 128 * (n % 3) + 2, 85 * (n % 5) + 2), n % 7) for n in range(300)],  # equal boxes, at borders
        4: [(n, (2 * n, 0, 2 * n + 5, 5), 5000 - n) for n in range(400)],  # a chain
    }
    images[5] = [(n, tuple(c - 1000 for c in b), s) for n, b, s in images[1]]
    got = found(suppress_in_rounds(frame(spark, images), threshold, "item_id", tie=("n",), full=0))
    assert got == {i: sorted(greedy(boxes, threshold)) for i, boxes in images.items()}


def test_columns_named_like_the_steps_own(spark):
    rng = random.Random(10)
    boxes = random_boxes(rng, 200, 100, [8, 9, 11])
    df = frame(spark, {1: boxes}).select("*", *[F.lit(k).alias(c) for k, c in enumerate(("x1", "y2", "image", "own", "level", "bx", "h", "r", "kept", "_s"))])
    kept = suppress_in_rounds(df, 0.35, "item_id", tie=("n",))
    assert kept.columns == df.columns
    assert found(kept) == {1: sorted(greedy(boxes, 0.35))}
    assert {tuple(r)[4:] for r in kept.collect()} == {tuple(range(10))}
