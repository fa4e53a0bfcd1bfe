"""Exposure and sharpness of samples, against plain loops."""

import math
import random
from fractions import Fraction

import pytest

from lodestone.operators import samples


def plain_reduced(grey):
    h, w = len(grey), len(grey[0])
    if max(h, w) <= 256:
        return grey
    scale = 256 / max(h, w)
    oh, ow = max(8, int(h * scale)), max(8, int(w * scale))

    def parts(i, size, wanted):
        a, b = Fraction(i * size, wanted), Fraction((i + 1) * size, wanted)
        return [(k, min(b, k + 1) - max(a, k)) for k in range(int(a), min(size, math.ceil(b)))]

    area = Fraction(h * w, oh * ow)
    ys, xs = [parts(i, h, oh) for i in range(oh)], [parts(j, w, ow) for j in range(ow)]
    return [[round(sum(grey[y][x] * p * q for y, p in yp for x, q in xp) / area) for xp in xs] for yp in ys]


def plain_sharpness(grey):
    g = plain_reduced(grey)
    h, w = len(g), len(g[0])
    mirror = lambda k, n: 0 if n == 1 else abs(k) if k < n else 2 * n - 2 - k
    at = lambda y, x: g[mirror(y, h)][mirror(x, w)]
    found = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
    mean = sum(found) / len(found)
    return sum((f - mean) ** 2 for f in found) / len(found)


SIZES = [(1, 1), (1, 5), (5, 1), (2, 2), (7, 9), (256, 3), (300, 20), (20, 515), (257, 40), (512, 4)]


def pictures():
    rng = random.Random(4)
    return [(k, [[rng.choice([0, 3, 5, 6, 100, 249, 250, 255]) for _ in range(w)] for _ in range(h)]) for k, (h, w) in enumerate(SIZES)]


def test_sharpness(spark):
    rows = [(k, bytes(v for line in g for v in line), len(g[0]), len(g), 1.0) for k, g in pictures()]
    rows += [(90, b"", 0, 0, 1.0), (91, None, 3, 3, None), (92, b"abc", 2, 2, None), (93, b"abcd", None, 2, None)]
    df = spark.createDataFrame(rows, "k long, grey binary, width int, height int, blur_score double").repartition(3)
    got = {r["k"]: r["blur_score"] for r in samples.with_sharpness(df).collect()}
    assert {k: got.pop(k) for k in (90, 91, 92, 93)} == dict.fromkeys((90, 91, 92, 93))
    assert got == {k: pytest.approx(plain_sharpness(g), rel=1e-9, abs=1e-9) for k, g in pictures()}
    assert samples.with_sharpness(df.limit(0)).count() == 0


def test_exposure_whole_and_by_tiles(spark):
    whole, tiles = [], []
    for k, g in pictures():
        flat = bytes(v for line in g for v in line)
        whole.append((k, flat))
        tiles += [(k, flat[i : i + 7]) for i in range(0, len(flat), 7)]
    whole += [(90, b""), (91, None)]
    tiles += [(90, b""), (90, None), (91, None)]
    schema = "k long, grey binary"
    got = [sorted(map(tuple, samples.exposure(spark.createDataFrame(rows, schema).repartition(4), ["k"]).collect())) for rows in (whole, tiles)]
    assert got[0] == got[1]
    expected = []
    for k, data in whole:
        n = len(data or b"")
        expected.append((k, n, sum(v <= 5 or v >= 250 for v in data) / n, sum(data) / n) if n else (k, 0, 1.0, 0.0))
    assert got[0] == expected
    assert samples.exposure(spark.createDataFrame([], schema), ["k"]).count() == 0
