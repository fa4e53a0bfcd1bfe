"""Vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; null if that is next to nothing or not finite."""
    norm = F.sqrt(dot(v, v))
    return F.when((norm > 1e-12) & (norm < float("inf")) & ~F.isnan(norm), F.transform(v, lambda x: x.cast("double") / norm))


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors; not clamped."""
    return 1.0 - dot(a, b)


def openness(points: Column) -> Column:
    """Of ten points, the ratio of their spread across to that along; null if a point is missing or they coincide.

    The singular values of the centred points are the roots of their scatter's eigenvalues.
    """
    x = F.transform(points, lambda p: p[0].cast("double"))
    y = F.transform(points, lambda p: p[1].cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    mx, my = total(x) / 10, total(y) / 10
    sxx = total(F.transform(x, lambda v: (v - mx) * (v - mx)))
    syy = total(F.transform(y, lambda v: (v - my) * (v - my)))
    sxy = total(F.zip_with(x, y, lambda a, b: (a - mx) * (b - my)))
    trace, gap = sxx + syy, F.sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)
    finite = (F.abs(trace) < float("inf")) & ~F.isnan(trace)
    return F.when((F.size(points) == 10) & finite & (F.sqrt((trace + gap) / 2) > 1e-6), F.sqrt(F.greatest(trace - gap, F.lit(0.0)) / (trace + gap)))
