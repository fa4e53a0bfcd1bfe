"""Series against a plain form of their rules."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from lodestone.config import Settings
from lodestone.operators import series

SCHEMA = (
    "entity_id string, path string, dir string, name string, capture_time timestamp, time_is_metadata boolean, seq decimal(38,0), prefix string, distance double, det_score double, "
    "blur_score double, eye_left double, eye_right double, pose struct<pitch:double,yaw:double,roll:double>"
)
S = Settings(series_gap_seconds=12.0)


def frame(entity, d, name, t, seq, prefix="img", meta=True, **m):
    at = datetime(2024, 1, 1) + timedelta(seconds=t)
    return (entity, f"{d}/{name}", d, name, at, meta, None if seq is None else Decimal(seq), prefix, m.get("distance", 0.2), m.get("det", 0.5), m.get("blur"), m.get("left"), m.get("right"), m.get("pose"))


def plain_split(rows):
    by_entity, targets, info = {}, {}, {}
    for r in rows:
        by_entity.setdefault(r[0], []).append(r)
        targets.setdefault(r[1], set()).add(r[0])
        info[r[1]] = r
    big = 10**15
    out = {}
    for entity, own in by_entity.items():
        numbered = [r for r in own if r[6] is not None]
        mode = len(own) > 1 and len(numbered) >= 0.8 * len(own) and len({(r[2].lower(), r[7]) for r in numbered}) == 1 and max(r[6] for r in numbered) - min(r[6] for r in numbered) <= 5000
        key = (lambda r: (r[6] if r[6] is not None else big, r[4], r[3].lower(), r[1])) if mode else (lambda r: (r[4], r[6] if r[6] is not None else big, r[1].lower(), r[1]))
        own = sorted(own, key=key)
        index = 1
        out[entity, own[0][1]] = 1
        for p, c in zip(own, own[1:], strict=False):
            ok = p[2] == c[2]
            both = p[6] is not None and c[6] is not None
            if both:
                ok &= p[7] == c[7] and 0 < c[6] - p[6] <= S.series_gap_numbers
            if (p[5] and c[5]) or not both:
                ok &= max(0.0, (c[4] - p[4]).total_seconds()) <= S.series_gap_seconds
            if ok:
                counts = {}
                for path, r in info.items():
                    if path in (p[1], c[1]) or entity in targets[path]:
                        continue
                    if both and p[7] == c[7] and p[6] < c[6]:
                        inside = r[2].lower() == p[2].lower() and r[7] == p[7] and r[6] is not None and p[6] < r[6] < c[6]
                    else:
                        inside = r[2] == p[2] and min(p[4], c[4]) < r[4] < max(p[4], c[4])
                    for t in targets[path] if inside else ():
                        counts[t] = counts.get(t, 0) + 1
                ok = not any(n >= S.foreign_frames for n in counts.values())
            index += not ok
            out[entity, c[1]] = index
    return out


@pytest.mark.parametrize("seed", range(6))
def test_split_follows_the_rules(spark, seed):
    rng = random.Random(seed)
    rows, seen = [], set()
    for d in ("a", "b"):
        t = 0.0
        for n in range(60):
            t += rng.choice([0.5, 1.0, 2.0, 6.0, 13.0])
            seq = n if rng.random() < (1.0 if seed % 3 == 0 else 0.7) else None
            name = f"img{n:03d}"
            meta = rng.random() < (0.5 if seed % 2 else 1.0)
            for e in rng.sample("xyz", rng.choice([1, 1, 1, 2])):
                if (e, d, name) not in seen and (d == "a" or seed % 3):
                    seen.add((e, d, name))
                    rows.append(frame(e, d, name, t if rng.random() < 0.97 else t - 40, seq, meta=meta))
    # a path has one time and one number, whoever it shows
    first = {}
    rows = [(r[0], *first.setdefault(r[1], r[1:])) for r in rows]
    got = {(r["entity_id"], r["path"]): r["series_index"] for r in series.split(spark.createDataFrame(rows, SCHEMA), S).collect()}
    assert got == plain_split(rows)


def test_foreign_frames_break_only_if_one_entity_has_two(spark):
    a = [frame("a", "d", "i1", 0, 1), frame("a", "d", "i4", 1, 4)]
    two = [frame("b", "d", "i2", 0.3, 2), frame("b", "d", "i3", 0.6, 3)]
    each = [frame("b", "d", "i2", 0.3, 2), frame("c", "d", "i3", 0.6, 3)]
    count = lambda rows: max(r["series_index"] for r in series.split(spark.createDataFrame(rows, SCHEMA), S).where("entity_id = 'a'").collect())
    assert count(a + two) == 2
    assert count(a + each) == 1
    assert count(a + two + [frame("a", "d", "i2", 0.3, 2)]) == 1


@pytest.mark.parametrize("foreign_frames", [1, 2, 3])
def test_frames_without_numbers_go_back_in_time(spark, foreign_frames, monkeypatch):
    """An entity ordered by numbers has its own frames between two times, so runs of others are counted path by path there."""
    monkeypatch.setattr("tests.test_series.S", Settings(series_gap_seconds=5000.0, foreign_frames=foreign_frames))
    rng = random.Random(foreign_frames)
    rows = []
    for e in "abcd":
        rows += [frame(e, "d", f"{e}{n:02d}", 4 * n + ord(e) / 1000, n, prefix=e) for n in range(1, 31)]
        rows += [frame(e, "d", f"{e}-{t}", t, None, prefix="-") for t in rng.sample(range(0, 130, 7), 3)]
    rows += [frame(e, *r[2:4], (r[4] - datetime(2024, 1, 1)).total_seconds(), r[6], prefix=r[7]) for r in rng.sample([r for r in rows if r[6] is None], 5) for e in rng.sample("abcd", 2) if e != r[0]]
    first, seen = {}, set()
    rows = [(r[0], *first.setdefault(r[1], r[1:])) for r in rows if not ((r[0], r[1]) in seen or seen.add((r[0], r[1])))]
    called = []
    exact = series.foreign_in_time
    monkeypatch.setattr(series, "foreign_in_time", lambda *a: called.append(1) or exact(*a))
    got = {(r["entity_id"], r["path"]): r["series_index"] for r in series.split(spark.createDataFrame(rows, SCHEMA), S).collect()}
    assert got == plain_split(rows)
    assert called  # own frames lie on the first run found


def test_gaps(spark):
    rows = [frame("a", "d", f"i{n}", t, n) for n, t in ((1, 0), (6, 1), (12, 2), (13, 14), (14, 27))]
    got = [r["series_index"] for r in series.split(spark.createDataFrame(rows, SCHEMA), S).sort("seq").collect()]
    assert got == [1, 1, 2, 2, 3]


def rank(values, v):
    if len(values) <= 1 or max(values) - min(values) <= 1e-9:
        return 0.5
    return (sum(x < v for x in values) + max(0, sum(abs(x - v) <= 1e-9 for x in values) - 1) / 2) / (len(values) - 1)


@pytest.mark.parametrize("seed", range(3))
def test_best_frame_follows_the_score(spark, seed):
    rng = random.Random(seed)
    maybe = lambda v: v if rng.random() < 0.8 else None
    rows = [
        frame(e, "d", f"{e}{n:02d}", n * 3 + 100 * "xyz".index(e), None, prefix=e, distance=rng.randint(0, 9) / 20, det=rng.random(), blur=maybe(rng.choice([5.0, 50.0, 80.0, float("nan")])), left=maybe(rng.choice([0.05, 0.2, 0.3])), right=maybe(0.25), pose=maybe((rng.uniform(-40, 40), rng.uniform(-50, 50), 0.0)))
        for e in "xyz"
        for n in range(12)
    ]
    split = {}
    for (e, path), i in plain_split(rows).items():
        split.setdefault((e, i), []).append(next(r for r in rows if r[0] == e and r[1] == path))
    got = {(r["entity_id"], r["series_index"]): (r["path"], r["score"]) for r in series.best_frames(spark.createDataFrame(rows, SCHEMA), S).collect()}
    assert got.keys() == split.keys()
    for key, frames in split.items():
        eye = lambda r: min(r[11], r[12]) if r[11] is not None and r[12] is not None else None
        pool = [r for r in frames if eye(r) is not None and eye(r) >= S.eye_ratio_min] or frames
        sharp = lambda r: math.log1p(max(0.0, r[10])) if r[10] is not None and math.isfinite(r[10]) else None
        blurs, eyes = [sharp(r) for r in pool if sharp(r) is not None], [eye(r) for r in pool if eye(r) is not None]

        def score(r):
            b = (0.35 if blurs else 0.5) if sharp(r) is None else rank(blurs, sharp(r))
            o = (0.35 if eyes else 0.5) if eye(r) is None else rank(eyes, eye(r)) if len(eyes) > 1 else 0.75
            p = 0.65 if r[13] is None else max(0.0, min(1.0, 1 - max(abs(r[13][1]) / 45, abs(r[13][0]) / 35, abs(r[13][2]) / 35)))
            return 0.4 * b + 0.32 * o + 0.13 * max(0.0, min(1.0, 1 - r[8] / S.match_threshold)) + 0.1 * p + 0.05 * r[9]

        assert got[key][1] == pytest.approx(max(map(score, pool)), abs=1e-9)
        assert got[key][0] in {r[1] for r in pool if score(r) >= max(map(score, pool)) - 1e-9}


def test_no_frames(spark):
    assert series.best_frames(spark.createDataFrame([], SCHEMA), S).collect() == []


def test_frames_without_times_and_numbers_are_spread_by_their_paths(spark, monkeypatch):
    rows = [("e", f"d/{c}", "d", c, None, False, None, "x") for c in ("ab", "aa", "bb", "ba", "c")] + [("e", f"f/{c}", "f", c, None, False, None, "x") for c in ("q", "p")]
    frames = spark.createDataFrame(rows, "entity_id string, path string, dir string, name string, capture_time timestamp, time_is_metadata boolean, seq decimal(38,0), prefix string")
    monkeypatch.setattr(series, "PATH_HEAD", 3)
    assert series.ordered(frames).select("stretch").distinct().count() == 5
    got = {r["path"]: (r["series_index"], r["series_size"]) for r in series.split(frames, Settings()).collect()}
    assert got == {f"d/{c}": (1, 5) for c in ("ab", "aa", "bb", "ba", "c")} | {f"f/{c}": (2, 2) for c in ("q", "p")}


def many_frames(spark, n=20_000, entities=3):
    return spark.range(n).selectExpr(
        f"concat('e', id % {entities}) AS entity_id",
        "concat('d/', id) AS path",
        "'d' AS dir",
        "CAST(id AS STRING) AS name",
        "timestamp_seconds(id) AS capture_time",
        "true AS time_is_metadata",
        "CAST(id AS DECIMAL(38,0)) AS seq",
        "'x' AS prefix",
    )


def test_frames_are_not_dealt_by_their_entity(spark):
    """three entities must not leave the work to three tasks."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        plan = series.ordered(many_frames(spark))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_runs_are_only_made_where_times_decide(spark, monkeypatch):
    """frames that all have numbers need no runs between times."""
    monkeypatch.setattr(series, "shortest_runs", lambda *a: pytest.fail("runs were made"))
    assert series.split(many_frames(spark, 400), S).agg({"series_index": "max"}).first()[0] == 1


@pytest.mark.parametrize("seconds", [1, 7, 10_000])
def test_sizes_of_series_over_many_stretches(spark, monkeypatch, seconds):
    monkeypatch.setattr(series, "STRETCH_MICROS", seconds * 1_000_000)
    rng = random.Random(seconds)
    rows, t = [], 0.0
    for n in range(150):
        t += rng.choice([0.2, 0.2, 1.0, 3.0, 13.0])
        rows.append(frame(rng.choice("ab" if n < 100 else "c"), "d", f"i{n:03d}", t, None))
    expected = plain_split(rows)
    sizes = {}
    for (e, _), i in expected.items():
        sizes[e, i] = sizes.get((e, i), 0) + 1
    got = {(r["entity_id"], r["path"]): (r["series_index"], r["series_size"]) for r in series.split(spark.createDataFrame(rows, SCHEMA), S).collect()}
    assert got == {k: (i, sizes[k[0], i]) for k, i in expected.items()}
