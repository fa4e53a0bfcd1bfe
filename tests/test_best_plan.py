"""the best of series takes the step of series, so frames of a single entity are spread."""

from __future__ import annotations

from decimal import Decimal

from lodestone.config import Settings
from lodestone.operators import series


def test_one_entity_is_spread_before_its_series_are_known(spark, monkeypatch):
    plans = []
    written = series.written
    monkeypatch.setattr(series, "written", lambda df, name, **k: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or written(df, name, **k))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        frames = spark.range(20_000).selectExpr(
            "'e' AS entity_id",
            "concat('d/', id) AS path",
            "'d' AS dir",
            "CAST(id AS STRING) AS name",
            "timestamp_seconds(id) AS capture_time",
            "true AS time_is_metadata",
            "CAST(NULL AS DECIMAL(38,0)) AS seq",
            "'x' AS prefix",
            "0.1D AS distance",
            "0.5D AS det_score",
            "CAST(id % 7 AS DOUBLE) AS blur_score",
            "0.2D AS eye_left",
            "0.2D AS eye_right",
            "CAST(NULL AS STRUCT<pitch: DOUBLE, yaw: DOUBLE, roll: DOUBLE>) AS pose",
        )
        best = series.best_frames(frames, Settings(series_gap_seconds=12.0)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [(r["series_index"], r["series_size"]) for r in best] == [(1, 20_000)]
    # sizes are made of one or two rows for each stretch
    assert not [name for name, plan in plans if "SortMergeJoin" in plan and name != "sizes"]


def test_keys_of_sorts_are_no_decimals(spark):
    """a sort of decimals of 38 digits makes them anew for each comparison."""
    frames = spark.createDataFrame([], "entity_id string, path string, dir string, name string, capture_time timestamp, time_is_metadata boolean, seq decimal(38,0), prefix string")
    types = dict(series.ordered(frames).dtypes)
    assert types["k1"] == types["k2"] == "bigint" and "decimal" not in types["stretch"]


def test_numbers_beyond_longs_keep_their_order(spark):
    """Also those that no stretch could be computed of before."""
    numbers = [-(10**37) - 1, -(10**37), -(2**62), 1 - 2**62, 5, 2**62 - 1, 2**62, 2**62 + 1, 2**63, 10**20, 10**37, 10**37 + 1, 10**37 + 3]
    schema = "entity_id string, path string, dir string, name string, capture_time timestamp, time_is_metadata boolean, seq decimal(38,0), prefix string"
    rows = lambda numbers: spark.createDataFrame([("e", f"d/{k * 7 % 13}", "d", "n", None, False, Decimal(n), "x") for k, n in enumerate(numbers)], schema)
    order = lambda some: [int(r["seq"]) for r in series.split(rows(some), Settings()).select("seq", "series_index").sort("series_index", "seq").collect()]
    assert order(numbers) == numbers  # by times, which are missing
    assert order(numbers[-3:]) == numbers[-3:]  # by numbers
    got = {int(r["seq"]): r["series_index"] for r in series.split(rows(numbers), Settings()).collect()}
    assert len(set(got.values())) == 13 - sum(0 < b - a <= Settings().series_gap_numbers for a, b in zip(numbers, numbers[1:], strict=False))


def test_series_of_one_frame_are_not_shuffled_for_their_score(spark):
    """their scores need no other rows."""
    rows = spark.range(10).selectExpr("'e' AS entity_id", "id AS series_index", "1L AS series_size", "concat('d/', id) AS path", "0.1D AS distance", "0.5D AS det_score", "if(id % 2 = 0, 3D, NULL) AS blur_score", "if(id % 3 = 0, 0.2D, NULL) AS eye_left", "0.2D AS eye_right", "CAST(NULL AS STRUCT<pitch: DOUBLE, yaw: DOUBLE, roll: DOUBLE>) AS pose")
    alone, general = series.scored(rows, Settings(), alone=True), series.scored(rows, Settings())
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    columns = sorted(general.columns)
    assert alone.select(columns).sort("path").collect() == general.select(columns).sort("path").collect()
