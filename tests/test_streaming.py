"""Series of a stream against the batch operator."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import series
from lodestone.streaming.series import STORE, series_of_stream

SCHEMA = "entity_id string, path string, dir string, prefix string, seq long, capture_time timestamp, time_is_metadata boolean"
S = Settings(series_gap_seconds=12.0)
START = datetime(2024, 1, 1)


@pytest.fixture
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in (STORE[0], "spark.sql.shuffle.partitions")}
    spark.conf.set(*STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def frame(entity, d, n, seconds, numbered=True, meta=True):
    return (entity, f"{d}/i{n:04d}", d, "i", n if numbered else None, START + timedelta(seconds=seconds), meta)


def streamed(spark, tmp_path, batches, **named):
    """The stream's rows after the batches and one frame far later, which lets the watermark pass all of them."""
    end = max((r[5] for rows in batches for r in rows if r[5]), default=START) + timedelta(days=30)
    flush = [("end", "end/1", "end", "i", 1, end, True)], [("end", "end/2", "end", "i", 9, end + timedelta(days=1), True)]
    for i, rows in enumerate([*batches, *flush]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    name = f"series_{tmp_path.name.replace('-', '_')}"
    q = series_of_stream(stream, S, **named).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        state = [o.numRowsTotal for o in q.lastProgress.stateOperators] if q.lastProgress else []
    finally:
        q.stop()
    return spark.table(name).where("entity_id IS NULL OR entity_id <> 'end'").collect(), state


@pytest.mark.parametrize("seed", [0, 1])
def test_a_stream_out_of_order_gives_the_batch_series(stateful, tmp_path, seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for n in range(160):
        t += rng.choice([0.25, 0.5, 1.0, 3.0, 13.0])
        d = rng.choice("aaab")
        numbered = rng.random() < 0.6
        meta = rng.random() < 0.8
        rows += [frame(e, d, n, t, numbered, meta) for e in rng.sample("xyz", rng.choice([1, 1, 1, 2]))]
    late = sorted(range(len(rows)), key=lambda i: (rows[i][5] - START).total_seconds() + rng.random() * 40)
    batches = [[rows[i] for i in late[a : a + 60]] for a in range(0, len(rows), 60)]
    got, _ = streamed(stateful, tmp_path, batches, keep_seconds=86_400.0)
    batch = stateful.createDataFrame([(*r[:4], None if r[4] is None else Decimal(r[4]), *r[5:], r[1][2:]) for r in rows], SCHEMA.replace("seq long", "seq decimal(38,0)") + ", name string")
    assert series.order_modes(batch).where("by_number").isEmpty()
    expected = {(r["entity_id"], r["path"]): r["series_index"] for r in series.split(batch, S).collect()}
    assert {(r["entity_id"], r["path"]): r["series_index"] for r in got} == expected
    assert len(got) == len(rows)
    assert len({(r["entity_id"], r["series_first"]) for r in got}) == len(set((e, i) for (e, _), i in expected.items()))


def test_guard_state_and_odd_frames(stateful, tmp_path):
    calm = [frame("e", "d", n, n, numbered=False) for n in (0, 10)]
    foreign = [frame("f", "d", n, n, numbered=False) for n in range(1, 1 + S.foreign_frames)]
    away = [frame("e", "d", 9000, 90_000, numbered=False), frame("e", "d", 9001, 90_001, numbered=False)]
    odd = [(None, "d/null", "d", None, None, START + timedelta(seconds=5), None), ("e", "d/untimed", "d", "i", None, None, True)]
    got, state = streamed(stateful, tmp_path, [calm + odd, foreign, away], keep_seconds=600.0)
    index = {(r["entity_id"], r["path"]): (r["series_index"], r["series_first"]) for r in got}
    assert index[("e", "d/i0000")] == (1, "d/i0000")
    assert index[("e", "d/i0010")] == (2, "d/i0010")  # foreign frames came between, in a later batch
    assert index[("e", "d/i9000")] == index[("e", "d/i9001")] == (1, "d/i9000")  # away for longer than states are kept
    assert index[(None, "d/null")] == (1, "d/null")
    assert ("e", "d/untimed") not in index
    assert sum(state) <= 12  # what is left are the last frames of the test's own


def test_settings_are_checked(stateful):
    stream = stateful.readStream.format("rate").load().select(F.lit("e").alias("entity_id"))
    with pytest.raises(ValueError, match="shorter than the gap"):
        series_of_stream(stream, S, keep_seconds=1.0)
    stateful.conf.unset(STORE[0])
    with pytest.raises(ValueError, match="stateStore"):
        series_of_stream(stream, S)
