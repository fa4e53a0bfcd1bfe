"""Texts of reason codes."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators.quality import with_quality
from lodestone.operators.reasons import TEXTS, reason_text, with_reason_text
from lodestone.plans.queries import QUERIES
from lodestone.plans.run import analyse
from tests.test_matching import OBS, observation, vectors


def test_every_code_has_a_text_with_its_numbers(spark):
    rows = [
        observation(1, "p", (1, 0), box=(0, 400, 30, 430), blur=12.25, left=0.0, pose=(40.4, -50.5, 60.0)),
        observation(2, "p", (1, 0), box=(20, 400, 120, 520)),
        observation(3, "p", (1, 0)),
    ]
    s = Settings()
    judged = with_quality(spark.createDataFrame(rows, OBS), s)
    got = {r["obs_id"]: r["t"] for r in judged.select("obs_id", reason_text(s).alias("t")).collect()}
    assert got[1] == "too small (30 px); too little room beside; blurred (12.2); turned too far, yaw -50°; tilted too far, pitch 40°; tilted too far, roll 60°; eye closed (0.000/0.300)"
    assert got[2] == "too close to a side edge (1.20% of the frame, about 2.2% must stay free)"
    assert got[3] == ""


def test_odd_codes_and_numbers(spark):
    s = Settings()
    rows = spark.createDataFrame([observation(1, "p", (1, 0), blur=float("nan"), pose=None)], OBS)
    shown = lambda codes, **named: rows.withColumn("quality_reasons", F.array(*map(F.lit, codes))).select(reason_text(s, **named)).first()[0]
    assert shown(["blur", "yaw", "own"]) == "blurred (?); turned too far, yaw ?°; own"
    assert shown(["small"], texts={"small": "{side}|{left}"}) == "100|0.300"
    with pytest.raises(ValueError, match="nothing"):
        shown(["small"], texts={"small": "{nothing}"})


def test_rejected_rows_of_a_run_with_texts(spark):
    rows = spark.createDataFrame([observation(1, "d/i1.jpg", (1, 0.1), blur=1.0), observation(2, "d/i2.jpg", (1, 0.1))], OBS)
    out = analyse(rows, vectors(spark, [("a", (1, 0)), ("b", (-1, 0))], "entity_id"), Settings(match_threshold=0.35), texts=TEXTS)
    assert [(r["path"], r["reason"]) for r in out.rejected.collect()] == [("d/i1.jpg", "blurred (1.0)")]


def test_staged_texts_are_those_of_the_column(spark):
    s = Settings()
    rows = spark.createDataFrame([observation(n, "p", (1, 0), blur=float("nan") if n else 3.14, pose=None) for n in range(2)], OBS)
    for codes in (["blur", "own", "yaw", "blur", "small"], [], [""], ["", "eyes", ""], ["\x01blur\x01", "blur"], [None, "roll"]):
        listed = rows.withColumn("quality_reasons", F.array(*map(F.lit, codes)).cast("array<string>"))
        for texts in (TEXTS, {"small": "blur", "blur": "small {blur}", "own": "\x01\x02"}):
            both = with_reason_text(listed, s, "staged", texts).select("staged", reason_text(s, texts).alias("t")).collect()
            assert [r["staged"] for r in both] == [r["t"] for r in both]


@pytest.mark.parametrize("name", ["quality_texts", "quality_reasons", "edge_guard"])
def test_no_stage_is_too_long_for_the_jvm_to_compile(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
