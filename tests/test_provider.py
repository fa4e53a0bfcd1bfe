from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators.provider import batched
from lodestone.plans.run import analyse, gallery_of, write
from tests.test_matching import OBS, observation


def test_a_bad_row_costs_no_other(spark):

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["n"] == 70).any():
            raise RuntimeError("bad")
        return pd.DataFrame({"twice": rows["n"] * 2, "batch": len(rows)})

    rows = spark.range(150).withColumnRenamed("id", "n").withColumn("error", F.lit("old")).coalesce(1)
    out = batched(model, "twice long, batch int")(rows).collect()
    assert len(out) == 150
    assert {r["n"]: r["twice"] for r in out if r["error"] is None} == {n: 2 * n for n in range(150) if n != 70}
    assert [(r["n"], r["twice"], r["error"]) for r in out if r["error"]] == [(70, None, "RuntimeError: bad")]
    assert {r["batch"] for r in out if r["n"] < 64} == {64} and {r["batch"] for r in out if r["n"] > 128} == {22}


def test_gallery_of_named_files(spark):
    rows = [("a/1 Kot Nik.jpg", "1 Kot Nik", 1, [1.0, 0.0], [], None), ("a/2 Kot Nik.jpg", "2 Kot Nik", 2, [0.0, 1.0], [], None), ("a/Lis.jpg", "Lis", 1, [0.5, 0.5], [], None), ("a/Bad.jpg", "Bad", 1, None, [], "unreadable")]
    refs = spark.createDataFrame(rows, "path string, stem string, boxes int, embedding array<double>, quality_reasons array<string>, error string")
    assert sorted((r["entity_id"], r["ref_id"]) for r in gallery_of(refs).collect()) == [("Kot Nik", "a/1 Kot Nik.jpg"), ("Lis", "a/Lis.jpg")]


def test_the_model_sees_each_row_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        with open(seen, "a") as f:
            f.writelines(f"{i}\n" for i in rows["obs_id"])
        if 13 in rows["obs_id"].to_numpy():
            raise ValueError("unreadable")
        return pd.DataFrame({"embedding": [[1.0, float(i % 3)] for i in rows["obs_id"]]})

    given = [observation(i, f"d/{i}", (1, 0), error="missing" if i == 5 else None) for i in range(40)]
    rows = spark.createDataFrame(given, OBS).drop("embedding").repartitionByRange(4, "obs_id")
    gallery = spark.createDataFrame([("A", "r1", [1.0, 0.0]), ("B", "r2", [0.0, 1.0])], "entity_id string, ref_id string, embedding array<double>")
    out = analyse(rows, gallery, Settings(match_threshold=0.35), provider=batched(model, "embedding array<double>"))
    matched = {r["obs_id"] for r in out.matched.collect()}
    assert {r["obs_id"] for r in out.errors.collect()} == {5, 13}
    assert matched == set(range(40)) - {5, 13}
    write(out, tmp_path / "out")
    tried = Counter(int(x) for x in open(seen).read().split())
    assert set(tried) == set(range(40)) - {5}
    assert tried[0] == tried[39] == 1
    assert max(tried.values()) == 2  # a row of the batch that failed goes through again, by itself
