"""A run that another thread cancels."""

import threading
import time

import pandas as pd
import pytest

from lodestone.config import Settings
from lodestone.operators.provider import batched
from lodestone.plans.control import Cancelled, Run
from lodestone.plans.run import analyse, write
from tests.test_matching import OBS, observation


def test_a_cancelled_run_writes_nothing(spark, tmp_path):
    begun = tmp_path / "begun"

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        begun.touch()
        time.sleep(30)
        return pd.DataFrame({"embedding": [[1.0, 0.0]] * len(rows)})

    rows = spark.createDataFrame([observation(i, f"d/{i}", (1, 0)) for i in range(40)], OBS).drop("embedding").repartition(8)
    gallery = spark.createDataFrame([("A", "r1", [1.0, 0.0])], "entity_id string, ref_id string, embedding array<double>")
    run = Run(spark)

    def all_of_it():
        write(analyse(rows, gallery, Settings(), provider=batched(model, "embedding array<double>")), tmp_path / "out")

    def cancel():
        while not begun.exists():
            time.sleep(0.05)
        run.cancel()

    other = threading.Thread(target=cancel)
    other.start()
    began = time.perf_counter()
    with pytest.raises(Cancelled):
        run(all_of_it)
    other.join()
    assert time.perf_counter() - began < 40  # eight tasks of 30 s or more were ahead
    assert not (tmp_path / "out").exists()
    assert spark.range(5).count() == 5  # other jobs are as they were


def test_between_jobs_and_before(spark):
    run = Run(spark)
    jobs = []

    def many():
        for k in range(1000):
            jobs.append(spark.range(3).count())
            if k == 2:
                run.cancel()
            time.sleep(0.05)

    with pytest.raises(Cancelled):
        run(many)
    assert 3 <= len(jobs) < 1000
    early = Run(spark)
    early.cancel()
    with pytest.raises(Cancelled):
        early(lambda: pytest.fail("it ran"))


def test_a_run_that_ends(spark):
    assert Run(spark)(lambda n: spark.range(n).count(), 7) == 7
    with pytest.raises(ZeroDivisionError):
        Run(spark)(lambda: 1 // 0)
