"""One file out of all partitions: order, quoting, failing and repeated tasks."""

import codecs
import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import delimited, single_file
from lodestone.sources.delimited import ACCEPTED, as_lines, write_single


def read_back(path):
    data = path.read_bytes()
    assert data.startswith(codecs.BOM_UTF8)
    return list(csv.reader(data.decode("utf-8-sig").splitlines(keepends=True), delimiter=";"))


def test_rows_of_many_partitions_come_in_order(spark, tmp_path):
    rng = random.Random(1)
    pool = ["x", 'q"q', '"', "a;b", "two\nlines", "cr\rx", " spaced ", "é", "", "ends\\"]
    rows = [("".join(rng.choices("aAbBé", k=3)), rng.choice(pool), f"{rng.choice(pool)}{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "entity_id string, photo_id string, path string").repartition(7)
    write_single(df, tmp_path / "r.csv", ACCEPTED)
    got = read_back(tmp_path / "r.csv")
    assert got[0] == list(ACCEPTED.values())
    assert got[1:] == [list(r) for r in sorted(rows, key=lambda r: (r[0].lower(), r[0], r[2].lower(), r[2]))]
    expected = tmp_path / "expected.csv"
    with expected.open("w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f, delimiter=";", lineterminator="\n").writerows(got)
    assert expected.read_bytes() == (tmp_path / "r.csv").read_bytes()
    assert sorted(os.listdir(tmp_path)) == ["expected.csv", "r.csv"]


def test_no_rows_and_single_cells(spark, tmp_path):
    write_single(spark.createDataFrame([], "entity_id string, photo_id string, path string"), tmp_path / "new" / "r.csv", ACCEPTED)
    assert read_back(tmp_path / "new" / "r.csv") == [list(ACCEPTED.values())]
    assert [r["line"] for r in as_lines(spark.createDataFrame([("",), ("x",)], "a string")).collect()] == ['""\n', "x\n"]


def test_no_row_passes_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    for name in ("collect", "toLocalIterator", "toPandas", "toArrow", "first", "take"):
        monkeypatch.setattr(DataFrame, name, lambda *_, **__: pytest.fail("rows went to the driver"))
    write_single(spark.range(500).select(*[F.col("id").cast("string").alias(c) for c in ACCEPTED]), tmp_path / "r.csv", ACCEPTED)
    monkeypatch.undo()
    assert len(read_back(tmp_path / "r.csv")) == 501


def test_a_failing_task_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("old")
    lines = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 60, F.concat(F.col("id").cast("string"), F.lit("\n"))).alias("line"))
    with pytest.raises(Exception, match="a line is null"):
        single_file.write_lines(lines, path)
    assert path.read_text() == "old"
    assert os.listdir(tmp_path) == ["r.csv"]


class Task:
    """Stands for a task's context."""

    def __init__(self, partition, attempt):
        self.partitionId, self.taskAttemptId = lambda: partition, lambda: attempt


def test_repeated_tasks_leave_one_whole_file(tmp_path, monkeypatch):
    import pyarrow as pa

    writer = single_file.SingleFileWriter(str(tmp_path / "r.txt"), b"head\n")
    batches = lambda *texts: [pa.RecordBatch.from_pydict({"line": pa.array(["skipped", *texts])}).slice(1)]

    def attempt(partition, number, *texts):
        monkeypatch.setattr(single_file.TaskContext, "get", staticmethod(lambda: Task(partition, number)))
        return writer.write(iter(batches(*texts)))

    second = attempt(1, 1, "c\n", "d\n")
    attempt(0, 2, "a\n", "half of it")  # its executor was lost after it wrote
    first = attempt(0, 3, "a\n", "b\n")
    attempt(1, 4, "c\n")  # a speculative one that Spark does not count
    writer.commit([second, first, None])
    assert (tmp_path / "r.txt").read_text() == "head\na\nb\nc\nd\n"
    assert os.listdir(tmp_path) == ["r.txt"]
    assert delimited.delimiter("a;b") == ";"
