import codecs
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import inner_path, sequence_number, sequence_prefix, stem
from lodestone.operators.collect import copy_file, copy_files, copy_plan, copy_summary, folder_names, resolve, unique_names
from lodestone.sources.delimited import ACCEPTED, delimiter, find_column, read_manifest, write_delimited, write_report, write_single
from lodestone.sources.files import candidates, list_files


def test_delimiter_and_columns():
    assert delimiter("a;b,c") == ";"
    assert delimiter("a,b,c;d") == ","
    assert find_column(["X", " Source  FILE "], ("Source file",)) == 1
    assert find_column(["X"], ("Y",), 0) == 0
    assert find_column(["X"], ("Y",), 1) is None


@pytest.mark.parametrize("bom", [b"", codecs.BOM_UTF8])
def test_manifest(spark, tmp_path, bom):
    text = 'Идентификатор цели;номер фото с этой целью;Исходный файл\n A ; 1 ;"d/x ""1"".jpg"\n;;\nB;2\n'
    (tmp_path / "m.csv").write_bytes(bom + text.encode())
    rows, has_source = read_manifest(spark, str(tmp_path / "m.csv"))
    assert has_source
    got = [(r["row_number"], r["entity"], r["photo_id"], r["source"]) for r in rows.sort("row_number").collect()]
    assert got == [(2, "A", "1", 'd/x "1".jpg'), (3, "B", "2", "")]


def test_old_manifest_with_commas(spark, tmp_path):
    (tmp_path / "m.csv").write_text("who,item\nA,1\n")
    rows, has_source = read_manifest(spark, str(tmp_path / "m.csv"))
    assert not has_source
    assert [(r["entity"], r["photo_id"]) for r in rows.collect()] == [("A", "1")]


def test_empty_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        read_manifest(spark, str(tmp_path / "m.csv"))


def test_results_come_back_as_a_manifest(spark, tmp_path):
    df = spark.createDataFrame([("b", "p2", 'x;"y".jpg'), ("A", "p1", "q.jpg"), ("a", "p0", None)], "entity_id string, photo_id string, path string")
    write_single(df, tmp_path / "r.csv", ACCEPTED)
    data = (tmp_path / "r.csv").read_bytes()
    assert data.startswith(codecs.BOM_UTF8)
    assert data.decode("utf-8-sig").splitlines()[1:] == ["A;p1;q.jpg", "a;p0;", 'b;p2;"x;""y"".jpg"']
    assert [p.name for p in tmp_path.iterdir()] == ["r.csv"]
    rows, _ = read_manifest(spark, str(tmp_path / "r.csv"))
    assert {(r["entity"], r["source"]) for r in rows.collect()} == {("A", "q.jpg"), ("a", ""), ("b", 'x;"y".jpg')}
    write_delimited(df, str(tmp_path / "many"), ACCEPTED)
    assert list((tmp_path / "many").glob("part-*.csv"))


def test_listing_and_candidates(spark, tmp_path):
    for name in ("a.JPG", "b.txt", "d/C.raw", "d/noext"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = list_files(spark, str(tmp_path))
    assert {r["path"] for r in found.collect()} == {"a.JPG", "b.txt", "d/C.raw", "d/noext"}
    assert [r["path"] for r in candidates(found).collect()] == ["a.JPG", "d/C.raw", "d/noext"]
    assert [r["path"] for r in candidates(found, recursive=False).collect()] == ["a.JPG"]


def test_paths(spark):
    df = spark.createDataFrame([("a/b.jpg",), ("a\\..\\b.jpg",), ("../b.jpg",), ("a/../../b",), ("/etc/x",), ("",), ("C:/x",)], "p string")
    assert [r["q"] for r in df.select(inner_path(F.col("p")).alias("q")).collect()] == ["a/b.jpg", "b.jpg", None, None, None, None, None]
    names = spark.createDataFrame([("d/IMG_4048a.jpg",), ("x12y34.5.png",), (".hidden",), ("none",)], "p string").select(stem(F.col("p")).alias("s"))
    got = [(r["s"], r["n"] and int(r["n"]), r["x"]) for r in names.select("s", sequence_number(F.col("s")).alias("n"), sequence_prefix(F.col("s")).alias("x")).collect()]
    assert got == [("IMG_4048a", 4048, "img_4048a"), ("x12y34.5", 5, "x12y34."), (".hidden", None, ".hidden"), ("none", None, "none")]


MANIFEST = "row_number int, entity string, photo_id string, source string, width int"


def test_resolution(spark):
    files = spark.createDataFrame([("d/a.jpg",), ("d/b.jpg",), ("e/B.png",), (".x/.h.jpg",)], "path string")
    rows = [(2, "A", "a", "d\\a.jpg", 3), (3, "A", "b", "../b.jpg", 3), (4, "", "b", "d/b.jpg", 3), (5, "A", "c", "", 3), (6, "A", "", "", 1)]
    m = spark.createDataFrame(rows, MANIFEST)
    by_source = {r["row_number"]: (r["path"], r["reason"]) for r in resolve(m, files, has_source=True).collect()}
    assert by_source == {2: ("d/a.jpg", None), 3: (None, "source missing or outside"), 4: (None, "empty entity or item"), 5: (None, "source missing or outside"), 6: (None, "short row")}
    by_stem = {r["row_number"]: (r["path"], r["reason"]) for r in resolve(m, files, has_source=False).collect()}
    assert by_stem[2] == ("d/a.jpg", None)
    assert by_stem[3] == (None, "several files")
    assert by_stem[5] == (None, "no such file")


@pytest.mark.parametrize(
    ("names", "folders"),
    [
        (["A:", "A?", "A_ (2)"], {"A:": "A_", "A?": "A_ (2)", "A_ (2)": "A_ (2) (2)"}),
        (["con", "Nul.x", " . "], {"con": "_con", "Nul.x": "_Nul.x", " . ": "Без имени"}),
        (["x" * 130], {"x" * 130: "x" * 120}),
    ],
)
def test_folder_names(spark, names, folders):
    got = folder_names(spark.createDataFrame([(n,) for n in names], "entity string")).collect()
    assert {r["entity"]: r["folder"] for r in got} == folders


def plain_unique(rows, taken=()):
    """In order of place each (id, scope, name, end, place) takes the first free of name, name (2), name (3), ..."""
    held = {(scope, (name + end).casefold()) for scope, name, end in taken}
    out = {}
    for own, scope, name, end, _ in sorted(rows, key=lambda r: r[4]):
        n = 1
        while (scope, (f"{name} ({n}){end}" if n > 1 else name + end).casefold()) in held:
            n += 1
        out[own] = f"{name} ({n}){end}" if n > 1 else name + end
        held.add((scope, out[own].casefold()))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    name = lambda: rng.choice("abA") + rng.choice(["", "", " (2)", " (3)", " (2) (2)"])
    rows = [(str(i), rng.choice("xy"), name(), rng.choice([".jpg", ".JPG", ""]), i) for i in range(80)]
    rows += [(f"z{i}", "z", "only", ".jpg", i) for i in range(30)]
    taken = [(rng.choice("xy"), name(), ".jpg") for _ in range(10)]
    frame = spark.createDataFrame(rows, "id string, scope string, name string, end string, place int").repartition(3)
    for some in ([], taken):
        there = spark.createDataFrame(some, "scope string, name string, end string") if some else None
        assert {r["id"]: r["unique"] for r in unique_names(frame, there).collect()} == plain_unique(rows, some)


def test_targets_that_clash(spark):
    paths = ["x/a.jpg", "y/a.jpg", "x/a (2).jpg"]
    m = spark.createDataFrame([(i + 2, "E", "a", p, 3) for i, p in enumerate(paths)], MANIFEST)
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    targets = lambda there: [r["target"] for r in copy_plan(m, files, has_source=True, existing=there).sort("row_number").collect()]
    assert targets(None) == ["E/a.jpg", "E/a (2).jpg", "E/a (2) (2).jpg"]
    there = spark.createDataFrame([("E", "a.jpg"), ("E", "A (2).jpg")], "folder string, name string")
    assert targets(there) == ["E/a (3).jpg", "E/a (4).jpg", "E/a (2) (2).jpg"]


def test_report_of_copies(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.jpg").write_bytes(b"1")
    files = spark.createDataFrame([("a.jpg",), ("gone.jpg",)], "path string")
    m = spark.createDataFrame([(2, "A", "a", "a.jpg", 3), (3, "A", "gone", "gone.jpg", 3), (4, "B", "x", "x.jpg", 3)], MANIFEST)
    plan = copy_plan(m, files, has_source=True)
    out = copy_files(plan, str(tmp_path / "src"), str(tmp_path / "out"))
    assert [(r["row_number"], r["source"], r["status"]) for r in out.sort("row_number").collect()] == [(2, "a.jpg", "copied"), (3, "gone.jpg", "error"), (4, "x", "skipped")]
    assert tuple(copy_summary(out).first()) == (1, 1, 1, 1, False)
    write_report(out, tmp_path / "report.csv")
    lines = (tmp_path / "report.csv").read_text("utf-8-sig").splitlines()
    assert lines[0] == "Строка CSV;Цель;Исходный файл/номер;Статус;Результат/причина"
    assert lines[1] == "2;A;a.jpg;скопировано;A/a.jpg"
    assert lines[3] == "4;B;x;пропущено;source missing or outside"
    (tmp_path / "stop").touch()
    again = copy_files(plan, str(tmp_path / "src"), str(tmp_path / "new"), cancel_file=str(tmp_path / "stop"))
    assert tuple(copy_summary(again).first()) == (0, 1, 1, 0, True)
    assert not list((tmp_path / "new").rglob("*.jpg*"))


def test_copying(spark, tmp_path):
    (tmp_path / "src/d").mkdir(parents=True)
    (tmp_path / "src/d/a.jpg").write_bytes(b"1")
    (tmp_path / "src/a.jpg").write_bytes(b"2")
    files = spark.createDataFrame([("d/a.jpg",), ("a.jpg",)], "path string")
    m = spark.createDataFrame([(2, "A", "a", "d/a.jpg", 3), (3, "A", "a", "a.jpg", 3)], MANIFEST)
    there = spark.createDataFrame([("A", "A.JPG")], "folder string, name string")
    plan = copy_plan(m, files, has_source=True, existing=there)
    assert [r["target"] for r in plan.sort("row_number").collect()] == ["A/a (2).jpg", "A/a (3).jpg"]
    copy_files(plan, str(tmp_path / "src"), str(tmp_path / "out"))
    assert (tmp_path / "out/A/a (3).jpg").read_bytes() == b"2"
    with pytest.raises(InterruptedError):
        copy_file(str(tmp_path / "src/a.jpg"), str(tmp_path / "out/x"), cancelled=lambda: True)
    assert not (tmp_path / "out/x").exists()
