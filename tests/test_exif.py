"""Capture times from files of several kinds, whole and damaged."""

import io
import os
import random
import struct
import zlib
from datetime import datetime

import pytest

from lodestone.sources import exif
from lodestone.sources.exif import DATETIME, DIGITIZED, ORIGINAL


def directory(order, at, entries):
    """A directory at an offset, and the data behind it. entries: (tag, text or number)."""
    body, tail = struct.pack(f"{order}H", len(entries)), b""
    after = at + 2 + 12 * len(entries) + 4
    for tag, value in entries:
        if isinstance(value, int):
            body += struct.pack(f"{order}HHII", tag, exif.LONG, 1, value)
        elif len(text := value.encode() + b"\0") <= 4:
            body += struct.pack(f"{order}HHI", tag, exif.ASCII, len(text)) + text.ljust(4, b"\0")
        else:
            body += struct.pack(f"{order}HHII", tag, exif.ASCII, len(text), after + len(tail))
            tail += text
    return body + struct.pack(f"{order}I", 0) + tail


def tiff(order, own, sub=None, gap=0):
    """A TIFF with a directory of its own and an EXIF directory some bytes later."""
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8)
    if sub is None:
        return head + directory(order, 8, own)
    first = directory(order, 8, [*own, (exif.EXIF_DIRECTORY, 0)])
    at = 8 + len(first) + gap
    return head + directory(order, 8, [*own, (exif.EXIF_DIRECTORY, at)]) + b"\0" * gap + directory(order, at, sub)


def jpeg(data, before=b""):
    segment = b"\xff\xe1" + struct.pack(">H", len(data) + 8) + b"Exif\0\0" + data
    return b"\xff\xd8" + before + segment + b"\xff\xda\0\x02" + b"picture" * 1000


def png(data):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"x" * 70_000) + chunk(b"eXIf", data) + chunk(b"IEND", b"")


def webp(data, prefix=b""):
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    body = chunk(b"VP8X", b"\0" * 10) + chunk(b"VP8 ", b"y" * 33) + chunk(b"EXIF", prefix + data)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


T = [f"2024:01:0{k} 10:00:0{k}" for k in range(1, 5)]
WHOLE = {
    "a.jpg": (jpeg(tiff("<", [(DATETIME, T[0])], [(ORIGINAL, T[1]), (DIGITIZED, T[2])])), (T[1], T[2], T[0])),
    "b.jpeg": (jpeg(tiff(">", [(DATETIME, T[0])]), b"\xff\xe0\0\x10" + b"J" * 14 + b"\xff\xff\xfe\0\x04hi"), (None, None, T[0])),
    "c.tif": (tiff(">", [(271, "maker"), (ORIGINAL, T[3])], [(ORIGINAL, T[1])], gap=200_000), (T[3], None, None)),
    "d.png": (png(tiff("<", [], [(DIGITIZED, T[2])])), (None, T[2], None)),
    "e.webp": (webp(tiff("<", [(DATETIME, T[0])])), (None, None, T[0])),
    "f.webp": (webp(tiff(">", [(DATETIME, T[0])]), b"Exif\0\0"), (None, None, T[0])),
    "g.nef": (tiff("<", [(DATETIME, "0"), (DIGITIZED, "12")]), (None, "12", "0")),
    "none.jpg": (b"\xff\xd8\xff\xda\0\x02" + b"z" * 99, (None, None, None)),
    "text.jpg": (b"no picture at all", (None, None, None)),
    "empty.jpg": (b"", (None, None, None)),
    "big.jpg": (jpeg(tiff("<", [(DATETIME, T[0])])) + b"p" * 3_000_000, (None, None, T[0])),
}


def read(data):
    return exif.dates_of(exif.Pages(io.BytesIO(data)))


def test_dates_of_files():
    for name, (data, dates) in WHOLE.items():
        assert tuple(map(read(data).get, exif.DATES.values())) == dates, name
    assert exif.dates_of(exif.Pages(io.BytesIO(WHOLE["a.jpg"][0])), exif_directory=False) == {"exif_datetime": T[0]}


def test_whole_files_are_never_read():
    for name in ("c.tif", "big.jpg"):
        pages = exif.Pages(io.BytesIO(WHOLE[name][0]))
        exif.dates_of(pages)
        assert pages.fetched <= 2 * exif.PAGE


def test_directories_in_a_circle_are_read_once():
    head = b"II*\0" + struct.pack("<I", 8)
    assert read(head + directory("<", 8, [(exif.EXIF_DIRECTORY, 8), (DATETIME, T[0])])) == {"exif_datetime": T[0]}
    two = directory("<", 8, [(exif.EXIF_DIRECTORY, 26)])
    assert read(head + two + directory("<", 26, [(exif.EXIF_DIRECTORY, 8), (ORIGINAL, T[1])])) == {"exif_original": T[1]}


@pytest.mark.parametrize("name", ["a.jpg", "b.jpeg", "c.tif", "e.webp"])
def test_damaged_heads_give_no_wrong_date(name):
    data, rng = WHOLE[name][0], random.Random(name)
    short = data[:600]
    for n in range(len(short)):
        assert set(read(short[:n]).values()) <= set(T)
    for _ in range(400):
        bad = bytearray(data[:3000])
        for _ in range(rng.randint(1, 8)):
            bad[rng.randrange(min(200, len(bad)))] = rng.randrange(256)
        read(bytes(bad))  # nothing is raised, and it ends
    assert read(b"II*\0" + struct.pack("<I", 2**32 - 1)) == {}
    assert read(b"II*\0" + struct.pack("<I", 8) + b"\xff\xff" + struct.pack("<HHII", DATETIME, exif.ASCII, 20, 2**32 - 5)) == {}


def test_order_of_a_mixed_folder(spark, tmp_path):
    for name, (data, _) in WHOLE.items():
        path = tmp_path / ("sub dir" if name < "d" else ".") / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
        os.utime(path, (1_700_000_000, 1_700_000_000))
    rows = {os.path.basename(r["path"]): r for r in exif.photo_order(spark, str(tmp_path)).collect()}
    assert set(rows) == set(WHOLE) - {"empty.jpg"}  # Spark lists no empty files
    for name, (_, dates) in WHOLE.items():
        if name not in rows:
            continue
        real = next((d for d in dates if d and len(d) > 5), None)
        assert rows[name]["time_is_metadata"] == (real is not None), name
        assert rows[name]["capture_time"] == (datetime.strptime(real, "%Y:%m:%d %H:%M:%S") if real else datetime.fromtimestamp(1_700_000_000))
    assert rows["a.jpg"]["dir"] == "sub dir"
    heads = spark.createDataFrame([(n, d) for n, (d, _) in WHOLE.items()] + [("null", None)], "path string, head binary")
    assert {r["path"]: tuple(r)[1:] for r in exif.dates_of_heads(heads).collect()} == {n: d for n, (_, d) in WHOLE.items()} | {"null": (None, None, None)}


def test_files_that_cannot_be_opened_have_no_date(spark, tmp_path):
    df = spark.createDataFrame([("x", f"file:{tmp_path}/gone.jpg")], "path string, uri string")
    assert [tuple(r) for r in exif.capture_dates(df).collect()] == [("x", None, None, None)]
