"""Capture times from the files themselves: three date tags of EXIF directories, by ranged reads.

A reader gives bytes at an offset; of a file only its head and the few places that its
directories point to are read. JPEG segments, PNG and WebP chunks and bare TIFF directories
(which most raw formats are) are followed. Whatever is damaged or points outside of the file
gives no date; a directory that points back to itself is read once.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.files import files_at, item_order

#: Tags of the TIFF and EXIF standards.
ORIGINAL, DIGITIZED, DATETIME, EXIF_DIRECTORY = 36867, 36868, 306, 34665
DATES = {ORIGINAL: "exif_original", DIGITIZED: "exif_digitized", DATETIME: "exif_datetime"}
#: Numbers of the standards for a text, a long and a directory's offset.
ASCII, LONG, OFFSET = 2, 4, 13
#: Bytes that are read at a time, and of a date at most.
PAGE, DATE_BYTES = 1 << 14, 64

Read = Callable[[int, int], bytes]
SCHEMA = "path string, exif_original string, exif_digitized string, exif_datetime string"


class Pages:
    """Ranged reads of a file, a page at a time; fetched counts the bytes."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.pages, self.fetched = file, {}, 0

    def __call__(self, offset: int, length: int) -> bytes:
        """Up to length bytes, fewer where the file ends."""
        out = b""
        for page in range(offset // PAGE, (offset + length - 1) // PAGE + 1):
            if page not in self.pages:
                self.file.seek(page * PAGE)
                self.pages[page] = self.file.read(PAGE)
                self.fetched += len(self.pages[page])
            out += self.pages[page]
        return out[offset % PAGE :][:length]


def _unpack(read: Read, offset: int, layout: str) -> tuple[int, ...]:
    data = read(offset, struct.calcsize(layout))
    if offset < 0 or len(data) < struct.calcsize(layout):
        raise ValueError("the file ends before")
    return struct.unpack(layout, data)


def tiff_start(read: Read) -> int | None:
    """Where the TIFF header of a file's EXIF lies."""
    head = read(0, 12)
    if head[:4] in (b"II*\0", b"MM\0*"):
        return 0
    if head[:2] == b"\xff\xd8":
        return _in_segments(read)
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return _in_chunks(read, 8, ">I4s", b"eXIf", tail=4)
    if head[:4] == b"RIFF" and head[8:] == b"WEBP":
        return _in_chunks(read, 12, "<4sI", b"EXIF", tail=0)
    return None


def _in_segments(read: Read) -> int | None:
    """JPEG: markers with lengths until the picture begins."""
    at = 2
    while True:
        mark, kind = _unpack(read, at, ">BB")
        if mark != 0xFF or kind in (0xD9, 0xDA):
            return None
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:  # filling, or a marker without a length
            at += 1 if kind == 0xFF else 2
            continue
        (length,) = _unpack(read, at + 2, ">H")
        if kind == 0xE1 and read(at + 4, 6) == b"Exif\0\0":
            return at + 10
        if length < 2:
            return None
        at += 2 + length


def _in_chunks(read: Read, at: int, layout: str, wanted: bytes, tail: int) -> int | None:
    """PNG (with a checksum behind each chunk) and WebP (chunks of even length)."""
    while len(read(at, 8)) == 8:
        a, b = _unpack(read, at, layout)
        name, length = (b, a) if tail else (a, b)
        if name == wanted:
            return at + 8 + (6 if read(at + 8, 6) == b"Exif\0\0" else 0)
        at += 8 + length + (tail or length % 2)
    return None


def dates_of(read: Read, exif_directory: bool = True) -> dict[str, str]:
    """The date texts that the file holds, by column. exif_directory: also those of the directory that the first one points to; what both have is taken from the first."""
    try:
        base = tiff_start(read)
        if base is None:
            return {}
        order = {b"II": "<", b"MM": ">"}[read(base, 2)]
        magic, first = _unpack(read, base + 2, f"{order}HI")
        if magic != 42:
            return {}
    except (ValueError, KeyError):
        return {}
    found: dict[str, str] = {}
    ahead, seen = [first], set()
    while ahead:
        at = ahead.pop()
        if at in seen or at < 8:
            continue
        seen.add(at)
        try:
            (entries,) = _unpack(read, base + at, f"{order}H")
            for k in range(entries):
                entry = base + at + 2 + 12 * k
                tag, kind, n, value = _unpack(read, entry, f"{order}HHII")
                if tag == EXIF_DIRECTORY and kind in (LONG, OFFSET) and exif_directory:
                    ahead.append(value)
                elif tag in DATES and kind == ASCII:
                    text = read(entry + 8 if n <= 4 else base + value, min(n, DATE_BYTES))
                    if len(text) < min(n, DATE_BYTES):
                        continue
                    found.setdefault(DATES[tag], text.split(b"\0")[0].decode("ascii", "replace").strip())
        except ValueError:  # what was read before the damage counts
            continue
    return found


def open_ranged(uri: str) -> BinaryIO:
    """A file of a local or shared folder, or of a store that Arrow knows (s3, gs, hdfs...), for ranged reads."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file" or not rest:
        return pyarrow.fs.LocalFileSystem().open_input_file(("/" + rest.lstrip("/")) if rest else uri)
    store, _ = pyarrow.fs.FileSystem.from_uri("/".join(uri.split("/")[:3]))
    return store.open_input_file(uri.split("://", 1)[1])


def capture_dates(files: DataFrame, uri_col: str = "uri", *, exif_directory: bool = True, opener: Callable[[str], BinaryIO] = open_ranged) -> DataFrame:
    """files: path and a column of URIs. SCHEMA: the date texts of each file, null where it has none or cannot be opened.

    opener: gives a seekable file for a URI, for stores that Arrow does not know.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for uri in batch[uri_col]:
                try:
                    with opener(uri) as f:
                        found.append(dates_of(Pages(f), exif_directory))
                except OSError:
                    found.append({})
            yield pd.DataFrame({"path": batch["path"]} | {c: pd.Series([d.get(c) for d in found], dtype=object, index=batch.index) for c in DATES.values()})

    return files.select("path", uri_col).mapInPandas(run, SCHEMA)


def dates_of_heads(heads: DataFrame, head_col: str = "head", *, exif_directory: bool = True) -> DataFrame:
    """heads: path and a binary column with the first bytes of files, or all. SCHEMA, as capture_dates gives it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [dates_of(lambda at, n, data=data: bytes(data[at : at + n]) if at >= 0 else b"", exif_directory) if data is not None else {} for data in batch[head_col]]
            yield pd.DataFrame({"path": batch["path"]} | {c: pd.Series([d.get(c) for d in found], dtype=object, index=batch.index) for c in DATES.values()})

    return heads.select("path", head_col).mapInPandas(run, SCHEMA)


def photo_order(spark: SparkSession, root: str, *, recursive: bool = True, exif_directory: bool = True) -> DataFrame:
    """What series are ordered by, of all files below root: capture times from the files, else the file's time."""
    files = files_at(spark, root, recursive=recursive)
    dates = capture_dates(files, exif_directory=exif_directory)
    return item_order(dates.join(files.select("path", F.col("modified").alias("mtime")), "path"))
