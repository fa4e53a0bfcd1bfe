"""Media columns: texts stored losslessly as PNG in a binary column, read back and hashed.

A payload's bytes are the samples of an RGB image of 64 pixels a row. The writer filters
each row by the kind (none, sub or up) with the smallest sum of magnitudes and compresses
the rows into one zlib stream; the reader checks signature, order, length and CRC of every
chunk and the stream's own checksum, and undoes all five filter kinds in numpy. The feature
is a perceptual hash: the grey image is averaged down to 32 x 32, and each of the 8 x 8
lowest frequencies of its cosine transform gives a bit, whether it is above their median.

Defined results: a null or empty text is a payload of spaces; equal texts have equal media;
a null medium gives null features; damaged media raise an error that names the fault; null ids
and repeated rows stay; an empty table gives an empty table; a very long text is one image, held
by one task; of the input only the columns to keep stay, and those named as results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.bpe import text_slices

#: Fixed values of the format: its signature, channels by colour type, and chunk names.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH, ROW = 64, 192


def payload(text: bytes, multiple: int = ROW) -> bytes:
    return text + b" " * (-len(text) % multiple or (0 if text else multiple))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """samples: uint8 of shape (rows, columns, channels)."""
    height, width, channels = samples.shape
    colour = next(k for k, n in CHANNELS.items() if n == channels)
    rows = samples.reshape(height, width * channels)
    sub, up = rows.copy(), rows.copy()
    sub[:, channels:] -= rows[:, :-channels]
    up[1:] -= rows[:-1]
    kinds = np.stack([rows, sub, up])
    cost = np.minimum(kinds, -kinds).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    filtered = np.empty((height, 1 + width * channels), np.uint8)
    filtered[:, 0] = best
    filtered[:, 1:] = kinds[best, np.arange(height)]
    header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), level)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG: wrong signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("PNG is cut off")
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4:
            raise ValueError("PNG is cut off")
        if zlib.crc32(kind + body) != int.from_bytes(crc, "big"):
            raise ValueError(f"PNG chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("PNG has no end")


def _average(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for i in range(len(row)):
        left = int(row[i - step]) if i >= step else 0
        row[i] = (int(row[i]) + (left + int(above[i])) // 2) & 255


def _paeth(row: np.ndarray, above: np.ndarray, step: int) -> None:
    for i in range(len(row)):
        a, c = (int(row[i - step]), int(above[i - step])) if i >= step else (0, 0)
        b = int(above[i])
        pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        row[i] = (int(row[i]) + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255


def unfilter(filtered: np.ndarray, channels: int) -> np.ndarray:
    """filtered: uint8 rows, each after its filter kind."""
    kinds, rows = filtered[:, 0], filtered[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("PNG has an unknown filter kind")
    subs = kinds == 1
    if subs.any():
        pixels = rows[subs].reshape(int(subs.sum()), -1, channels)
        rows[subs] = np.add.accumulate(pixels, axis=1, dtype=np.uint8).reshape(len(pixels), -1)
    nothing = np.zeros(rows.shape[1], np.uint8)
    for y in np.flatnonzero(kinds > 1):
        above = rows[y - 1] if y else nothing
        if kinds[y] == 2:
            rows[y] += above
        else:
            (_average if kinds[y] == 3 else _paeth)(rows[y], above, channels)
    return rows


def read_png(data: bytes) -> np.ndarray:
    """uint8 samples of shape (rows, columns, channels) of an 8-bit image without interlace or palette."""
    header, body, ended = b"", [], False
    for k, (kind, part) in enumerate(_chunks(data)):
        if (k == 0) != (kind == b"IHDR"):
            raise ValueError("PNG does not begin with one header")
        if kind == b"IHDR":
            header = part
        elif kind == b"IDAT":
            body.append(part)
        ended = kind == b"IEND"
        if not ended and kind[:1].isupper() and kind not in (b"IHDR", b"IDAT"):
            raise ValueError(f"PNG chunk {kind!r} is not supported")
    width, height = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big")
    if len(header) != 13 or header[8] != 8 or header[9] not in CHANNELS or header[12]:
        raise ValueError("PNG kind is not supported")
    channels = CHANNELS[header[9]]
    stream = zlib.decompressobj()
    raw = stream.decompress(b"".join(body)) + stream.flush()
    if not stream.eof or stream.unused_data or len(raw) != height * (1 + width * channels):
        raise ValueError("PNG samples are incomplete")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), channels).reshape(height, width, channels)


def _average_down(grey: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Means over size equal stretches along axis, counting parts of cells."""
    n = grey.shape[axis]
    sums = np.insert(np.cumsum(grey, axis=axis), 0, 0, axis=axis)
    edges = np.arange(size + 1) * (n / size)
    whole = np.minimum(edges.astype(int), n - 1)
    part = np.expand_dims(edges - whole, tuple(i for i in range(grey.ndim) if i != axis))
    at = np.take(sums, whole, axis) + part * np.take(grey, whole, axis)
    return np.diff(at, axis=axis) * (size / n)


def cosine_hash(samples: np.ndarray, size: int = 32, low: int = 8) -> str:
    """Hexadecimal; the first bit is that of the constant term."""
    grey = samples.mean(axis=2)
    small = _average_down(_average_down(grey, size, 0), size, 1)
    k, x = np.arange(low)[:, None], np.arange(size)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * size))
    waves = np.round(basis @ small @ basis.T, 6).ravel()
    bits = waves > np.median(waves)
    return np.packbits(bits).tobytes().hex()


def store_texts(docs: DataFrame, *, text_col: str = "text", media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, text_bytes long (before padding) and media binary."""
    kept = [docs.schema[c] for c in keep if c not in ("text_bytes", media_col)]
    schema = T.StructType([*kept, T.StructField("text_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, some in text_slices(batch, text_col):
                part = batch.slice(rows.start, len(rows))
                media = [write_png(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH, 3)) for t in some]
                columns = {f.name: part.column(part.schema.get_field_index(f.name)) for f in kept}
                yield pa.RecordBatch.from_pydict(columns | {"text_bytes": pa.array(map(len, some), pa.int64()), media_col: pa.array(media, pa.binary())})

    return docs.select(*dict.fromkeys([f.name for f in kept] + [text_col])).mapInArrow(run, schema)


def media_features(stored: DataFrame, *, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of the media read back."""
    added = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType()}
    arrow = {T.LongType: pa.int64(), T.StringType: pa.string()}
    kept = [stored.schema[c] for c in keep if c not in added]
    schema = T.StructType(kept + [T.StructField(k, t) for k, t in added.items()])

    def of(medium: bytes | None) -> tuple:
        if medium is None:
            return (None,) * len(added)
        samples = read_png(medium)
        data = samples.tobytes()
        return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(medium), hashlib.sha256(medium).hexdigest(), cosine_hash(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(m) for m in batch.column(batch.schema.get_field_index(media_col)).to_pylist()]
            columns = {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept}
            for k, (name, kind) in enumerate(added.items()):
                columns[name] = pa.array([x[k] for x in found], arrow[type(kind)])
            yield pa.RecordBatch.from_pydict(columns)

    return stored.mapInArrow(run, schema)
