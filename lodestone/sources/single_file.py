"""A sink that makes one ordered text file out of all partitions.

Rows come as lines that Spark has formatted. Every task writes its lines to a part of its own
beside the target, named by partition and attempt, and reports its length; lines are copied
out of the Arrow buffer as they lie there. The commit takes the parts of the attempts that
Spark counts, in order of partition, appends them by the system's copying of file ranges and
puts the whole in the target's place. The driver holds names and lengths, never a row. An
abort, a task that fails and an attempt that is repeated leave nothing behind.

The target lies in a folder that the driver and all executors share. Lines come in the order
of the partitions, so a DataFrame sorted as a whole gives a file sorted as a whole.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "single_text_file"
#: Bytes that one call copies at most.
COPY = 64 << 20


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    length: int


def _copy(source: int, target: int, length: int) -> None:
    """length bytes from one open file to the end of another, in the kernel where it can."""
    left = length
    while left:
        try:
            done = os.copy_file_range(source, target, min(left, COPY))
        except OSError:  # the folder's file system has no such call
            done = os.write(target, os.read(source, min(left, COPY)))
        if not done:
            raise OSError("a part is shorter than its task said")
        left -= done


class SingleFileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: bytes) -> None:
        self.path, self.head = Path(path), head
        self.parts = self.path.with_name(f".{self.path.name}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        self.parts.mkdir(parents=True, exist_ok=True)
        part = self.parts / f"{task.partitionId():06d}-{task.taskAttemptId()}"
        try:
            with part.open("wb") as f:
                for batch in iterator:
                    lines = batch.column(0).cast(pa.large_binary())
                    if lines.null_count:
                        raise ValueError("a line is null")
                    for line in _bytes_of(lines):
                        f.write(line)
                f.flush()
                os.fsync(f.fileno())
                return Part(task.partitionId(), part.name, f.tell())
        except BaseException:
            part.unlink(missing_ok=True)
            raise

    def commit(self, messages: list[Part | None]) -> None:
        self.parts.mkdir(parents=True, exist_ok=True)
        whole = self.parts / "whole"
        with whole.open("wb", buffering=0) as f:
            f.write(self.head)
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with (self.parts / m.name).open("rb", buffering=0) as part:
                    _copy(part.fileno(), f.fileno(), m.length)
            os.fsync(f.fileno())
        os.replace(whole, self.path)
        shutil.rmtree(self.parts)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


def _bytes_of(lines: pa.LargeBinaryArray) -> Iterator[memoryview]:
    """The values, one after the other as they lie in the buffer."""
    _, offsets, values = lines.buffers()
    if values is None or not len(lines):
        return
    ends = memoryview(offsets).cast("q")
    yield memoryview(values)[ends[lines.offset] : ends[lines.offset + len(lines)]]


class SingleFileSource(DataSource):
    """Options: path, and head (what the file begins with), as hexadecimal digits."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> SingleFileWriter:
        return SingleFileWriter(self.options["path"], bytes.fromhex(self.options.get("head", "")))


def write_lines(lines: DataFrame, path: str | Path, head: bytes = b"") -> None:
    """lines: one column of text, each with its own line end. One file of head and all lines in the order of the partitions, replaced as a whole."""
    path = Path(path).absolute()
    path.parent.mkdir(parents=True, exist_ok=True)
    lines.sparkSession.dataSource.register(SingleFileSource)
    lines.write.format(FORMAT).option("head", head.hex()).mode("append").save(str(path))
