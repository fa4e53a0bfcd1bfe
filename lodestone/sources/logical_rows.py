"""Rows of one delimited file that is read in chunks, where cells may hold line ends.

Spark cuts a file into chunks and these into lines. Whether a line begins inside of a quoted
cell depends on all lines before it, but every line is a function from two states (outside,
inside) to two, and functions of lines compose. So each task follows both states through its
chunk and counts the rows that begin under each; the chunks' functions, one row for each, are
composed in their order by a prefix scan, which says for every chunk in which state it begins
and how many rows came before. Then lines know their rows: most are a row of their own, the
others meet their row's other lines in one exchange. Numbers are counts within a chunk plus
prefix sums over chunks; there is no window over all rows.

Quoting is that of Python's csv module: a quote opens a cell only where the cell begins, two
of them stand for one inside, and what follows a closing one is taken as it is. Lines end in
\\n or \\r\\n. A row of more than LONGEST characters is an error, as a quote is open that should
not be.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.storage import written

#: Characters of a row at most.
LONGEST = 16 << 20
OUTSIDE, INSIDE = 0, 1


class LineStates:
    """The state after a line, from the state before it."""

    def __init__(self, sep: str) -> None:
        s = re.escape(sep)
        rest = rf'(?:[^{s}"][^{s}]*+)?'
        cell = rf'(?:"(?:[^"]++|"")*+"{rest}|[^{s}"][^{s}]*+|)'
        self.outside = re.compile(rf"{cell}(?:{s}{cell})*+", re.DOTALL)
        self.inside = re.compile(rf'(?:[^"]++|"")*+"{rest}(?:{s}{cell})*+', re.DOTALL)

    def after(self, line: str, state: int) -> int:
        if '"' not in line:
            return state
        return OUTSIDE if (self.inside if state else self.outside).fullmatch(line) else INSIDE


def chunk_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Lines with chunk (where it begins in the file) and at (their order in it); for each state that the chunk may begin in: begun (rows that began in the chunk up to the line), starts (whether the line begins one) and open (whether its row goes on)."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("at"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = LineStates(sep)
        now, begun, chunk = [OUTSIDE, INSIDE], [0, 0], None
        for batch in batches:
            out: dict[str, list] = {f"{n}{k}": [] for k in (OUTSIDE, INSIDE) for n in ("begun", "starts", "open")}
            for here, line in zip(batch.column("chunk").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if here != chunk:
                    now, begun, chunk = [OUTSIDE, INSIDE], [0, 0], here
                for k in (OUTSIDE, INSIDE):
                    starts = now[k] == OUTSIDE
                    begun[k] += starts
                    now[k] = states.after(line, now[k])
                    out[f"starts{k}"].append(starts)
                    out[f"begun{k}"].append(begun[k])
                    out[f"open{k}"].append(now[k] == INSIDE)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.int64() if n[:-1] == "begun" else pa.bool_()) for n, v in out.items())], names=[*batch.schema.names, *out])

    added = ", ".join(f"begun{k} long, starts{k} boolean, open{k} boolean" for k in (OUTSIDE, INSIDE))
    return lines.mapInArrow(run, f"chunk long, at long, value string, {added}")


def chunk_starts(lines: DataFrame) -> list[tuple[int, int, int]]:
    """For each chunk: where it begins, its first state and how many rows began before it. One row of each chunk comes to the driver."""
    last = lines.groupBy("chunk").agg(F.max_by(F.struct(*[f"{n}{k}" for k in (OUTSIDE, INSIDE) for n in ("begun", "open")]), "at").alias("last"))
    state, before, out = OUTSIDE, 0, []
    for r in sorted(last.collect(), key=lambda r: r["chunk"]):
        out.append((r["chunk"], state, before))
        before, state = before + r["last"][f"begun{state}"], int(r["last"][f"open{state}"])
    return out


def row_texts(lines: DataFrame) -> DataFrame:
    """(row, chunk, text): rows by their number, with the chunk in which they begin."""
    starts = lines.sparkSession.createDataFrame(chunk_starts(lines), "chunk long, state int, before long")
    known = lines.join(F.broadcast(starts), "chunk")  # one row for each chunk
    of = lambda name: F.when(F.col("state") == OUTSIDE, F.col(f"{name}{OUTSIDE}")).otherwise(F.col(f"{name}{INSIDE}"))
    placed = known.select((F.col("before") + of("begun")).alias("row"), "chunk", "at", "value", (of("starts") & ~of("open")).alias("whole"))
    parts = placed.where(~F.col("whole"))
    longest = parts.groupBy("row").agg(F.sum(F.char_length("value") + 1).alias("n")).agg(F.max("n")).first()[0]
    if longest and longest > LONGEST:
        raise ValueError(f"a row has {longest} characters: a quote is not closed")
    met = parts.groupBy("row").agg(F.min("chunk").alias("chunk"), F.array_sort(F.collect_list(F.struct("chunk", "at", "value"))).alias("lines"))
    return placed.where("whole").select("row", "chunk", F.col("value").alias("text")).unionByName(met.select("row", "chunk", F.array_join("lines.value", "\n").alias("text")))


def cells_of(rows: DataFrame, sep: str) -> DataFrame:
    """rows with cells, stripped, in place of text; those whose cells are all empty go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST)
        for batch in batches:
            found = [[c.strip() for c in next(csv.reader(io.StringIO(t, newline=""), delimiter=sep), [])] for t in batch.column("text").to_pylist()]
            some = pa.array([any(c) for c in found], pa.bool_())
            out = [batch.column("row"), batch.column("chunk"), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "chunk", "cells"]).filter(some)

    return rows.mapInArrow(run, "row long, chunk long, cells array<string>")


def numbered_rows(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(number, cells): the rows of a file after its first, without blank ones, numbered from 2 in file order."""
    lines = written(chunk_lines(spark, path, sep), "manifest-lines")
    rows = written(cells_of(row_texts(lines), sep).where("row > 1"), "manifest-rows")
    counts = sorted(tuple(r) for r in rows.groupBy("chunk").agg(F.count("*").alias("n")).collect())
    before, offsets = 1, []
    for chunk, n in counts:
        offsets.append((chunk, before))
        before += n
    within = F.row_number().over(Window.partitionBy("chunk").orderBy("row"))
    numbered = rows.withColumn("number", within).join(F.broadcast(spark.createDataFrame(offsets, "chunk long, before long")), "chunk")
    return numbered.select((F.col("before") + F.col("number")).alias("number"), "cells")
