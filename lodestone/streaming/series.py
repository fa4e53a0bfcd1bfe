"""Series of an unbounded stream of frames, settled at the watermark.

Frames may come in any order within the watermark's delay. When the watermark passes a frame,
all that stands before it is known, so what it gives is what the batch operator gives for
entities ordered by time. Two keyed steps follow each other in one query: a folder's step names
the frame that each frame may follow there (its number, its time and the guard against foreign
frames decide), an entity's step numbers the series.

A folder's state is its frames of the last keep_seconds, an entity's is its last frame. Both go
keep_seconds after the last of them: state does not grow with the stream, frames further apart
begin a series, and an entity that was away for so long is numbered from 1 again (series_first
tells such series apart).

Defined results: frames older than the watermark when they come are late and dropped by Spark,
as its numbers of dropped rows tell; frames without a time or path are left to the batch
operator; a null entity is one of its own; a frame that repeats counts again, but adds no foreign
frame; of frames at one time the order is that of the batch operator: number, then path.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.config import Settings
from lodestone.operators.series import LAST

#: The state store that keyed steps with timers need, as a setting of the session.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_FRAME = "entity_id string, path string, dir string, prefix string, seq long, micros long, time_is_metadata boolean"
_FOLLOWING = "entity_id string, path string, dir string, seq long, capture_time timestamp, after string"
OUTPUT = "entity_id string, path string, capture_time timestamp, seq long, series_index long, series_first string"


class Frame(NamedTuple):
    entity_id: str | None
    path: str
    dir: str
    prefix: str | None
    seq: int | None
    micros: int
    time_is_metadata: bool | None


def _number(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def _order(f: Frame) -> tuple:
    return f.micros, LAST if f.seq is None else f.seq, f.path.lower(), f.path


def _time(micros: pd.Series) -> pd.Series:
    return pd.to_datetime(micros, unit="us")


class Folder:
    """The frames of a folder (of folders whose names differ in case), in order, and the frame that each may follow."""

    def __init__(self, frames: list[Frame], s: Settings) -> None:
        self.frames, self.s = sorted(frames, key=_order), s
        shown: dict[tuple, set] = {}
        for f in self.frames:
            shown.setdefault((f.path, f.dir, f.prefix, f.seq, f.micros), set()).add(f.entity_id)
        self.by_number: dict[tuple, list[set]] = {}
        times: dict[str, list[tuple[int, set]]] = {}
        for (_, folder, prefix, seq, micros), entities in shown.items():
            if seq is not None and prefix is not None:
                self.by_number.setdefault((prefix, seq), []).append(entities)
            times.setdefault(folder, []).append((micros, entities))
        self.times = {d: sorted(t, key=lambda x: x[0]) for d, t in times.items()}

    def _joins(self, before: Frame, f: Frame) -> bool:
        numbered = f.seq is not None and before.seq is not None
        if numbered and not (f.prefix is not None and f.prefix == before.prefix and 0 < f.seq - before.seq <= self.s.series_gap_numbers):
            return False
        timed = bool(f.time_is_metadata and before.time_is_metadata) or not numbered
        return not timed or f.micros - before.micros <= int(self.s.series_gap_seconds * 1_000_000)

    def _between(self, before: Frame, f: Frame) -> Iterator[set]:
        """The entities of each path between two frames that would join."""
        if f.seq is not None and before.seq is not None:
            for n in range(before.seq + 1, f.seq):
                yield from self.by_number.get((f.prefix, n), ())
        else:
            times = self.times[f.dir]
            low = bisect.bisect_right(times, before.micros, key=lambda x: x[0])
            high = bisect.bisect_left(times, f.micros, key=lambda x: x[0])
            for i in range(low, high):
                yield times[i][1]

    def _guarded(self, before: Frame, f: Frame) -> bool:
        foreign = Counter(e for entities in self._between(before, f) if f.entity_id not in entities for e in entities)
        return 0 < self.s.foreign_frames <= max(foreign.values(), default=0)

    def following(self, above: int, upto: int) -> list[tuple[Frame, str | None]]:
        """(frame, path of the frame it may follow) of the frames with above < micros <= upto."""
        last: dict[tuple, Frame] = {}
        out = []
        for f in self.frames:
            if f.micros > upto:
                break
            before = last.get((f.entity_id, f.dir))
            last[f.entity_id, f.dir] = f
            if f.micros > above:
                joins = before is not None and self._joins(before, f) and not self._guarded(before, f)
                out.append((f, before.path if joins else None))
        return out


class _Folders(StatefulProcessor):
    def __init__(self, s: Settings, keep: int) -> None:
        self.s, self.keep = s, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", _FRAME)
        self.settled = handle.getValueState("settled", "micros long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for part in rows:
            new = [(r.entity_id, r.path, r.dir, r.prefix, _number(r.seq), int(r.micros), None if pd.isna(r.time_is_metadata) else bool(r.time_is_metadata)) for r in part.itertuples(index=False)]
            self.frames.appendList(new)
            first = min([r[5] for r in new] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        above = self.settled.get()[0] if self.settled.exists() else -(2**63)
        frames = [Frame(*r) for r in self.frames.get()]
        if upto > above:
            found = Folder(frames, self.s).following(above, upto)
            kept = [f for f in frames if f.micros > upto - self.keep]
            if kept:
                self.frames.put([tuple(f) for f in kept])
                self.settled.update((upto,))
                waiting = [f.micros for f in kept if f.micros > upto]
                self.handle.registerTimer(-(-min(waiting) // 1000) if waiting else -(-(max(f.micros for f in kept) + self.keep) // 1000))
            else:
                self.frames.clear()
                self.settled.clear()
            if found:
                out = pd.DataFrame([(f.entity_id, f.path, f.dir, f.seq, f.micros, after) for f, after in found], columns=["entity_id", "path", "dir", "seq", "capture_time", "after"])
                yield out.astype({"seq": "Int64"}).assign(capture_time=_time(out["capture_time"]))

    def close(self) -> None:
        pass


class _Entities(StatefulProcessor):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "path string, dir string, micros long, series long, first string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        path, folder, micros, series, first = self.last.get() if self.last.exists() else (None, None, None, 0, None)
        mine = [(r.path, r.dir, _number(r.seq), r.capture_time.value // 1000, r.after) for part in rows for r in part.itertuples(index=False)]
        mine.sort(key=lambda r: (r[3], LAST if r[2] is None else r[2], r[0].lower(), r[0]))  # a folder's frames come settled, those of all folders together
        out = []
        for p, d, seq, at, after in mine:
            if after is None or (after, d) != (path, folder):
                series, first = series + 1, p
            path, folder, micros = p, d, at
            out.append((key[0], p, at, seq, series, first))
        self.last.update((path, folder, micros, series, first))
        self.handle.registerTimer(-(-(micros + self.keep) // 1000))
        frame = pd.DataFrame(out, columns=["entity_id", "path", "capture_time", "seq", "series_index", "series_first"]).astype({"seq": "Int64"})
        yield frame.assign(capture_time=_time(frame["capture_time"]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.last.exists() and self.last.get()[2] + self.keep <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def series_of_stream(frames: DataFrame, s: Settings, *, delay: str = "1 minute", keep_seconds: float = 3600.0) -> DataFrame:
    """frames: a stream of entity_id, path, dir, prefix, seq long, capture_time timestamp, time_is_metadata. delay: how late a frame may come.

    The session's state store must be the one of STORE.
    """
    spark = frames.sparkSession
    if keep_seconds < s.series_gap_seconds:
        raise ValueError("keep_seconds is shorter than the gap of a series")
    if spark.conf.get(STORE[0], "") != STORE[1]:
        raise ValueError(f"{STORE[0]} must be {STORE[1]}")
    keep = int(keep_seconds * 1_000_000)
    timed = frames.where("capture_time IS NOT NULL AND path IS NOT NULL").withWatermark("capture_time", delay)
    keyed = timed.withColumns({"folder": F.lower("dir"), "micros": F.unix_micros("capture_time")})
    keyed = keyed.select("folder", "capture_time", "entity_id", "path", "dir", "prefix", "seq", "micros", "time_is_metadata")
    following = keyed.groupBy("folder").transformWithStateInPandas(_Folders(s, keep), _FOLLOWING, "append", "eventTime", eventTimeColumnName="capture_time")
    return following.groupBy("entity_id").transformWithStateInPandas(_Entities(keep), OUTPUT, "append", "eventTime")
