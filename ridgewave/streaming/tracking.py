"""Tracks of detections as a stateful stream processor with event-time timers, and the same lifecycles over a table.

State of a key: a map of its open tracks, each by its fields, the frames that may still have a predecessor, and the next track number.
A frame is taken when the watermark has passed it, so frames that come out of order count in order; a track ends when the watermark
shows that it hasn't been seen for longer than its age, whether or not the key gets another row.  Rows behind the watermark are
dropped by the stream.  Numbers of open tracks and waiting frames of a key bound its state.

Streams need ``spark.sql.streaming.stateStore.providerClass`` set to Spark's RocksDB provider, which keeps state by field.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .state import TRACK_OUT, Step, advance, replay, track_row

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = f"event string, {TRACK_OUT}"


def _events(opened: list[dict], ended: list[dict], t: float, max_age_s: float) -> list[dict]:
    return [{"event": "ended", **track_row(x, x["last"] + max_age_s)} for x in ended] + [{"event": "seen", **track_row(x, t)} for x in opened]


def lifecycle_step(max_gap_hz: float, max_age_s: float = 1.0) -> Step:
    """Rows with t and hz: each frame's tracks ("seen"), and each track when a frame shows that it's over ("ended")."""

    def step(state, row):
        state = state or {"next": 0, "tracks": []}
        tracks, number, ended = advance(state["tracks"], state["next"], row["t"], row["hz"], max_gap_hz, max_age_s)
        return {"next": number, "tracks": tracks}, _events(tracks, ended, row["t"], max_age_s)

    return step


class Tracker(StatefulProcessor):
    def __init__(self, key: str, max_gap_hz: float, max_age_s: float = 1.0):
        self.key, self.gap, self.age = key, max_gap_hz, max_age_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "n long")
        self.tracks = handle.getMapState("tracks", "id long", "hz double, first double, last double, seen long")
        self.waiting = handle.getListState("waiting", "t double, hz array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(t.value / 1e9, [float(x) for x in hz]) for t, hz in zip(frame["ts"], frame["hz"])])
        yield self._advanced(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advanced(key, timerValues.getCurrentWatermarkInMs())

    def _advanced(self, key: tuple, watermark_ms: int) -> pd.DataFrame:
        now = watermark_ms / 1000
        frames = sorted(self.waiting.get(), key=lambda f: f[0]) if self.waiting.exists() else []
        due = [f for f in frames if f[0] <= now]
        out: list[dict] = []
        tracks = [{"id": k[0], "hz": v[0], "first": v[1], "last": v[2], "seen": v[3]} for k, v in self.tracks.iterator()]
        tracks.sort(key=lambda x: x["id"])
        before = {x["id"]: x for x in tracks}
        number = self.number.get()[0] if self.number.exists() else 0
        for t, hz in due:
            tracks, number, ended = advance(tracks, number, t, hz, self.gap, self.age)
            out += _events(tracks, ended, t, self.age)
        over = [x for x in tracks if now - x["last"] > self.age]
        out += _events([], over, now, self.age)
        tracks = [x for x in tracks if now - x["last"] <= self.age]
        self._keep(before, tracks, number, frames[len(due) :], bool(due))
        made = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        made.insert(0, self.key, key[0])
        return made

    def _keep(self, before: dict, tracks: list[dict], number: int, waiting: list[tuple], moved: bool) -> None:
        """Write what has changed, and wake up at the next frame or the next end."""
        open_ = {x["id"]: x for x in tracks}
        for k in before.keys() - open_.keys():
            self.tracks.removeKey((k,))
        for k, x in open_.items():
            if before.get(k) != x:
                self.tracks.updateValue((k,), (x["hz"], x["first"], x["last"], x["seen"]))
        self.number.update((number,))
        if moved:
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
        wake = [f[0] for f in waiting[:1]] + [x["last"] + self.age + 0.001 for x in tracks]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wake:
            self.handle.registerTimer(math.ceil(min(wake) * 1000))

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, key: str, max_gap_hz: float, max_age_s: float = 1.0, late: str = "2 seconds") -> DataFrame:
    """Lifecycles of a stream of frames (key, ts timestamp, hz array<double>)."""
    kind = frames.schema[key].dataType.simpleString()
    rows = frames.select(key, "ts", "hz").withWatermark("ts", late)
    return rows.groupBy(key).transformWithStateInPandas(Tracker(key, max_gap_hz, max_age_s), f"{key} {kind}, {OUT}", "Append", "EventTime")


def track_table(frames: DataFrame, key: str, max_gap_hz: float, max_age_s: float = 1.0) -> DataFrame:
    """Lifecycles of a table of the same frames; tracks that no later frame ends are left open."""
    timed = frames.select(key, (F.unix_micros("ts") / 1e6).alias("t"), "hz")
    return replay(timed, key, lifecycle_step(max_gap_hz, max_age_s), OUT)
