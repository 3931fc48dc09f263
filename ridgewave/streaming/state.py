"""Keyed state over streams: tracks, running spectra, alert cooldowns, throttles.

Each operator is a plain step function (state, row) -> (state, output) and is used twice: in a stream with
``applyInPandasWithState``, and in a batch replay that sorts the rows of a key, so that both can be compared.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import Cooldown, Throttle, scan

Step = Callable[[dict | None, dict], tuple[dict, list[dict]]]


def advance(tracks: list[dict], number: int, t: float, places: list[float], max_gap_hz: float, max_age_s: float) -> tuple[list[dict], int, list[dict]]:
    """Open tracks after a frame at ``t``, the next track's number, and the tracks that are over."""
    known = [dict(x) for x in tracks if t - x["last"] <= max_age_s]
    ended = [x for x in tracks if t - x["last"] > max_age_s]
    at = [x["hz"] for x in known]
    opened = []
    for hz in places:
        gaps = [abs(hz - p) for p in at]
        k = min(range(len(gaps)), key=gaps.__getitem__, default=None)
        if k is not None and gaps[k] < max_gap_hz:
            known[k] |= {"hz": hz, "last": t, "seen": known[k]["seen"] + 1}
        else:
            opened.append({"id": number, "hz": hz, "first": t, "last": t, "seen": 1})
            number += 1
    return known + opened, number, ended


def track_row(x: dict, t: float) -> dict:
    return {"t": t, "track_id": f"trk-{x['id']:06d}", "hz": x["hz"], "first_seen": x["first"], "last_seen": x["last"], "frames_seen": x["seen"], "duty_cycle": 1.0}


def track_step(max_gap_hz: float, max_age_s: float = 1.0) -> Step:
    """Frames of detections to tracks.

    A row is a frame: t in seconds and hz, the frequencies of its detections in order.  A detection joins the
    nearest track less than ``max_gap_hz`` away among the tracks known before the frame; otherwise it opens one.
    A track that isn't seen for more than ``max_age_s`` ends.
    """

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        state = state or {"next": 0, "tracks": []}
        tracks, number, _ = advance(state["tracks"], state["next"], row["t"], row["hz"], max_gap_hz, max_age_s)
        return {"next": number, "tracks": tracks}, [track_row(x, row["t"]) for x in tracks]

    return step


TRACK_OUT = "t double, track_id string, hz double, first_seen double, last_seen double, frames_seen long, duty_cycle double"


def alert_step(cooldown_s: float) -> Step:
    """Rows with t; those at least a cooldown after the last alert come out."""

    def step(state, row):
        if state and row["t"] - state["last"] < cooldown_s:
            return state, []
        return {"last": row["t"]}, [row]

    step.scan = lambda df, key, order: scan(df, key, (order,), ("t",), Cooldown(cooldown_s))
    return step


def ema_step(alpha: float) -> Step:
    """Rows with t and x (array); the running average comes out."""

    def step(state, row):
        x = list(row["x"])
        new = x if state is None else [alpha * a + (1 - alpha) * b for a, b in zip(x, state["x"])]
        return {"x": new}, [{"t": row["t"], "x": new}]

    return step


def throttle_step(on: float = 85.0, off: float = 50.0) -> Step:
    """Rows with t and fill; throttling starts above ``on`` and stops below ``off``."""

    def step(state, row):
        active = bool(state and state["active"])
        active = row["fill"] > on or (active and row["fill"] >= off)
        return {"active": active}, [{"t": row["t"], "fill": row["fill"], "throttled": active}]

    step.scan = lambda df, key, order: scan(df, key, (order,), ("fill",), Throttle(on, off), "throttled boolean")
    return step


def normalize_step(rate: float = 0.01, least: float = 1e-6) -> Step:
    """Rows with event_id and x (array): each against the mean and deviation of the rows before it.

    The mean is exact; the deviation follows the size of the steps from the mean at ``rate``.  The first row comes
    out as it is.
    """

    def step(state, row):
        x = [float(v) for v in row["x"]]
        if state is None:
            return {"n": 1, "mean": x, "dev": [1e-6] * len(x)}, [{"event_id": row["event_id"], "z": x}]
        n, off = state["n"] + 1, [v - m for v, m in zip(x, state["mean"])]
        z = [d / max(s, least) for d, s in zip(off, state["dev"])]
        new = {"n": n, "mean": [m + d / n for m, d in zip(state["mean"], off)], "dev": [(1 - rate) * s + rate * abs(d) for s, d in zip(state["dev"], off)]}
        return new, [{"event_id": row["event_id"], "z": z}]

    return step


def lost_blocks(df: DataFrame, key: str, sequence: str, size: int) -> DataFrame:
    """Blocks and samples received, samples lost to gaps in a key's sequence numbers, and the drop rate; repeated numbers count once."""
    n, span = F.count_distinct(sequence), F.max(sequence) - F.min(sequence) + 1
    return df.groupBy(key).agg(n.alias("blocks"), (n * size).alias("received"), ((span - n) * size).alias("lost"), (100 * (span - n) / span).alias("drop_percent"))


def recluster(rows: DataFrame, cluster: Callable[[DataFrame], DataFrame], target: str, order: str = "ts", last: int = 1000, min_rows: int = 5, checkpoint: str | None = None):
    """A streaming query that clusters the most recent rows after every micro-batch and replaces the table ``target``.

    The ``last`` rows by ``order`` are all that is kept: a batch makes them from its own rows and the table of the batch before, in
    one of two tables by turns, so a batch that is run again finds what it found at first, and no row counts twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine, before = (f"{target}_rows_{n % 2}" for n in (number, number + 1))
        if number and spark.catalog.tableExists(before):
            batch = batch.unionByName(spark.table(before))
        batch.orderBy(F.desc(order), F.xxhash64(*batch.columns)).limit(last).write.mode("overwrite").saveAsTable(mine)
        recent = spark.table(mine)
        if recent.count() >= min_rows:
            cluster(recent).write.mode("overwrite").saveAsTable(target)

    writer = rows.writeStream.foreachBatch(run)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()


def supervised(start: Callable[[], object], most: int = 10, on_error: Callable[[dict], None] | None = None, pause_s: float = 0.1) -> object:
    """Run a streaming query to its end, and start it again when it fails; its checkpoint makes that safe.

    ``start`` starts the query.  After ``most`` failures in a row, without a finished batch between them, ``on_error`` is told
    state, message and number, and the last failure is raised.  Returns the query that ended.
    """
    failures, seen = 0, None
    while True:
        try:
            query = start()
            query.awaitTermination()
            return query
        except Exception as e:  # noqa: BLE001
            done = getattr(query, "lastProgress", None) if "query" in locals() else None
            batch = done["batchId"] if done else None
            failures = 1 if batch is not None and batch != seen else failures + 1
            seen = batch if batch is not None else seen
            if failures >= most:
                if on_error:
                    on_error({"state": "error", "message": str(e), "consecutive_errors": failures})
                raise
            time.sleep(pause_s)


def stream(df: DataFrame, key: str, step: Step, output: str, order: str = "t", timeout_s: int | None = None) -> DataFrame:
    """The step over a stream; rows of a key are taken in the order of ``order`` inside each micro-batch."""
    kind = df.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in output.split(", ")]

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order, kind="stable").to_dict("records")
        out = []
        for row in rows:
            held, made = step(held, {c: v.tolist() if hasattr(v, "tolist") and not isinstance(v, float) else v for c, v in row.items()})
            out += made
        state.update((json.dumps(held),))
        if timeout_s:
            state.setTimeoutDuration(timeout_s * 1000)
        frame = pd.DataFrame(out, columns=names)
        frame.insert(0, key, k[0])
        yield frame

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_s else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {output}", "state string", "append", timeout)


def replay(df: DataFrame, key: str, step: Step, output: str, order: str = "t") -> DataFrame:
    """The step over a table: where runs of the step compose, a key is spread over tasks; else keys are sorted and streamed, one state in memory at a time."""
    if hasattr(step, "scan"):
        return step.scan(df, key, order).select(key, *(c.split()[0] for c in output.split(", ")))
    kind = df.schema[key].dataType.simpleString()
    names = [c.split()[0] for c in output.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), None
        for frame in frames:
            keys, out = [], []
            for row in frame.to_dict("records"):
                if row[key] != now:
                    now, held = row[key], None
                held, made = step(held, {c: v.tolist() if hasattr(v, "tolist") and not isinstance(v, float) else v for c, v in row.items()})
                keys += [now] * len(made)
                out += made
            got = pd.DataFrame(out, columns=names)
            got.insert(0, key, keys)
            yield got

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {kind}, {output}")


def rates(events: DataFrame, ts: str = "ts", every: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Counts by event-time window with a watermark; errors are overflows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_over"))


def first_in_bucket(events: DataFrame, key: str, ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """A rate limit on a stream: one row for each key and bucket column, within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, "bucket"])


def iq_stream(spark, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Live blocks (capture_id, seq, ts, center_freq_hz, sample_rate_hz, overflow, i, q) as they land in a folder; the rate limit takes the place of a ring buffer."""
    schema = "capture_id string, seq long, ts timestamp, center_freq_hz double, sample_rate_hz double, overflow boolean, i array<float>, q array<float>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
