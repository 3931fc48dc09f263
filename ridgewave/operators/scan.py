"""Recurrences over a key's rows in order, in parallel inside a key.

A recurrence says what one row does to a state, and what a whole run of rows does to any state: the composition of their steps,
in a form that stays small (an affine map for running averages, a largest value for peak hold, clamped sums for persistence, a
constant for throttles, a table of jumps for cooldowns).  :func:`scan` deals rows by ranges of key and order, so a key of any
size is spread over tasks.  A range that ends within a key gives the composition of that key's rows in it, one small
row a range; following them in order gives the state that each range starts with, and every range is then run by itself.
"""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .order import cut_lineage

#: Bytes of all states that ranges start with; with larger states there are fewer ranges.
STATES_BYTES = 64 << 20
#: Starts of a cooldown's table of jumps; where more rows lie within one cooldown, its keys are run one task each.
JUMPS = 4096


class TooLong(Exception):
    """A composition that doesn't stay small."""


class Recurrence:
    """``step`` gives the new state and what comes out for the row; None is no state yet.  ``n`` numbers the key's rows from 1."""

    #: Whether compositions depend on the rows' numbers.
    numbered = False

    def step(self, state: Any, row: tuple, n: int) -> tuple[Any, Any]:
        raise NotImplementedError

    def extend(self, run: Any, row: tuple, n: int) -> Any:
        """The composition of a run of rows (None: no row) and one more."""
        raise NotImplementedError

    def after(self, state: Any, run: Any) -> Any:
        """The state after a run that starts with ``state``."""
        raise NotImplementedError

    def bytes(self, row: tuple) -> int:
        """Size of a state or composition, about."""
        return 64


class Average(Recurrence):
    """Frames: ``weight(n)`` new + (1 - weight) old, from the first frame on."""

    def __init__(self, weight: float | None = None, most: int = 1):
        self.weight, self.most, self.numbered = weight, most, weight is None

    def _moved(self, state, x, n):
        w = self.weight if self.weight is not None else 1 / min(n, self.most)
        return w * x + (1 - w) * state if self.weight is not None else state + (x - state) / min(n, self.most)

    def step(self, state, row, n):
        new = row[0] if state is None else self._moved(state, row[0], n)
        return new, new

    def extend(self, run, row, n):
        factor, offset, alone = run or (1.0, np.zeros(len(row[0])), None)
        w = self.weight if self.weight is not None else 1 / min(n, self.most)
        return factor * (1 - w), (1 - w) * offset + w * row[0], self.step(alone, row, n)[0]

    def after(self, state, run):
        return run[2] if state is None else run[0] * state + run[1]

    def bytes(self, row):
        return 16 * len(row[0])


class PeakHold(Recurrence):
    """Frames: the larger of the new value and the held one less ``decay``."""

    def __init__(self, decay: float = 0.0):
        self.decay = decay

    def step(self, state, row, n):
        new = row[0] if state is None else np.maximum(state - self.decay, row[0])
        return new, new

    def extend(self, run, row, n):
        rows, alone = run or (0, None)
        return rows + 1, self.step(alone, row, n)[0]

    def after(self, state, run):
        return run[1] if state is None else np.maximum(state - run[0] * self.decay, run[1])

    def bytes(self, row):
        return 8 * len(row[0])


class Persistence(Recurrence):
    """bins x levels: every cell fades by ``decay`` a frame, and the cells of the frame's levels gain.

    A run of fades and gains moves a cell by a sum between two limits.
    """

    def __init__(self, levels: int, low: float, high: float, decay: float = 0.02, gain: float = 0.3):
        self.levels, self.low, self.high, self.decay, self.gain = levels, low, high, decay, gain

    def _cells(self, x: np.ndarray) -> np.ndarray:
        level = np.clip(((x - self.low) / (self.high - self.low) * self.levels).astype(int), 0, self.levels - 1)
        return np.arange(len(x)) * self.levels + level

    def step(self, state, row, n):
        grid = np.zeros(len(row[0]) * self.levels) if state is None else np.maximum(state - self.decay, 0.0)
        at = self._cells(row[0])
        grid[at] = np.minimum(grid[at] + self.gain, 1.0)
        return grid, grid

    def extend(self, run, row, n):
        size = len(row[0]) * self.levels
        moved, least, most = run or (np.zeros(size), np.full(size, -np.inf), np.full(size, np.inf))
        moved, least, most = moved - self.decay, np.maximum(least - self.decay, 0.0), np.maximum(most - self.decay, 0.0)
        at = self._cells(row[0])
        moved[at] += self.gain
        least[at], most[at] = np.minimum(least[at] + self.gain, 1.0), np.minimum(most[at] + self.gain, 1.0)
        return moved, least, most

    def after(self, state, run):
        return np.minimum(np.maximum((0.0 if state is None else state) + run[0], run[1]), run[2])

    def bytes(self, row):
        return 24 * self.levels * len(row[0])


class Throttle(Recurrence):
    """On above ``on``, off below ``off``, else as before: a run is what its last row beyond a limit says."""

    def __init__(self, on: float = 85.0, off: float = 50.0):
        self.on, self.off = on, off

    def step(self, state, row, n):
        fill = row[0]
        new = bool(state) if fill is None else fill > self.on or (bool(state) and fill >= self.off)
        return new, new

    def extend(self, run, row, n):
        fill, (edge,) = row[0], run or (None,)
        return (edge if fill is None else True if fill > self.on else False if fill < self.off else edge,)

    def after(self, state, run):
        return bool(state) if run[0] is None else run[0]


class Spells(Throttle):
    """The same with the borders of spells and their numbers; a run tells where it leads and how many spells start in it, from off and from on."""

    def step(self, state, row, n):
        on, number = state or (False, 0)
        now, _ = super().step(on, row, n)
        start, stop = now and not on, on and not now
        number += start
        return (now, number), {"throttled": int(now), "start": int(start), "stop": int(stop), "spell": number}

    def extend(self, run, row, n):
        return tuple(self.step(s, row, n)[0] for s in run or ((False, 0), (True, 0)))

    def after(self, state, run):
        on, number = state or (False, 0)
        led, more = run[on]
        return led, number + more


class Meter(Recurrence):
    """Numbers: extremes so far and the mean of the last ``last`` rows; nulls count as rows and no more."""

    def __init__(self, last: int = 100):
        self.last = last

    def step(self, state, row, n):
        low, high, recent = state or (None, None, ())
        x = row[0]
        if x is not None:
            low, high = (x, x) if low is None else (min(low, x), max(high, x))
        recent = (*recent, x)[-self.last :]
        known = [v for v in recent if v is not None]
        return (low, high, recent), {"running_min": low, "running_max": high, "recent_mean": math.fsum(known) / len(known) if known else None}

    def extend(self, run, row, n):
        return self.step(run, row, n)[0]

    def after(self, state, run):
        if state is None or run is None:
            return run or state
        lows, highs = ([s[k] for s in (state, run) if s[k] is not None] for k in (0, 1))
        return min(lows, default=None), max(highs, default=None), (*state[2], *run[2])[-self.last :]

    def bytes(self, row):
        return 32 * self.last


class Jumps:
    """Where a cooldown's chain that starts at each of a run's first rows ends."""

    def __init__(self):
        self.starts: list[float] = []
        self.open = True
        self.chains: deque[list] = deque()  # [last alert, starts], by last alert

    def add(self, t: float, seconds: float) -> None:
        joined: list[int] = []
        while self.chains and t - self.chains[0][0] >= seconds:
            more = self.chains.popleft()[1]
            joined, more = (joined, more) if len(joined) >= len(more) else (more, joined)
            joined += more
        if self.open:
            if len(self.starts) >= JUMPS:
                raise TooLong
            joined.append(len(self.starts))
            self.starts.append(t)
            self.open = t - self.starts[0] < seconds
        if joined:
            self.chains.append([t, joined])


class Cooldown(Recurrence):
    """Rows with a time: those at least ``seconds`` after the last row that came out, and the first one, come out."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def step(self, state, row, n):
        if state is not None and row[0] - state < self.seconds:
            return state, None
        return row[0], True

    def extend(self, run, row, n):
        run = run or Jumps()
        run.add(row[0], self.seconds)
        return run

    def after(self, state, run):
        at = 0 if state is None else bisect_left(run.starts, True, key=lambda t: t - state >= self.seconds)
        if at == len(run.starts):
            return state
        return next(last for last, starts in run.chains if at in starts)

    def bytes(self, row):
        return 32 * JUMPS


def _values(batch: pa.RecordBatch, at: Sequence[int]):
    """Rows of the columns ``at``: arrays as float64, other values as Python values."""
    columns = []
    for k in at:
        c = batch.column(k)
        columns.append([np.array(x.values, float) if x.is_valid else None for x in c] if pa.types.is_list(c.type) else c.to_pylist())
    return zip(*columns)


def _runner(rec: Recurrence, key: int, inputs: list[int], kind: pa.DataType | None, names: list[str], last_only: bool, entries: Callable[[], tuple[dict, dict]]):
    """The second pass: rows that come out, with a value column of ``kind`` unless it's None."""

    def out(rows: pa.RecordBatch, values: list) -> pa.RecordBatch:
        if kind is None:
            return rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array([v.tolist() if isinstance(v, np.ndarray) else v for v in values], kind)], names=names)

    def run(batches):
        start, goes_on = entries()
        part = TaskContext.get().partitionId()
        now, state, n, held, value = object(), None, 0, None, None
        first = True
        for b in batches:
            stay, values = [], []
            for r, (k, row) in enumerate(zip(b.column(key).to_pylist(), _values(b, inputs))):
                if first or k != now:
                    if last_only and not first:
                        yield out(held, [value])
                    state, n = start.get(part, (None, 0)) if first else (None, 0)
                    now, first = k, False
                n += 1
                state, value = rec.step(state, row, n)
                if last_only:
                    held = b.slice(r, 1)
                elif value is not None:
                    stay.append(r)
                    values.append(value)
            if not last_only:
                yield out(b.take(pa.array(stay, pa.int64())), values)
        if last_only and not first and part not in goes_on:
            yield out(held, [value])

    return run


def scan(df: DataFrame, key: str, order: Sequence[str], inputs: Sequence[str], rec: Recurrence, value: str | None = None, last_only: bool = False, parts: int | None = None) -> DataFrame:
    """``df``'s columns of the rows that come out (where ``step`` gives a value), with ``value`` (a column in DDL) if it's given.

    With ``last_only`` only each key's last row comes out.  Rows with a null in an array input aren't taken into the state and
    don't come out; a null key is a key.  Where a composition doesn't stay small, keys are sorted and run one task each.
    """
    spark, names = df.sparkSession, df.columns
    arrays = [c for c in inputs if df.schema[c].dataType.typeName() == "array"]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in arrays)) if arrays else df
    made = StructType.fromDDL(value).fields if value else []
    schema, kind = StructType([*rows.schema.fields, *made]), to_arrow_type(made[0].dataType) if made else None
    at = [names.index(c) for c in inputs]
    sizes = [F.size(c).alias(c) if c in arrays else F.lit(0).alias(c) for c in inputs]
    probe = rows.select(*sizes).limit(1).collect()
    if not probe:
        return spark.createDataFrame([], schema)
    each = rec.bytes(tuple(range(probe[0][c]) if c in arrays else None for c in inputs))
    wanted = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(wanted, STATES_BYTES // max(1, each)))
    dealt = cut_lineage(rows.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order))
    part = F.spark_partition_id()
    edges = dealt.groupBy(part.alias("part")).agg(F.min_by(key, F.struct(F.col(key).isNotNull(), key)).alias("first"), F.max_by(key, F.struct(F.col(key).isNotNull(), key)).alias("last")).orderBy("part").collect()  # a row a range
    goes_on = {a["part"]: a["last"] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}
    start: dict[int, tuple[Any, int]] = {}
    if goes_on:
        mine = dealt.where(part.isin(list(goes_on)) & F.col(key).eqNullSafe(F.create_map(*(x for p, k in goes_on.items() for x in (F.lit(p), F.lit(k).cast(df.schema[key].dataType))))[part]))
        counts = {r["part"]: r["count"] for r in mine.groupBy(part.alias("part")).count().collect()}  # a row a range

        def follow(runs: dict[int, Any] | None) -> dict[int, tuple[Any, int]]:
            """State and rows before each range; only rows where there are no compositions yet."""
            out, before = {}, None
            for e in edges:
                entry = (None, 0)
                if before is not None and before[0] == e["first"] and before[1]:
                    entry = out[e["part"]] = before[2]
                p = e["part"]
                if p in goes_on:
                    state, n_before = entry if e["first"] == e["last"] else (None, 0)
                    before = (e["last"], True, (rec.after(state, runs[p]) if runs is not None else None, n_before + counts[p]))
                else:
                    before = (e["last"], False, None)
            return out

        numbers = {p: m for p, (_, m) in follow(None).items()}
        single = {e["part"] for e in edges if e["first"] == e["last"]}

        def compose(batches):
            p = TaskContext.get().partitionId()
            run, m = None, numbers.get(p, 0) if p in single else 0
            try:
                for b in batches:
                    for row in _values(b, range(len(at))):
                        m += 1
                        run = rec.extend(run, row, m)
            except TooLong:
                for _ in batches:
                    pass
                run = TooLong
            if run is not None:
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([pickle.dumps(run)], pa.binary())], names=["part", "run"])

        found = mine.select(*inputs).mapInArrow(compose, "part int, run binary").collect()  # a row a range, STATES_BYTES in all
        runs = {r["part"]: pickle.loads(bytes(r["run"])) for r in found}
        if any(x is TooLong for x in runs.values()):
            whole = dealt.repartition(key).sortWithinPartitions(key, *order)
            return whole.mapInArrow(_runner(rec, names.index(key), at, kind, schema.names, last_only, lambda: ({}, {})), schema)
        start = follow(runs)
    sent = spark.sparkContext.broadcast((start, goes_on))  # STATES_BYTES at most
    return dealt.mapInArrow(_runner(rec, names.index(key), at, kind, schema.names, last_only, lambda: sent.value), schema)
