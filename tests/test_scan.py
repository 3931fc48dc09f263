"""Recurrences in parallel inside a key against plain folds."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewave.operators import order, readout, scan


def plain(rows: list[tuple], rec: scan.Recurrence) -> dict:
    """(key, order) -> value, row by row."""
    state, n, out = {}, {}, {}
    for k, o, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n[k] = n.get(k, 0) + 1
        state[k], value = rec.step(state.get(k), (x,), n[k])
        if value is not None:
            out[k, o] = value
    return out


FRAMES = [scan.Average(0.1), scan.Average(None, 8), scan.Average(None, 1000), scan.PeakHold(), scan.PeakHold(0.3), scan.Persistence(6, -2.0, 2.0)]


@pytest.mark.parametrize("rec", FRAMES, ids=lambda r: type(r).__name__)
@pytest.mark.parametrize("shape", ["one", "many", "hot"])
def test_frames(spark, rec, shape):
    rng = np.random.default_rng(3)
    key = {"one": lambda k: 7, "many": lambda k: k % 60, "hot": lambda k: None if k % 2 else k % 9}[shape]
    rows = [(key(k), k, rng.normal(0, 1, 5).tolist()) for k in range(400)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(k, o, x, "kept") for k, o, x in rows] + [(key(1), 9999, None, "kept")], "k int, o long, x array<double>, more string")
    out = scan.scan(df, "k", ("o",), ("x",), rec, "v array<double>", parts=9)
    assert out.columns == ["k", "o", "x", "more", "v"]
    want = plain([(k, o, np.array(x)) for k, o, x in rows], rec)
    got = out.collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose(r["v"], want[r["k"], r["o"]], rtol=0, atol=1e-12)
    last = {r["k"]: r for r in scan.scan(df, "k", ("o",), ("x",), rec, "v array<double>", last_only=True, parts=9).collect()}
    assert set(last) == {k for k, _ in want}
    for k, r in last.items():
        assert r["o"] == max(o for kk, o in want if kk == k) and np.allclose(r["v"], want[k, r["o"]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("seconds", [0.0, 0.5, 3.0, 40.0, 1e9])
@pytest.mark.parametrize("keys", [1, 3, 40])
def test_cooldown(spark, seconds, keys):
    draw = random.Random(keys)
    rows = [(draw.randrange(keys), float(t), round(draw.uniform(0, 200), draw.choice((0, 2)))) for t in range(600)]
    rows = [(k, t, t) for k, _, t in rows]
    df = spark.createDataFrame([(k, i, t) for i, (k, _, t) in enumerate(rows)], "k int, i long, t double")
    got = {(r["k"], r["t"]) for r in scan.scan(df, "k", ("t", "i"), ("t",), scan.Cooldown(seconds), parts=11).collect()}
    want = {(k, o) for (k, o) in plain(rows, scan.Cooldown(seconds))}
    assert got == want


def test_cooldown_runs_compose():
    """A run's table of jumps against its rows, for any state before it."""
    draw = random.Random(5)
    for _ in range(300):
        rec = scan.Cooldown(draw.choice((0.0, 1.0, 2.5, 10.0)))
        times = sorted(round(draw.uniform(0, 12), 1) for _ in range(draw.randrange(1, 40)))
        run = None
        for t in times:
            run = rec.extend(run, (t,), 0)
        for before in (None, *(times[0] - draw.uniform(0, 12) for _ in range(4)), times[0]):
            state = before
            for t in times:
                state, _ = rec.step(state, (t,), 0)
            assert rec.after(before, run) == state


def test_dense_cooldowns_fall_back(spark, monkeypatch):
    """More rows within a cooldown than a table holds: keys are run one task each, with the same result."""
    monkeypatch.setattr(scan, "JUMPS", 10)
    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") / 10).alias("t"))
    out = scan.scan(df, "k", ("t",), ("t",), scan.Cooldown(7.0), parts=6)
    rows = [(r["k"], r["t"], r["t"]) for r in df.collect()]
    assert {(r["k"], r["t"]) for r in out.collect()} == set(plain(rows, scan.Cooldown(7.0)))


def test_throttle_and_nulls(spark):
    draw = random.Random(2)
    rows = [(k, o, draw.choice((None, 10.0, 50.0, 70.0, 85.0, 90.0))) for k in (1, None) for o in range(300)]
    out = scan.scan(spark.createDataFrame(rows, "k int, o long, fill double"), "k", ("o",), ("fill",), scan.Throttle(), "on boolean", parts=7).collect()
    assert {(r["k"], r["o"]): r["on"] for r in out} == plain(rows, scan.Throttle())


@pytest.mark.parametrize("keys", [1, 30])
def test_spells_and_meters(spark, keys):
    draw = random.Random(6)
    rows = [(draw.randrange(keys) or None, o, draw.choice((None, 10.0, 49.0, 60.0, 86.0, 99.0))) for o in range(500)]
    df = spark.createDataFrame(rows, "k int, o long, fill double")
    for rec, out in ((scan.Spells(), readout.throttled(df, "k", "fill", "o")), (scan.Meter(7), readout.meter(df, "fill", "k", "o", last=7))):
        want = plain(rows, rec)
        got = {(r["k"], r["o"]): r for r in out.collect()}
        assert set(got) == set(want)
        for at, value in want.items():
            assert all(got[at][name] == v or abs(got[at][name] - v) < 1e-12 for name, v in value.items())


def test_throttle_summary(spark):
    """Against loops over each key's rows, a key without spells and one that never recovers among them."""
    draw = random.Random(7)
    rows = [(k, float(o), draw.choice((10.0, 49.0, 60.0, 86.0, 99.0)) if k < 4 else 60.0 + k) for k in range(5) for o in range(80)] + [(5, 0.0, 90.0), (5, 1.0, 70.0)]
    got = {r["k"]: r for r in readout.throttle_summary(spark.createDataFrame(rows, "k int, t double, fill double"), "k", "fill", "t", "t").collect()}
    for key in range(6):
        own = [(t, f) for k, t, f in rows if k == key]
        on, began, lengths, n = False, None, [], 0
        for t, f in own:
            now = f > 85 or (on and f >= 50)
            if now and not on:
                began, n = t, n + 1
            if on and not now:
                lengths.append(t - began)
            on = now
        peak = max(own, key=lambda x: (x[1], x[0]))
        low = next((t for t, f in own if t >= peak[0] and f < 50), None)
        r = got[key]
        assert (r["activations"], r["max_fill"], r["recovery_s"]) == (n, peak[1], low - peak[0] if low is not None else 0.0)
        assert abs(r["mean_spell_s"] - (sum(lengths) / len(lengths) if lengths else 0.0)) < 1e-9


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "k int, o long, x array<double>")
    assert scan.scan(none, "k", ("o",), ("x",), scan.Average(0.5), "v array<double>").columns == ["k", "o", "x", "v"]
    one = spark.createDataFrame([(1, 1, [2.0])], "k int, o long, x array<double>")
    assert scan.scan(one, "k", ("o",), ("x",), scan.Average(0.5), "v array<double>").first()["v"] == [2.0]


def test_a_hot_key_is_spread(spark):
    """One key over all ranges: every task runs its own, and no exchange puts the key into one task."""
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.array(F.col("id").cast("double")).alias("x"))
    out = scan.scan(df, "k", ("o",), ("x",), scan.PeakHold(), "v array<double>", parts=8)
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 1500
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 100_000])
def test_places(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW", few)
    draw = random.Random(8)
    rows = [(draw.choice((1, 1, 1, 2, 3, None)), draw.randrange(40), i) for i in range(600)]
    got = {r["i"]: r["place"] for r in order.numbered(spark.createDataFrame(rows, "k int, v int, i int").repartition(7), "k", "v", "i").collect()}
    for key in (1, 2, 3, None):
        assert [got[i] for _, i in sorted((v, i) for k, v, i in rows if k == key)] == list(range(sum(k == key for k, *_ in rows)))


def test_accumulated_and_percentiles(spark):
    draw = random.Random(4)
    rows = [(draw.choice((1, 1, 1, 2, None)), draw.uniform(0, 9) if k % 3 else float(draw.randrange(5)), draw.randrange(1, 4)) for k in range(700)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k int, v double, w int, i int")
    got = {r["i"]: r["place"] for r in order.accumulated(df, "k", "w", "v", "i").collect()}
    for key in (1, 2, None):
        total = 0
        for v, i, w in sorted((v, i, w) for i, (k, v, w) in enumerate(rows) if k == key):
            assert got[i] == total
            total += w
    for p in (0, 50, 99, 100):
        got = {r["k"]: r[f"p{p}"] for r in readout.index_percentile(df, "v", p, "k").collect()}
        for key in (1, 2, None):
            values = sorted(v for k, v, _ in rows if k == key)
            assert got[key] == values[min(int(len(values) * p / 100), len(values) - 1)]
    everything = readout.index_percentile(df, "v", 95).first()["p95"]
    assert everything == sorted(v for _, v, _ in rows)[int(len(rows) * 0.95)]
