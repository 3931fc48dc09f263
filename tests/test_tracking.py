"""Tracks as a stream with event-time timers against plain loops over the table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewave.streaming import tracking

FRAMES = "key string, ts timestamp, hz array<double>"


@pytest.fixture()
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracking.PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def frames(spark, rows):
    """(key, seconds, hz) as frames."""
    return spark.createDataFrame([(k, t, hz) for k, t, hz in rows], "key string, t double, hz array<double>").select("key", F.timestamp_micros((F.col("t") * 1e6).cast("long") + F.lit(10**15)).alias("ts"), "hz")


def run(spark, folder, checkpoint, name, table, **options):
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(folder)
    out = tracking.track_stream(stream, "key", 100.0, 1.0, **options)
    q = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
    q.awaitTermination()
    return spark.read.parquet(table)


def plain(rows):
    """Each frame's tracks and each track's end."""
    out, open_, number = set(), {}, {}
    for k, t, hz in sorted(rows, key=lambda r: (r[0], r[1])):
        t += 1e9
        known = {i: x for i, x in open_.get(k, {}).items() if t - x[2] <= 1.0}
        out |= {("ended", k, i, round(x[2] + 1.0, 6), x[3]) for i, x in open_.get(k, {}).items() if i not in known}
        at = {i: x[0] for i, x in known.items()}
        for f in hz:
            best = min(at, key=lambda i: (abs(at[i] - f), i), default=None)
            if best is not None and abs(at[best] - f) < 100:
                known[best] = (f, known[best][1], t, known[best][3] + 1)
            else:
                known[number.setdefault(k, 0)] = (f, t, t, 1)
                number[k] += 1
        open_[k] = known
        out |= {("seen", k, i, round(t, 6), x[3]) for i, x in known.items()}
    return out, {(k, i): x for k, own in open_.items() for i, x in own.items()}


def events(df):
    return {(r["event"], r["key"], int(r["track_id"][4:]), round(r["t"], 6), r["frames_seen"]) for r in df.collect()}


def write(spark, rows, folder):
    frames(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def test_tables_against_plain_loops(spark):
    rng = np.random.default_rng(0)
    rows = [(k, round(0.4 * n, 3), sorted((1e3 * rng.integers(0, 5, 2) + rng.normal(0, 20, 2)).tolist())) for k in "abc" for n in range(25)]
    assert events(tracking.track_table(frames(spark, rows), "key", 100.0)) == plain(rows)[0]


def test_tracks_end_by_timer_and_restarts_go_on(spark, store, tmp_path):
    """Out-of-order frames, three runs of one query, and ends without a further row of the key."""
    rng = np.random.default_rng(1)
    folder, checkpoint, table = (str(tmp_path / x) for x in ("in", "c", "out"))
    rows = [(k, round(0.4 * n, 3), (1e3 * rng.integers(0, 4, 2) + rng.normal(0, 20, 2)).tolist()) for k in "ab" for n in range(30)]
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 1.5))  # within the watermark's delay
    for part in range(3):
        write(spark, order[part * 20 : part * 20 + 20], folder)
        if part != 1:
            got = run(spark, folder, checkpoint, "t", table)
    write(spark, [("clock", 60.0, [1.0])], folder)  # another key's row moves the watermark on; it's never seen itself
    got = run(spark, folder, checkpoint, "t", table)
    write(spark, [("clock", 61.0, [1.0])], folder)
    got = events(run(spark, folder, checkpoint, "t", table).where("key <> 'clock'"))
    seen, still = plain(rows)
    assert still
    ends = {("ended", k, i, round(x[2] + 1.0, 6), x[3]) for (k, i), x in still.items()}
    assert got == seen | ends
    # the table says the same of all that its rows can tell
    assert events(tracking.track_table(frames(spark, rows), "key", 100.0)) == seen


def test_late_rows_are_dropped(spark, store, tmp_path):
    folder, checkpoint, table = (str(tmp_path / x) for x in ("in", "c", "out"))
    first = [("a", float(t), [500.0]) for t in range(5)]
    write(spark, first, folder)
    run(spark, folder, checkpoint, "t", table, late="1 second")
    write(spark, [("b", 100.0, [1.0])], folder)
    run(spark, folder, checkpoint, "t", table, late="1 second")
    write(spark, [("a", 4.5, [500.0]), ("a", 100.2, [700.0])], folder)  # the first one is behind the watermark
    write(spark, [("b", 200.0, [1.0])], folder)
    write(spark, [("b", 201.0, [1.0])], folder)
    got = events(run(spark, folder, checkpoint, "t", table, late="1 second").where("key = 'a'"))
    seen, still = plain([*first, ("a", 100.2, [700.0])])
    assert got == seen | {("ended", k, i, round(x[2] + 1.0, 6), x[3]) for (k, i), x in still.items()}


def test_reclustering_counts_no_row_twice(spark, tmp_path):
    """A batch that is run again leaves what it left at first, and only the last rows are kept."""
    from ridgewave.streaming import state

    schema = "ts timestamp, v double"
    rows = [(n, float(n)) for n in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[10 * part : 10 * part + 10], "n long, v double").select(F.timestamp_seconds("n").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []

    def cluster(df):
        seen.append(sorted(r["v"] for r in df.collect()))
        if len(seen) == 2:
            raise RuntimeError("lost on the way")
        return df.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))

    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start = lambda: state.recluster(stream(), cluster, "reclustered", last=15, checkpoint=str(tmp_path / "c"))
    for t in ("reclustered", "reclustered_rows_0", "reclustered_rows_1"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    state.supervised(start, pause_s=0.0)
    assert seen[1] == seen[2] and [len(x) for x in seen] == [10, 15, 15, 15, 15]
    assert seen[-1] == [float(n) for n in range(25, 40)]
    assert tuple(spark.table("reclustered").first()) == (15, 25.0)
