"""Captures from files, and stream operators against batch replays."""

from __future__ import annotations

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewave.operators import learning, readout
from ridgewave.sources import captures
from ridgewave.streaming import state


def test_formats(spark, tmp_path):
    x = np.array([1 + 2j, -1.5 + 0.5j, 0, 3 - 2j])
    pairs = np.stack([x.real, x.imag], 1).ravel()
    (tmp_path / "a.cf32").write_bytes(pairs.astype("<f4").tobytes())
    row = captures.read_raw(spark, str(tmp_path / "a.cf32"), "cf32").first()
    assert np.allclose(np.array(row["i"]) + 1j * np.array(row["q"]), x)
    f = captures.DECODERS
    assert np.allclose(f["cf32"](pairs.astype(">f4").tobytes(), {"endian": "big"}), x)
    assert np.allclose(f["ci16"]((pairs * 100).astype("<i2").tobytes(), {"scale": 100}), x)
    assert np.allclose(f["u8"]((pairs + 128).astype("u1").tobytes(), {}).real, np.trunc(x.real + 128) - 128)
    assert len(f["cf32"](b"\0" * 11, {})) == 1
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes((pairs * 1000).astype("<i2").tobytes())
    assert np.allclose(f["wav"](buf.getvalue(), {"rate": 8000}), x * 1000 / 32768)
    with pytest.raises(ValueError):
        f["wav"](buf.getvalue(), {"rate": 1})
    with pytest.raises(ValueError):
        captures.read_raw(spark, str(tmp_path), "nope")


def test_sigmf_round_trip(spark, tmp_path):
    rows = [("one", 1e6, 100e6, [1.0, 3.0, 5.0], [2.0, 4.0, 6.0]), ("two", 2e6, 200e6, [0.5], [-0.5])]
    df = spark.createDataFrame(rows, "name string, sample_rate double, center_freq_hz double, i array<double>, q array<double>")
    assert captures.write_sigmf(df, str(tmp_path)).agg(F.sum("n_samples")).first()[0] == 4
    known = {r["name"]: r for r in captures.sigmf_catalogue(spark, str(tmp_path)).collect()}
    assert known["one"]["length"] == 24 and known["one"]["n_samples"] == 3
    back = {r["name"]: r for r in captures.read_sigmf(spark, str(tmp_path)).collect()}
    assert back["one"]["i"] == [1.0, 3.0, 5.0] and back["two"]["q"] == [-0.5] and back["two"]["center_freq_hz"] == 200e6


def _stream(spark, tmp_path, df, name):
    """The rows of df as a stream of three files, in order of t."""
    for k in range(3):
        df.where(F.col("part") == k).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def _collect(spark, out, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return {tuple(map(str, r)) for r in spark.table(name).collect()}


def test_streams_equal_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(k, 0.5 * t, sorted((1e3 * rng.integers(0, 8, 3) + rng.normal(0, 50, 3)).tolist()), float(rng.uniform(0, 100)), t // 10) for k in ("a", "b") for t in range(30)]
    df = spark.createDataFrame(rows, "key string, t double, hz array<double>, fill double, part int")
    stream = _stream(spark, tmp_path, df, "frames")
    for name, step, out in (("tracks", state.track_step(500.0, 1.0), state.TRACK_OUT), ("throttle", state.throttle_step(), "t double, fill double, throttled boolean"), ("alerts", state.alert_step(2.0), "t double, fill double")):
        live = _collect(spark, state.stream(stream, "key", step, out), tmp_path, name)
        assert live == {tuple(map(str, r)) for r in state.replay(df, "key", step, out).collect()}
        assert live


def test_tracker_rules():
    step = state.track_step(100.0, 1.0)
    s, out = step(None, {"t": 0.0, "hz": [1000.0, 2000.0]})
    assert [o["track_id"] for o in out] == ["trk-000000", "trk-000001"]
    s, out = step(s, {"t": 0.5, "hz": [1050.0, 1100.0]})  # exactly the limit away: a new track
    assert {o["track_id"]: o["frames_seen"] for o in out} == {"trk-000000": 2, "trk-000001": 1, "trk-000002": 1}
    s, out = step(s, {"t": 1.2, "hz": []})  # the second one is gone
    assert [o["track_id"] for o in out] == ["trk-000000", "trk-000002"]


def test_watermarked_windows(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{k:02d}", "error" if k % 5 == 0 else "click", k // 20) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, ts string, event_type string, part int").withColumn("ts", F.to_timestamp("ts"))
    live = _collect(spark, state.rates(_stream(spark, tmp_path, df, "ev")).select("n", "n_over"), tmp_path, "rates")
    assert ("10", "2") in live


def test_range_join_both_ways(spark):
    points = spark.range(200).select(F.col("id").cast("double").alias("x"))
    ranges = spark.createDataFrame([(float(a), float(a + 7)) for a in range(0, 200, 5)], "lo double, hi double")
    got = [readout.range_join(points, ranges, "x", "lo", "hi", 10.0, max_rules=m).count() for m in (1000, 5)]
    assert got[0] == got[1] == sum(lo <= x <= lo + 7 for x in range(200) for lo in range(0, 200, 5))


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.15, (25, 2)) for c in (0, 2, 4)] + [rng.uniform(-3, 8, (15, 2))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    links = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if d[a, b] <= 0.3}
    assert {(r["a"], r["b"]) for r in learning.eps_links(df, 0.3).collect()} == links
    got = {r["id"]: r for r in learning.cluster(df, 0.3, 4, "dbscan").collect()}
    core = (d <= 0.3).sum(axis=1) >= 4
    root = {int(k): int(k) for k in np.flatnonzero(core)}
    for _ in range(len(x)):
        for a, b in links:
            if core[a] and core[b]:
                root[a] = root[b] = min(root[a], root[b])
    for k in range(len(x)):
        assert got[k]["core"] == core[k]
        if core[k]:
            assert got[k]["cluster"] == root[k]
        elif not any(core[j] for j in range(len(x)) if d[k, j] <= 0.3):
            assert got[k]["cluster"] == -1


def test_empty_frames(spark):
    from ridgewave.operators.cfar import Cfar
    from ridgewave.operators.peaks import Peaks, detect

    df = spark.createDataFrame([(1, None), (2, []), (3, [1.0]), (4, [1.0] * 30 + [50.0] + [1.0] * 30)], "frame_id int, psd array<double>")
    assert [r["frame_id"] for r in detect(df, Cfar(8, 2, 1e-2), Peaks(64.0)).collect()] == [4]


def test_recordings(spark, tmp_path):
    """A limit by event time, annotations, listing, export, deletion."""
    import zipfile

    from ridgewave.sources import recordings

    rows = [(name, seq, 1e3, 100e6, [float(seq), 1.0], [0.5, -0.5]) for name in ("a", "b") for seq in range(6)]
    blocks = spark.createDataFrame(rows, "name string, seq long, sample_rate double, center_freq_hz double, i array<double>, q array<double>").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("seq")))
    notes = recordings.annotate(spark.createDataFrame([], recordings.ANNOTATIONS), "a", 2, 4, 99e6, 101e6, "burst", "seen")
    notes = recordings.annotate(notes, "a", 0, 1, 99e6, 100e6, "first")
    folder, out = tmp_path / "rec", tmp_path / "zip"
    folder.mkdir(), out.mkdir()
    written = {r["name"]: r["n_samples"] for r in recordings.record(blocks.repartition(3), str(folder), 4.0, notes).collect()}
    assert written == {"a": 8, "b": 8}  # four blocks of two samples lie within four seconds
    back = {r["name"]: r for r in captures.read_sigmf(spark, str(folder)).collect()}
    assert back["a"]["i"] == [0.0, 1.0, 1.0, 1.0, 2.0, 1.0, 3.0, 1.0]
    found = recordings.find(spark, str(folder), "a").first()
    assert [x["core:label"] for x in found["annotations"]] == ["first", "burst"] and found["annotations"][1]["core:sample_count"] == 4
    sizes = {r["name"]: r["bytes"] for r in recordings.export_zip(spark.createDataFrame([("a",), ("b",)], "name string"), str(folder), str(out)).collect()}
    with zipfile.ZipFile(out / "a.zip") as z:
        assert z.testzip() is None and sorted(z.namelist()) == ["a.sigmf-data", "a.sigmf-meta"] and len(z.read("a.sigmf-data")) == 64
    assert sizes["a"] == (out / "a.zip").stat().st_size
    with pytest.raises(ValueError):
        recordings.delete(str(folder), "a", frozenset({"a"}))
    assert recordings.delete(str(folder), "a") and not recordings.delete(str(folder), "a")
    assert recordings.find(spark, str(folder), "a").count() == 0 and recordings.find(spark, str(folder), "b").count() == 1
    marks = recordings.annotate_detections(spark.createDataFrame([("a", 0.5, 0.1, 100e6, 2e6, "x")], "name string, t double, seconds double, center_freq_hz double, bandwidth_hz double, label string"), 1e3).first()
    assert (marks["sample_start"], marks["sample_count"], marks["freq_lower_hz"]) == (500, 100, 99e6)


def test_recording_a_stream(spark, tmp_path):
    from ridgewave.sources import recordings

    rows = [("a", seq, [1.0], seq // 3) for seq in range(9)]
    df = spark.createDataFrame(rows, "name string, seq long, i array<double>, part int").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("seq")))
    query = recordings.record_stream(_stream(spark, tmp_path, df, "live").drop("part"), str(tmp_path / "kept"), str(tmp_path / "c_rec"), 5.0)
    query.awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [0, 1, 2, 3, 4]


def test_sources_by_name(spark, tmp_path):
    from ridgewave.sources import recordings

    assert recordings.open_source(spark, "synthetic", blocks=3, size=16, rate=1e6).count() == 3
    with pytest.raises(ValueError):
        recordings.open_source(spark, "usrp")
    x = captures.synthetic(spark, 400, 64, 1e6, tones=(), noise_db=0.0, noise="gaussian").select(F.explode("i").alias("v")).agg(F.avg("v").alias("m"), F.stddev("v").alias("s"), F.kurtosis("v").alias("k")).first()
    assert abs(x["m"]) < 0.05 and abs(x["s"] - 1) < 0.03 and abs(x["k"]) < 0.15
    rows = [("a", seq, seq // 4) for seq in (0, 1, 2, 5, 6, 9)]
    df = spark.createDataFrame(rows, "capture_id string, seq long, part int").withColumns({"ts": F.timestamp_seconds("seq"), "center_freq_hz": F.lit(1e6), "sample_rate_hz": F.lit(1e3), "overflow": F.lit(False), "i": F.array(F.lit(1.0).cast("float")), "q": F.array(F.lit(0.0).cast("float"))})
    df.drop("part").write.parquet(str(tmp_path / "live"))
    query = recordings.open_source(spark, "live", path=str(tmp_path / "live"), files_per_trigger=2).writeStream.format("memory").queryName("live_blocks").option("checkpointLocation", str(tmp_path / "c_live")).trigger(availableNow=True).start()
    query.awaitTermination()
    lost = {r["seq"]: r["lost"] for r in recordings.lost_samples(spark.table("live_blocks")).collect()}
    assert lost[5] == 2 and lost[9] == 2 and sum(v or 0 for v in lost.values()) == 4


def test_reclustering_a_stream(spark, tmp_path):
    rows = [(k, float(k % 3), k // 10) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, v double, part int").withColumn("ts", F.timestamp_seconds("id"))
    state.recluster(_stream(spark, tmp_path, df, "found").drop("part"), lambda d: d.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "found_clusters", last=12, checkpoint=str(tmp_path / "c_found")).awaitTermination()
    assert sorted(r["n"] for r in spark.table("found_clusters").collect()) == [4, 4, 4]


def test_receivers_say_what_is_wrong(spark):
    from ridgewave.functions import messages
    from ridgewave.operators import receivers

    short = spark.createDataFrame([(1, [1.0], [0.0]), (2, None, None), (3, [0.5] * 8, [0.5] * 8)], "frame_id int, i array<double>, q array<double>")
    got = {r["frame_id"]: r for r in receivers.demodulated(short, "QPSK", 4).collect()}
    assert "make a symbol" in got[1]["error"] and got[2]["error"] == "null input" and got[3]["symbols"] == [0, 0] and got[3]["error"] is None
    assert {r["frame_id"]: r["error"] for r in receivers.segments(short.withColumns({"detection_id": F.lit(0), "offset_hz": F.lit(0.0), "bandwidth_hz": F.lit(1.0)}), 1e3, 4).collect()}[1] == "1 samples, 4 are wanted"
    bad = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"x" * 64)), (3, bytearray(messages.burst(1, 2, 3, 1, 4, 5, 6, np.arange(2), np.array([1 + 2j, 3 - 1j]))))], "id int, data binary")
    burst = {r["id"]: r for r in messages.unpack_bursts(bad).collect()}
    assert burst[1]["error"] == "short burst" and burst[2]["error"].startswith("magic") and burst[3]["i"] == [1.0, 3.0] and burst[3]["flags"] == 6
    assert messages.decode_iq(spark.createDataFrame([(1, bytearray(b"ab"))], "frame_id int, message binary")).first()["error"]
    z = receivers.chirp_signal([3, 17, 31, 0], 6, lead=37)
    row = receivers.chirp_frames(spark.createDataFrame([(1, z.real.tolist(), z.imag.tolist())], "item_id int, i array<double>, q array<double>"), 6).first()
    assert row["start"] == 37 and row["symbols"] == [3, 17, 31, 0] and row["snr_db"] > 20


def test_eps_links_in_many_cells(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (200, 3)) for c in range(0, 12, 3)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    want = {(a, b) for a, b in np.argwhere(d <= 0.25) if a < b}
    for cell in (20, 300, 10_000):
        got = [(r["a"], r["b"]) for r in learning.eps_links(df, 0.25, cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_reconstruction_against_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6)) @ np.diag([5, 3, 2, 0.3, 0.2, 0.1])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    got = {r["id"]: r["anomaly_score"] for r in learning.reconstruction_anomaly(df, *learning.principal(df, 3), center=0.01, slope=50.0).collect()}
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:3]
    mse = ((centred - centred @ axes.T @ axes) ** 2).mean(axis=1)
    assert np.allclose([got[k] for k in range(300)], 1 / (1 + np.exp(-50 * (mse - 0.01))), atol=1e-9)


def test_tracks_query_against_plain_loops(spark):
    """The registered query against a tracker written as loops over plain lists."""
    from ridgewave.operators.cfar import Cfar
    from ridgewave.operators.peaks import Peaks, detect
    from ridgewave.plans.messages import tracks
    from ridgewave.sources.tables import RATE, psd_frames

    sf = "/root/testdata/sf0.001"
    frames: dict = {}
    for r in detect(psd_frames(spark, sf), Cfar(8, 2, 1e-2), Peaks(RATE, 1000.0), keep=("label", "frame_id")).collect():
        frames.setdefault(r["label"], {}).setdefault(r["frame_id"], []).append(r["center_freq_hz"])
    want = set()
    for label, by_frame in frames.items():
        alive, born = [], 0  # [name, hz, first, last, seen]
        for f in sorted(by_frame):
            t = f / 10
            alive = [a for a in alive if not t - a[3] > 3.0]
            before, fresh = [(a[1], a) for a in alive], []
            for hz in sorted(by_frame[f]):
                gap, k = min(((abs(hz - p), k) for k, (p, _) in enumerate(before)), default=(1e9, -1))
                if gap < 2000.0:
                    a = before[k][1]
                    a[1], a[3], a[4] = hz, t, a[4] + 1
                else:
                    fresh.append([f"trk-{born:06d}", hz, t, t, 1])
                    born += 1
            alive += fresh
            want |= {(label, t, a[0], round(a[1], 6), a[4]) for a in alive}
    assert {(r["label"], r["t"], r["track_id"], round(r["hz"], 6), r["frames_seen"]) for r in tracks(spark, sf).collect()} == want and want


def test_capture_descriptor(spark, tmp_path):
    x = np.array([[1 + 2j, -3 + 4j], [5 - 6j, 7 + 8j], [0, 1]])  # samples, channels
    (tmp_path / "c.bin").write_bytes(np.stack([x.real, x.imag], axis=2).astype(">i4").tobytes())
    for channel in (0, 1):
        row = captures.Capture("ci32", 1000, 868_000_000, "big", num_channels=2, channel=channel).read(spark, str(tmp_path / "c.bin")).first()
        assert np.allclose(np.array(row["i"]) + 1j * np.array(row["q"]), x[:, channel]) and row["center_freq_hz"] == 868e6
    name, options = captures.Capture("rtlsdr_u8", 1000).decoder
    assert np.allclose(captures.DECODERS[name](bytes([0, 255, 127, 128]), options), [-1 + 1j, (-0.5 + 0.5j) / 127.5])
    assert all(f in captures.DECODERS for f, _ in captures.FORMATS.values()) and len(captures.FORMATS) == 12
    for bad in ({"format": "nope"}, {"sample_rate_hz": 0}, {"endianness": "middle"}, {"channel": 1}):
        with pytest.raises(ValueError):
            captures.Capture(**({"format": "u8", "sample_rate_hz": 1} | bad))


def test_supervised_stream(spark, tmp_path):
    df = spark.range(30).select("id", (F.col("id") / 10).cast("int").alias("part"))
    told, calls, live = [], [], _stream(spark, tmp_path, df, "sup").drop("part")

    def start(fails):
        def batch(rows, number):
            calls.append(number)
            if len(calls) <= fails:
                raise RuntimeError("broken")
            rows.write.mode("append").parquet(str(tmp_path / f"out{fails}"))

        return lambda: live.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / f"c_sup{fails}")).trigger(availableNow=True).start()

    state.supervised(start(2), most=5, on_error=told.append, pause_s=0.0)
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 30 and not told
    calls.clear()
    with pytest.raises(Exception, match="broken"):
        state.supervised(start(99), most=3, on_error=told.append, pause_s=0.0)
    assert told[0]["consecutive_errors"] == 3 and len(calls) == 3


def test_anomaly_detectors(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, v.tolist(), float(v[0])) for k, v in enumerate(rng.normal(size=(80, 4)))] + [(99, [9.0, -9.0, 9.0, -9.0], 50.0)], "id long, x array<double>, v double")
    for kind, options in (("statistical", {"columns": ["v"]}), ("reconstruction", {"k": 2})):
        scores = {r["id"]: r["anomaly_score"] for r in learning.anomaly_detector(kind, **options)(df).collect()}
        assert len(scores) == 81 and all(0 <= s <= 1 for s in scores.values())
    assert max(learning.anomaly_detector("statistical", columns=["v"])(df).collect(), key=lambda r: r["anomaly_score"])["id"] == 99
    with pytest.raises(ValueError):
        learning.anomaly_detector("neural")
