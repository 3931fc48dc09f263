"""Captures by byte ranges, growing files as streams, and the committing sink of recordings."""

from __future__ import annotations

import json
import tracemalloc
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgewave.sources import captures, ranges, recordings, sink

BLOCKS = "name string, seq long, sample_rate double, center_freq_hz double, i array<double>, q array<double>"


def joined(rows) -> np.ndarray:
    rows = sorted(rows, key=lambda r: r["seq"])
    return np.concatenate([np.array(r["i"]) + 1j * np.array(r["q"]) for r in rows]) if rows else np.zeros(0)


@pytest.mark.parametrize("name, options", [
    ("cf32", {}), ("cf32", {"endian": "big"}), ("cf64", {}), ("ci16", {"scale": 100}), ("ci16", {"layout": "IIQQ"}), ("ci16", {"channels": 3, "channel": 1}), ("u8", {}),
    ("u16", {"layout": "IIQQ", "channels": 2, "channel": 1}), ("ci32", {"endian": "big"}), ("ci8", {}), ("wav", {}),
])
def test_ranges_equal_whole_files(spark, tmp_path, name, options):
    """Any format, with bytes left over and ranges of a few blocks, against decoding the whole file."""
    rng = np.random.default_rng(0)
    frame = ranges.PAIR_BYTES[name] * options.get("channels", 1)
    samples = 10_007
    if name == "wav":
        with wave.open(str(tmp_path / "x.wav"), "wb") as w:
            w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
            w.writeframes(rng.integers(-3000, 3000, 2 * samples).astype("<i2").tobytes())
        path, kind = tmp_path / "x.wav", "wav"
    else:
        data = rng.normal(0, 1, frame * samples // 4).astype("<f4").tobytes() if name == "cf32" else rng.normal(0, 1, frame * samples // 8).astype("<f8").tobytes() if name == "cf64" else rng.bytes(frame * samples)
        path, kind = tmp_path / "x.iq", name
        path.write_bytes(data + (b"\1" * (frame - 1) if options.get("layout") != "IIQQ" else b""))
    want = captures.DECODERS[name](path.read_bytes(), options)
    df = ranges.read_files(spark, str(path), kind, 300, range_bytes=7 * 300 * frame, **options)
    rows = df.collect()
    assert df.rdd.getNumPartitions() >= 4
    assert [r["seq"] for r in sorted(rows, key=lambda r: r["sample_start"])] == list(range(len(rows)))
    assert all(r["sample_start"] == 300 * r["seq"] for r in rows)
    assert np.array_equal(joined(rows), want, equal_nan=True)
    part = ranges.read_files(spark, str(path), kind, 300, sample_start=4500, sample_count=900, **options).collect()
    assert np.array_equal(joined(part), want[4500:5400], equal_nan=True)


def test_five_gigabytes_are_read_in_parts(spark, tmp_path):
    """A sparse file beyond the limit of a row: its plan, and a window far behind 4 GB."""
    path, pairs = tmp_path / "big.iq", 700_000_000
    with path.open("wb") as f:
        f.truncate(8 * pairs + 5)
        f.seek(8 * 650_000_000)
        f.write(np.arange(200_000, dtype="<f4").tobytes())
    reader = ranges.IqReader({"path": str(path), "format": "cf32", "block": "65536"})
    parts = reader.partitions()
    assert len(parts) == -(-8 * pairs // ranges.RANGE_BYTES) and parts[0].first == 0 and parts[-1].last == pairs
    assert all(a.last == b.first and a.last % 65_536 == 0 for a, b in zip(parts, parts[1:]))
    got = joined(ranges.read_files(spark, str(path), "cf32", 50_000, sample_start=650_000_000, sample_count=100_000).collect())
    assert np.array_equal(got.real, np.arange(0, 200_000, 2)) and np.array_equal(got.imag, np.arange(1, 200_000, 2))
    # a task holds a piece
    tracemalloc.start()
    read = sum(len(b) for _, blocks in ranges.blocks_of(reader.layout, parts[3], 65_536, 1 << 20) for b in blocks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == parts[3].last - parts[3].first and peak < 16 << 20


def test_files_of_folders_and_patterns(spark, tmp_path):
    for k, name in enumerate(("a.iq", "b.iq", "c.txt", "_d.iq", ".e.iq")):
        (tmp_path / name).write_bytes(np.full(2 * (k + 1), k, "<f4").tobytes())
    (tmp_path / "empty.iq").write_bytes(b"")
    (tmp_path / "short.iq").write_bytes(b"\1\2\3")
    names = lambda path: [p.rpartition("/")[2] for p, _ in ranges.files(path)]
    assert names(f"{tmp_path}/*.iq") == ["a.iq", "b.iq", "empty.iq", "short.iq"] and names(f"file://{tmp_path}/") == ["a.iq", "b.iq", "c.txt", "empty.iq", "short.iq"]
    rows = captures.read_raw(spark, f"file:{tmp_path}/*.iq", "cf32").collect()
    assert [(r["path"].rpartition("/")[2], len(r["i"])) for r in sorted(rows, key=lambda r: r["path"])] == [("a.iq", 1), ("b.iq", 2)]
    assert captures.read_raw(spark, str(tmp_path / "empty.iq"), "cf32").count() == 0
    with pytest.raises(FileNotFoundError):
        ranges.files(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        ranges.Layout.of("nope", {})
    assert not ranges.readable("viewfs://store/in") and ranges.readable(str(tmp_path))
    # a decoder without a sample size is given whole files
    captures.decoder("pairs_of_two")(lambda data, options: np.frombuffer(data, "u1")[::2] + 1j * np.frombuffer(data, "u1")[1::2])
    try:
        (tmp_path / "z.two").write_bytes(bytes(range(8)))
        row = captures.read_raw(spark, str(tmp_path / "z.two"), "pairs_of_two").first()
        assert row["i"] == [0, 2, 4, 6] and row["sample_start"] == 0
    finally:
        del captures.DECODERS["pairs_of_two"]


def test_wav_headers(tmp_path):
    path = tmp_path / "x.wav"
    with wave.open(str(path), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(b"\0" * 40)
    data = path.read_bytes()
    extra = data[:12] + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + data[12:]  # a chunk of odd length before the others
    path.write_bytes(extra)
    assert ranges.Layout.of("wav", {"rate": 8000}).data(str(path), len(extra)) == (len(extra) - 40, 10)
    for bad, rate in ((extra, 44_100), (b"nothing at all", None), (data[:36], None), (data[:22] + b"\1" + data[23:], None)):
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            ranges.Layout.of("wav", {"rate": rate}).data(str(path), len(bad))


@pytest.mark.parametrize("partial", ["false", "true"])
def test_stream_goes_on_from_its_offset(spark, tmp_path, partial):
    """Files grow and new ones come between runs of one query; each sample comes once."""
    folder = tmp_path / "landing"
    folder.mkdir()
    rng = np.random.default_rng(1)
    content = {name: rng.normal(0, 1, 2 * n).astype("<f4") for name, n in (("a", 5_000), ("b", 2_345))}
    ranges.register(spark)

    def run() -> list:
        stream = spark.readStream.format("iq").option("format", "cf32").option("block", 500).option("range_bytes", 4_000).option("partial", partial).load(str(folder))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    seen = []
    for step, (a, b) in enumerate([(1_203, 0), (1_203, 0), (3_000, 700), (5_000, 2_345)]):
        (folder / "a").write_bytes(content["a"][: 2 * a].tobytes() + b"\0\0\0")
        if b:
            (folder / "b").write_bytes(content["b"][: 2 * b].tobytes())
        rows = run()
        for name, n in (("a", a), ("b", b)):
            own = sorted((r for r in rows if r["path"].endswith("/" + name)), key=lambda r: r["sample_start"])
            got = np.concatenate([np.array(r["i"]) + 1j * np.array(r["q"]) for r in own]) if own else np.zeros(0)
            n = n if partial == "true" else n // 500 * 500
            want = content[name][: 2 * n : 2] + 1j * content[name][1 : 2 * n : 2]
            assert np.array_equal(got, want), (step, name)
            assert [r["sample_start"] for r in own] == np.cumsum([0, *(len(r["i"]) for r in own)])[:-1].tolist()
        seen.append(len(rows))
    assert seen[0] == seen[1] < seen[2] < seen[3]


def made(spark, names=("a", "b"), n: int = 40, size: int = 100):
    rng = np.random.default_rng(5)
    rows = [(name, seq, 1e3, 100e6, rng.normal(0, 1, size).astype("f4").astype(float).tolist(), rng.normal(0, 1, size).astype("f4").astype(float).tolist()) for name in names for seq in range(n)]
    return rows, spark.createDataFrame(rows, BLOCKS)


def visible(folder) -> list[str]:
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("_"))


def test_sink_segments_and_joining(spark, tmp_path):
    """Recordings spread over tasks: segments with offsets and a collection, read as one, then joined to one file."""
    rows, blocks = made(spark)
    want = {name: np.concatenate([np.array(r[4]) + 1j * np.array(r[5]) for r in rows if r[0] == name]) for name in ("a", "b")}
    written = {r["name"]: r["parts"] for r in sink.write_recordings(blocks.repartition(7), str(tmp_path), "several", parts=6).collect()}
    assert set(written) == {"a", "b"} and min(written.values()) > 1
    listed = json.loads((tmp_path / "a.sigmf-collection").read_text())["collection"]["core:streams"]
    assert [s["name"] for s in listed] == [f"a-{k:06d}" for k in range(written["a"])]
    metas = [json.loads((tmp_path / f"{s['name']}.sigmf-meta").read_text())["global"] for s in listed]
    assert metas[0]["core:offset"] == 0 and metas[1]["core:offset"] == (tmp_path / "a-000000.sigmf-data").stat().st_size // 8

    def whole(name):
        got = sorted((r for r in captures.read_sigmf(spark, str(tmp_path), 128).collect() if r["name"] == name), key=lambda r: r["sample_start"])
        assert [r["sample_start"] for r in got] == np.cumsum([0, *(len(r["i"]) for r in got)])[:-1].tolist()
        return np.concatenate([np.array(r["i"]) + 1j * np.array(r["q"]) for r in got])

    for name in "ab":
        assert np.array_equal(whole(name), want[name])
    notes = recordings.annotate(spark.createDataFrame([], recordings.ANNOTATIONS), "a", 2, 4, 99e6, 101e6, "burst")
    done = sink.finished(spark, str(tmp_path), notes, "one file")
    assert {r["name"]: r["n_samples"] for r in done.collect()} == {"a": 4000, "b": 4000}
    assert visible(tmp_path) == ["a.sigmf-data", "a.sigmf-meta", "b.sigmf-data", "b.sigmf-meta"]
    assert json.loads((tmp_path / "a.sigmf-meta").read_text())["annotations"][0]["core:label"] == "burst"
    for name in "ab":
        assert np.array_equal(whole(name), want[name])
    with pytest.raises(Exception, match="there already"):
        sink.write_recordings(blocks, str(tmp_path))
    assert np.array_equal(whole("a"), want["a"])
    sink.write_recordings(blocks.where("seq < 3"), str(tmp_path), overwrite=True, parts=1)
    assert np.array_equal(whole("a"), want["a"][:300])


def test_failed_jobs_leave_nothing(spark, tmp_path):
    rows, blocks = made(spark)
    broken = blocks.withColumn("q", F.when((F.col("name") == "b") & (F.col("seq") == 39), F.array(F.lit(1.0))).otherwise(F.col("q")))
    with pytest.raises(Exception, match="differ in length"):
        sink.write_recordings(broken, str(tmp_path), parts=4)
    assert visible(tmp_path) == [] and list((tmp_path / "_parts").iterdir()) == []
    with pytest.raises(Exception, match="share block numbers"):
        sink.register(spark)
        blocks.union(blocks).repartition(5, "seq", "i").write.format("sigmf").mode("append").save(str(tmp_path))
    assert visible(tmp_path) == [] and list((tmp_path / "_parts").iterdir()) == []
    with pytest.raises(Exception, match="missing columns"):
        blocks.drop("q").write.format("sigmf").mode("append").save(str(tmp_path))
    with pytest.raises(Exception, match="file's name"):
        sink.write_recordings(blocks.where("name = 'a'").withColumn("name", F.lit("../x")), str(tmp_path))
    assert visible(tmp_path) == [] and not list(tmp_path.parent.glob("x.*"))


def test_attempts_that_died_are_not_published(tmp_path):
    """An attempt that stopped half-way left a part; only parts that messages name count."""
    batch = lambda seqs: pa.RecordBatch.from_arrays([pa.array(["a"] * len(seqs)), pa.array(seqs), pa.array([1e3] * len(seqs)), pa.array([1e6] * len(seqs)), pa.array([[1.0 * s] for s in seqs]), pa.array([[0.0]] * len(seqs))], names=list(sink.NEEDED))
    w = sink.SigmfWriter(str(tmp_path), "", False)

    def dying():
        yield batch([0, 1])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(dying())
    messages = [w.write(iter([batch([2, 3])])), w.write(iter([batch([0, 1])])), w.write(iter([])), None]
    assert len(list((tmp_path / "_parts" / w.job).iterdir())) == 3 and visible(tmp_path) == []
    w.commit(messages)
    data = b"".join((tmp_path / f"a-{k:06d}.sigmf-data").read_bytes() for k in range(2))
    assert np.frombuffer(data, "<f4")[::2].tolist() == [0, 1, 2, 3] and not (tmp_path / "_parts" / w.job).exists()


def test_a_writer_holds_a_batch(tmp_path):
    """A part of 160 MB is written within the memory of a few batches."""
    values = pa.array(np.zeros(100_000))
    one = pa.ListArray.from_arrays(pa.array([0, 100_000], pa.int32()), values)

    def batches():
        for k in range(200):
            yield pa.RecordBatch.from_arrays([pa.array(["long"]), pa.array([k]), pa.array([1e3]), pa.array([1e6]), one, one], names=list(sink.NEEDED))

    w = sink.SigmfWriter(str(tmp_path), "", False)
    tracemalloc.start()
    message = w.write(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and message.parts[0].samples == 20_000_000 and len(message.parts) == 1
    w.commit([message])
    assert (tmp_path / "long.sigmf-data").stat().st_size == 160_000_000


def test_segments_are_found_exported_and_deleted(spark, tmp_path):
    import zipfile

    _, blocks = made(spark, ("a",))
    (tmp_path / "rec").mkdir(), (tmp_path / "zip").mkdir()
    n = sink.write_recordings(blocks, str(tmp_path / "rec"), parts=3).first()["parts"]
    assert recordings.find(spark, str(tmp_path / "rec"), "a").count() == n > 1
    recordings.export_zip(spark.createDataFrame([("a",)], "name string"), str(tmp_path / "rec"), str(tmp_path / "zip")).collect()
    with zipfile.ZipFile(tmp_path / "zip" / "a.zip") as z:
        assert len(z.namelist()) == 2 * n + 1 and sum(i.file_size for i in z.infolist() if i.filename.endswith("data")) == 8 * 4000
    assert recordings.delete(str(tmp_path / "rec"), "a") and visible(tmp_path / "rec") == [] and not recordings.delete(str(tmp_path / "rec"), "a")
    with pytest.raises(ValueError):
        recordings.annotate(spark.createDataFrame([], recordings.ANNOTATIONS), "a", 0, 1, 0.0, 1.0, "x", active=frozenset({"b"}))


def test_growing_source_and_clearing(spark, tmp_path):
    from ridgewave.operators.order import Stored, clear_shared, cut_lineage, shared_folder

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(np.arange(40, dtype="<i2").tobytes())
    stream = recordings.open_source(spark, "growing", path=str(tmp_path / "in"), format="ci16", block=5)
    stream.writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r["i"] for r in sorted(spark.table("grown").collect(), key=lambda r: r["seq"])] == [[float(k) for k in range(a, a + 10, 2)] for a in (0, 10, 20, 30)]
    kept = Stored(spark)
    rows = kept.write(spark.range(5))
    assert rows.count() == 5 and cut_lineage(spark.range(3)).count() == 3
    kept.drop(rows)
    clear_shared(spark)
    from pathlib import Path

    assert list(Path(shared_folder(spark).removeprefix("file:")).iterdir()) == []
    assert Stored(spark).write(spark.range(4)).count() == 4 and cut_lineage(spark.range(6)).count() == 6
