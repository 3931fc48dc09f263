"""Settings that change while a capture runs, against separate runs cut at the changes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewave.operators import settings
from ridgewave.operators.peaks import detect
from ridgewave.operators.spectral import welch

BASE = {"spectrum": {"sample_rate": "64000", "fft_size": "64"}, "cfar": {"reference": "8", "guard": "2", "pfa": "1e-2"}, "peaks": {"sample_rate": "64000", "min_snr_db": "3"}}
START = 1_700_000_000


def blocks(spark, n: int = 90):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(n):
        z = rng.normal(0, 1, 512) + 1j * rng.normal(0, 1, 512) + 3 * np.exp(2j * np.pi * (0.1 + 0.003 * k) * np.arange(512))
        rows.append((k, z.real.tolist(), z.imag.tolist(), k // 30))
    df = spark.createDataFrame(rows, "seq long, i array<double>, q array<double>, part int")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("seq")))


def changes(spark):
    rows = [(START + 30, "peaks", {"min_snr_db": "9"}), (START + 60, "spectrum", {"fft_size": "128"}), (None, "cfar", {"pfa": "1"}), (START + 60, "peaks", {"min_bins": "2"})]
    return spark.createDataFrame(rows, "at long, section string, settings map<string,string>").select(F.timestamp_seconds("at").alias("valid_from"), "section", "settings")


def rows_of(df):
    return sorted((r["seq"], r["start_bin"], r["end_bin"], round(r["snr_db"], 9), round(r["center_freq_hz"], 6)) for r in df.collect())


def run(df, own):
    spec, cfar, peaks = (settings.made(s, own[s]) for s in ("spectrum", "cfar", "peaks"))
    return detect(welch(df, spec, ("seq",)), cfar, peaks, keep=("seq",))


def test_a_replay_equals_runs_cut_at_the_changes(spark):
    df = blocks(spark)
    versions = settings.Versions.read(changes(spark), BASE)
    assert len(versions.starts) == 2 and len(versions.sections) == 3
    got = settings.detect_versions(df, versions)
    assert {r["version"] for r in got.collect()} == {0, 1, 2}
    want = []
    for k, (a, b) in enumerate(((0, 30), (30, 60), (60, 90))):
        want += rows_of(run(df.where((F.col("seq") >= a) & (F.col("seq") < b)), versions.sections[k]))
    assert rows_of(got) == sorted(want) and len({s for s, *_ in want}) > 80


def test_only_changed_sections_run_anew(spark):
    versions = settings.Versions.read(changes(spark), BASE)
    assert [own for _, own in versions.settings("spectrum")] == [[0, 1], [2]] and [own for _, own in versions.settings("cfar")] == [[0, 1, 2]]
    assert [own for _, own in versions.settings("cfar", "peaks")] == [[0], [1], [2]]
    assert versions.at((START + 30) * 10**6) == 1 and versions.at((START + 30) * 10**6 - 1) == 0
    numbers = {r["seq"]: r["n"] for r in blocks(spark).select("seq", versions.number("ts").alias("n")).collect()}
    assert [numbers[k] for k in (0, 29, 30, 59, 60, 89)] == [0, 0, 1, 1, 2, 2]
    assert blocks(spark, 1).select(F.lit(None).cast("timestamp").alias("ts")).select(versions.number("ts").alias("n")).first()["n"] == 0
    assert settings.Versions.of(BASE, []).settings("peaks")[0][1] == [0]
    assert settings.changed(BASE, {"cfar": {"reference": "8", "pfa": "1e-3"}, "peaks": BASE["peaks"]}) == {"cfar": {"pfa": "1e-3"}}


def test_a_stream_takes_changes_by_event_time(spark, tmp_path):
    """A change written between batches counts for rows from its time on; the whole equals the replay."""
    df, folder = blocks(spark), str(tmp_path / "in")
    known = str(tmp_path / "changes")
    changes(spark).limit(0).write.parquet(known)
    schema = df.drop("part").schema

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        settings.detect_stream(stream, lambda s: s.read.parquet(known), BASE, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()

    for part in range(3):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
        if part == 1:
            changes(spark).write.mode("append").parquet(known)
        go()
    versions = settings.Versions.read(changes(spark), BASE)
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(settings.detect_versions(df, versions))


def test_files_and_presets(spark):
    assert settings.from_text(settings.to_text(BASE)) == BASE and settings.from_text("") == {}
    assert settings.from_text('{"cfar": {"reference": 16}}') == {"cfar": {"reference": "16"}}
    for bad in ("a: 1", "[1]", "nothing: {a: 1}", "cfar: {depth: 3}", "cfar: {pfa: 2}", "spectrum: {fft_size: 64}", "cfar: {reference: many}"):
        with pytest.raises(ValueError):
            settings.from_text(bad)
    with pytest.raises(ValueError):
        settings.Versions.of(BASE, [(1, "cfar", {"pfa": "7"})])
    rows = settings.preset(spark, "sensitive", "2024-01-01 00:00:00", {"cfar": settings.PRESETS["sensitive"]["cfar"]}).collect()
    assert [(r["section"], r["settings"]) for r in rows] == [("spectrum", {"fft_size": "4096", "overlap": "0.75"})]
    with pytest.raises(ValueError):
        settings.preset(spark, "none", "2024-01-01")
