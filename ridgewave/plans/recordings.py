"""Queries of recordings: written by the committing sink into the shared folder, and read back by byte ranges; and of captures in blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import halo, spectral
from ..operators.order import numbered, shared_folder
from ..sources import sink
from ..sources.captures import read_sigmf
from ..sources.tables import IQ_SQL, iq_frames

#: Samples of a block that is read back; frames have 32, so blocks don't fall on their borders.
READ = 100


def written(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder with one recording for each label, its frames as blocks in order, and what was written."""
    path = f"{shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    frames = iq_frames(spark, sf_dir).where("label IS NOT NULL")
    blocks = frames.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("name"), F.col("frame_id").alias("seq"), F.lit(64_000.0).alias("sample_rate"), (100e6 + F.col("label") * 1e6).alias("center_freq_hz"), "i", "q")
    return path, sink.write_recordings(blocks, path)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made one file each, with their samples and rates as the files tell them."""
    path, names = written(spark, sf_dir)
    sink.finished(spark, path, names=names).write.format("noop").mode("overwrite").save()
    power = F.aggregate(F.zip_with("i", "q", lambda a, b: a * a + b * b), F.lit(0.0), lambda s, x: s + x)
    read = read_sigmf(spark, path, 4096)
    return read.groupBy("name", "sample_rate", "center_freq_hz").agg(F.sum(F.size("i")).alias("n_samples"), F.round(F.sum(power), 4).alias("energy"))


def by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of recordings that are still in segments: each sample's place and value survive any cut."""
    path, _ = written(spark, sf_dir)
    samples = read_sigmf(spark, path, READ).select("name", "sample_start", F.posexplode(F.arrays_zip("i", "q")).alias("k", "x"))
    at = (F.col("sample_start") + F.col("k")).alias("at")
    placed = samples.select("name", at, "x.i", "x.q").groupBy("name", F.floor(F.col("at") / READ).alias("seq"))
    return placed.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("i"), 5).alias("sum_i"), F.round(F.sum(F.col("q") * (F.col("at") % READ)), 4).alias("moment_q"))


# -- captures in blocks ----------------------------------------------------------------------------
RATE, SPEC = 32_000.0, spectral.Welch(32_000.0, 16, 0.5)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture for each label: its frames are the blocks, in order."""
    placed = numbered(iq_frames(spark, sf_dir).where("label IS NOT NULL"), "label", "frame_id")
    return placed.select("label", F.col("place").alias("seq"), (F.col("place") * 32).alias("sample_start"), "i", "q")


def decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth sample of each capture behind the low-pass, across the blocks' borders."""
    out = halo.decimated_capture(captures(spark, sf_dir), 4, RATE, 16, "label")
    samples = out.select("label", "sample_start", F.posexplode(F.arrays_zip("i", "q")).alias("k", "x"))
    return samples.select("label", (F.col("sample_start") + F.col("k")).alias("n"), F.round("x.i", 9).alias("i"), F.round("x.q", 9).alias("q"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The averaged spectrum of each whole capture."""
    out = halo.welch_capture(captures(spark, sf_dir), SPEC, "label")
    return out.select("label", "n_segments", F.posexplode("psd").alias("bin", "psd")).withColumn("psd", F.round("psd", 12))


_CAPTURES_SQL = f"{IQ_SQL}, x AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY frame_id, n) - 1 AS t, count(*) OVER (PARTITION BY label) AS total, i, q FROM iq WHERE label IS NOT NULL)"
_TAPS = [float(x) for x in spectral.lowpass_taps(16, 0.8 * RATE / 4 / 2, RATE)]
_SCALE = repr(float(1 / (RATE * (spectral.window("hann", 16) ** 2).sum())))

QUERIES = {"k01_recordings": catalogue, "s01_capture_ranges": by_range, "f13_capture_decimate": decimated, "f06_capture_welch": spectra}
ORACLES = {
    "k01_recordings": f"WITH {IQ_SQL} SELECT 'label' || label AS name, 64000e0 AS sample_rate, 100e6 + label * 1e6 AS center_freq_hz, count(*) AS n_samples, round(sum(i * i + q * q), 4) AS energy FROM iq WHERE label IS NOT NULL GROUP BY label",
    "s01_capture_ranges": f"""WITH {IQ_SQL}, placed AS (SELECT 'label' || label AS name, row_number() OVER (PARTITION BY label ORDER BY frame_id, n) - 1 AS place, i, q FROM iq WHERE label IS NOT NULL)
SELECT name, place // {READ} AS seq, count(*) AS n, round(sum(i), 5) AS sum_i, round(sum(q * (place % {READ})), 4) AS moment_q FROM placed GROUP BY 1, 2""",
    "f13_capture_decimate": f"""WITH {_CAPTURES_SQL}, h AS (SELECT {_TAPS} AS h) SELECT a.label, a.t // 4 AS n, round(sum(b.i * h[a.t + 8 - b.t + 1]), 9) AS i, round(sum(b.q * h[a.t + 8 - b.t + 1]), 9) AS q
FROM x a JOIN x b ON b.label = a.label AND a.t % 4 = 0 AND b.t BETWEEN a.t - 8 AND a.t + 8, h GROUP BY 1, 2""",
    "f06_capture_welch": f"""WITH {_CAPTURES_SQL}, seg AS (SELECT label, s, t - s * 8 AS m, i, q FROM x, unnest([t // 8 - 1, t // 8]) u(s) WHERE s >= 0 AND s * 8 + 16 <= total),
win AS (SELECT label, s, m, (i - avg(i) OVER w) * 0.5 * (1 - cos(2 * pi() * m / 15.0)) AS i, (q - avg(q) OVER w) * 0.5 * (1 - cos(2 * pi() * m / 15.0)) AS q FROM seg WINDOW w AS (PARTITION BY label, s)),
dft AS (SELECT label, s, CAST(b AS INT) AS bin, pow(sum(i * cos(2 * pi() * m * (b - 8) / 16) + q * sin(2 * pi() * m * (b - 8) / 16)), 2) + pow(sum(q * cos(2 * pi() * m * (b - 8) / 16) - i * sin(2 * pi() * m * (b - 8) / 16)), 2) AS p
  FROM win, unnest(generate_series(0, 15)) v(b) GROUP BY 1, 2, 3)
SELECT label, count(*) AS n_segments, bin, round(avg(p) * {_SCALE}, 12) AS psd FROM dft GROUP BY label, bin""",
}
