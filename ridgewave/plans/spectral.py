"""Queries over sample blocks and spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import map_frames
from ..functions.windows import CORRECTIONS, COSINES, corrections, window
from ..operators import spectral as op
from ..sources.tables import BINS_SQL, FRAMES_SQL, IQ_SQL, iq_frames, psd_frames, table

FS = 32_000.0
SPEC = op.Welch(FS, 16, 0.5)


def _bins(df: DataFrame, column: str, name: str, digits: int, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(column).alias("bin", "v")).select(*keep, "bin", F.round("v", digits).alias(name))


def _dft(n: int, window_sql: str, segments: str, detrend: bool, scale: str) -> str:
    mean = "avg(i) OVER (PARTITION BY frame_id, s)", "avg(q) OVER (PARTITION BY frame_id, s)"
    di, dq = (f"i - {mean[0]}", f"q - {mean[1]}") if detrend else ("i", "q")
    return f"""WITH {IQ_SQL}, seg AS (SELECT frame_id, s, n - s * {n // 2} AS m, i, q FROM iq, unnest({segments}) u(s) WHERE n - s * {n // 2} BETWEEN 0 AND {n - 1}),
win AS (SELECT frame_id, s, m, ({di}) * {window_sql} AS i, ({dq}) * {window_sql} AS q FROM seg),
dft AS (SELECT frame_id, s, CAST(b AS INT) AS bin, pow(sum(i * cos(2 * pi() * m * (b - {n // 2}) / {n}) + q * sin(2 * pi() * m * (b - {n // 2}) / {n})), 2)
  + pow(sum(q * cos(2 * pi() * m * (b - {n // 2}) / {n}) - i * sin(2 * pi() * m * (b - {n // 2}) / {n})), 2) AS pw FROM win, unnest(generate_series(0, {n - 1})) v(b) GROUP BY ALL),
psd AS (SELECT frame_id, s, bin, pw * {scale} AS p FROM dft)"""


_HANN = "0.5 * (1 - cos(2 * pi() * m / 15.0))"
_W = window("hann", 16)
_SQL = _dft(16, _HANN, "[0, 1, 2]", True, repr(float(1 / (FS * (_W**2).sum()))))
_NATIVE = op.Welch(FS, 16, 0.5, native=True)
_NATIVE_SQL = _dft(16, "0.5 * (1 - cos(2 * pi() * m / 16.0))", "[0, 1, 2]", False, repr(float(1 / (16 * (window("hann", 16, periodic=True) ** 2).sum()))))
_FLAT_SQL = _dft(16, "1", "[0, 1, 2]", False, repr(1 / 256))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of each vector under each window."""
    kinds = (*COSINES, "kaiser")
    shapes = np.stack([window(k, 64) for k in kinds])
    f = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "embedding")
    out = map_frames(f, lambda x: (x @ shapes.T,), ("embedding",), "v array<double>", ("frame_id",))
    names = F.array(*map(F.lit, kinds))
    return out.select("frame_id", F.explode(F.arrays_zip(names.alias("window"), F.col("v").alias("value"))).alias("x")).select("frame_id", "x.window", F.round("x.value", 6).alias("value"))


def window_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's mean power under each window's corrections: amplitude by coherent gain, noise by ENBW, and the gain in dB."""
    known = [(k, *map(float, corrections(k))) for k in (*CORRECTIONS, "kaiser")]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("window"), F.lit(g).alias("gain"), F.lit(e).alias("enbw"), F.lit(p).alias("db")) for k, g, _, e, p, _ in known))).alias("c")
    power = F.aggregate("psd", F.lit(0.0), lambda s, x: s + x) / F.size("psd")
    f = psd_frames(spark, sf_dir).select("frame_id", power.alias("p"), each)
    return f.select("frame_id", "c.window", F.round(F.col("p") / F.col("c.gain") ** 2, 9).alias("amplitude"), F.round(F.col("p") / F.col("c.enbw"), 9).alias("noise"), F.round(10 * F.log10(F.col("p") + 1e-12) + F.col("c.db"), 6).alias("db"))


def _folded(spark, sf_dir, step, db=False) -> DataFrame:
    f = psd_frames(spark, sf_dir)
    if db:
        f = f.withColumn("psd", F.transform("psd", lambda x: 10 * F.log10(x + 1e-12)))
    return _bins(op.fold_frames(f, "label", "frame_id", "psd", step), "state", "value", 9, "label", "frame_id")


_SERIES_SQL = f"WITH RECURSIVE {BINS_SQL}, x AS (SELECT *, 10 * log10(p + 1e-12) AS db, row_number() OVER (PARTITION BY label, bin ORDER BY frame_id) AS n FROM bins)"


def _recursive(first: str, then: str) -> str:
    return f"""{_SERIES_SQL}, y AS (SELECT label, bin, frame_id, n, CAST({first} AS DOUBLE) AS v FROM x WHERE n = 1
UNION ALL SELECT x.label, x.bin, x.frame_id, x.n, {then} FROM y JOIN x ON x.label = y.label AND x.bin = y.bin AND x.n = y.n + 1)
SELECT label, frame_id, bin, round(v, 9) AS value FROM y"""


LEVELS = 32


def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = psd_frames(spark, sf_dir).withColumn("psd", F.transform("psd", lambda x: 10 * F.log10(x + 1e-12)))
    last = op.fold_frames(f, "label", "frame_id", "psd", op.persistence(LEVELS, -60.0, 0.0), keep_all=False)
    cells = last.select("label", F.posexplode("state").alias("cell", "value")).where("value > 1e-9")
    return cells.select("label", F.floor(F.col("cell") / LEVELS).alias("bin"), (F.col("cell") % LEVELS).alias("level"), F.round("value", 6).alias("value"))


def _iq_long(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select("frame_id", F.posexplode(F.arrays_zip("x", "y")).alias("n", "c")).select("frame_id", "n", F.round("c.x", digits).alias("i"), F.round("c.y", digits).alias("q"))


def shifted(spark, sf_dir):
    def kernel(i, q):
        z = op.shifted(i + 1j * q, 1500.0, FS)
        return z.real, z.imag

    return _iq_long(map_frames(iq_frames(spark, sf_dir), kernel, ["i", "q"], "x array<double>, y array<double>", ["frame_id"]))


def decimated(spark, sf_dir):
    def kernel(i, q):
        z = op.decimated(i + 1j * q, 4, FS, order=16)
        return z.real, z.imag

    return _iq_long(map_frames(iq_frames(spark, sf_dir), kernel, ["i", "q"], "x array<double>, y array<double>", ["frame_id"]))


def _real(kernel, name, digits=6):
    def query(spark, sf_dir):
        out = map_frames(iq_frames(spark, sf_dir), lambda i, q: (kernel(i + 1j * q),), ["i", "q"], "x array<double>", ["frame_id"])
        return out.select("frame_id", F.posexplode("x").alias("n", "v")).select("frame_id", "n", F.round("v", digits).alias(name))

    return query


def block_stat(stat, factor: int = 8):
    """Bins reduced by blocks, inside the row."""

    def query(spark, sf_dir):
        f = psd_frames(spark, sf_dir)
        blocks = F.transform(F.sequence(F.lit(0), F.lit(64 // factor - 1)), lambda b: stat(F.slice("psd", b * factor + 1, factor)))
        return _bins(f.select("frame_id", blocks.alias("v")), "v", "p", 10, "frame_id")

    return query


def _mean(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def quantized(spark, sf_dir):
    """dB as bytes, truncating, and back."""
    f = psd_frames(spark, sf_dir).select("frame_id", F.posexplode(F.transform("psd", lambda x: 10 * F.log10(x + 1e-12))).alias("bin", "db"))
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("db") + 120) / 100 * 255))).cast("int")
    return f.select("frame_id", "bin", level.alias("level")).withColumn("db", F.round(F.col("level") / 255.0 * 100 - 120, 6))


def shape(spark, sf_dir):
    """Flatness, centroid and spread of each spectrum, in the row."""
    total = F.aggregate("psd", F.lit(0.0), lambda s, x: s + x)
    f = psd_frames(spark, sf_dir).withColumn("total", total)
    logs = F.aggregate("psd", F.lit(0.0), lambda s, x: s + F.log(x + 1e-12))
    f = f.withColumn("flatness", F.exp(logs / 64) / (F.col("total") / 64 + 1e-12))
    at = F.aggregate(F.transform("psd", lambda x, k: x * k / 64), F.lit(0.0), lambda s, x: s + x)
    f = f.withColumn("centroid", at / (F.col("total") + 1e-12))
    spread = F.aggregate(F.transform("psd", lambda x, k: x * F.pow(k / 64 - F.col("centroid"), 2)), F.lit(0.0), lambda s, x: s + x)
    f = f.withColumn("spread", F.sqrt(spread / (F.col("total") + 1e-12)))
    return f.select("frame_id", *(F.round(c, 8).alias(c) for c in ("flatness", "centroid", "spread")))


def plane_cfar(spark, sf_dir, mode="standard"):
    """Two-dimensional CFAR over the spectrogram of each label."""
    from ..operators.cfar import plane_frames

    return _bins(plane_frames(psd_frames(spark, sf_dir), "label", "frame_id", "psd", 4, 1, mode), "noise", "noise", 8, "label", "frame_id")


def _plane_sql(shift: int) -> str:
    def across(half: int) -> str:
        return f"list_sum(list_transform(generate_series(b - {half + shift}, b + {half - shift}), lambda i: psd[greatest(1, least(64, i + 1))]))"

    return f"""WITH {FRAMES_SQL}, x AS (SELECT label, frame_id, psd, row_number() OVER (PARTITION BY label ORDER BY frame_id) - 1 AS t FROM frames),
size AS (SELECT label, max(t) AS last FROM x GROUP BY label),
h AS (SELECT label, frame_id, t, CAST(b AS INT) AS bin, {across(5)} AS wide, {across(1)} AS near FROM x, unnest(generate_series(0, 63)) u(b))
SELECT c.label, c.frame_id, c.bin, round(sum(v.wide - CASE WHEN abs(dt) <= 1 THEN v.near ELSE 0 END) / {11**2 - 9}, 8) AS noise
FROM h c JOIN size USING (label), unnest(generate_series(-5, 5)) o(dt) JOIN h v ON v.label = c.label AND v.bin = c.bin AND v.t = greatest(0, least(last, c.t + dt - {shift})) GROUP BY ALL"""


QUERIES = {
    "f01_windows": windows,
    "f03_window_factors": window_factors,
    "f06_welch_psd": lambda s, d: _bins(op.welch(iq_frames(s, d), SPEC), "psd", "psd", 12, "frame_id"),
    "f07_spectrum_scale": lambda s, d: _bins(op.welch(iq_frames(s, d), op.Welch(FS, 16, 0.5, window="rectangular", scaling="spectrum", detrend=False)), "psd", "psd", 9, "frame_id"),
    "f08_psd_db": lambda s, d: _bins(op.welch(iq_frames(s, d), SPEC), "psd_db", "db", 5, "frame_id").withColumn("freq_hz", F.round((F.col("bin") - 8) * FS / 16, 3)),
    "f10_spectrogram": lambda s, d: _bins(op.spectrogram(iq_frames(s, d), SPEC).withColumn("time_s", F.round("time_s", 9)), "psd", "psd", 12, "frame_id", "segment", "time_s"),
    "f11_native_psd": lambda s, d: _bins(op.welch(iq_frames(s, d), _NATIVE), "psd_db", "db", 5, "frame_id"),
    "g01_welch_average": lambda s, d: op.spectrogram(iq_frames(s, d), SPEC).select("frame_id", F.posexplode("psd").alias("bin", "p")).groupBy("frame_id", "bin").agg(F.round(F.avg("p"), 12).alias("psd")),
    "f12_frequency_shift": shifted,
    "f13_decimate": decimated,
    "f15_envelope": _real(np.abs, "envelope", 9),
    "f15_analytic": _real(lambda z: np.abs(op.analytic(z.real)), "envelope", 7),
    "f16_lowpass": _real(lambda z: op.brick_lowpass(z, 6000.0, FS).real, "i", 8),
    "f14_channelizer": _real(lambda z: np.abs(op.channelized(z, 4)).reshape(len(z), -1), "level", 8),
    "w19_instantaneous_frequency": _real(lambda z: op.instantaneous_frequency(z, FS), "hz", 4),
    "w20_rolling_ema": lambda s, d: _folded(s, d, op.ema(0.1)),
    "w21_running_average": lambda s, d: _folded(s, d, op.running_average(8)),
    "w22_peak_hold": lambda s, d: op.held_peaks(psd_frames(s, d), "label", "frame_id", "psd").withColumn("value", F.round("value", 9)),
    "w22_peak_hold_decay": lambda s, d: op.held_peaks(psd_frames(s, d).withColumn("db", F.transform("psd", lambda x: 10 * F.log10(x + 1e-12))), "label", "frame_id", "db", 0.5).withColumn("value", F.round("value", 9)),
    "w23_fixed_ema": lambda s, d: _folded(s, d, op.ema(0.3), db=True),
    "w24_persistence": persistence,
    "w25_waterfall": lambda s, d: _bins(psd_frames(s, d).orderBy(F.desc("frame_id")).limit(256), "psd", "p", 10, "frame_id", "label"),
    "w28_bin_lookup": lambda s, d: psd_frames(s, d).select("frame_id", F.floor((F.col("frame_id") * 10.0 + 32000) / 64000 * 64).alias("bin")),
    "w08_plane_cfar": plane_cfar,
    "w08_plane_cfar_reference": lambda s, d: plane_cfar(s, d, "reference"),
    "g20_psd_block_mean": block_stat(_mean),
    "g21_psd_block_max": block_stat(F.array_max),
    "k06_quantized": quantized,
    "m02_spectral_shape": shape,
    "g18_mean_power": lambda s, d: iq_frames(s, d).select("frame_id", F.round(10 * F.log10(_mean(F.zip_with("i", "q", lambda a, b: a * a + b * b)) + 1e-12), 7).alias("power_db")),
}
_COS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS window, CAST(n AS INT) AS n, round({' + '.join(f'({(-1) ** j * a!r}) * cos({2 * j} * pi() * n / 63)' for j, a in enumerate(c))}, 15) AS value FROM unnest(generate_series(0, 63)) u(n)" for k, c in COSINES.items())
_BESSEL = "list_sum(list_transform(generate_series(0, 40), lambda k: pow(({x}) / 2, 2 * k) / pow(gamma(k + 1), 2)))"
_KAISER_SQL = f"SELECT 'kaiser' AS window, CAST(n AS INT) AS n, round({_BESSEL.format(x='6 * sqrt(1 - pow(2 * n / 63e0 - 1, 2))')} / {_BESSEL.format(x='6e0')}, 15) AS value FROM unnest(generate_series(0, 63)) u(n)"
_TAPS = [float(x) for x in op.lowpass_taps(16, 0.8 * FS / 4 / 2, FS)]
ORACLES = {
    "f01_windows": f"WITH w AS ({_COS_SQL} UNION ALL {_KAISER_SQL}) SELECT vec_id AS frame_id, w.window, round(sum(CAST(embedding[n + 1] AS DOUBLE) * value), 6) AS value FROM embeddings, w GROUP BY 1, 2",
    "f06_welch_psd": f"{_SQL} SELECT frame_id, bin, round(avg(p), 12) AS psd FROM psd GROUP BY 1, 2",
    "f07_spectrum_scale": f"{_FLAT_SQL} SELECT frame_id, bin, round(avg(p), 9) AS psd FROM psd GROUP BY 1, 2",
    "f08_psd_db": f"{_SQL} SELECT frame_id, bin, round(10 * log10(avg(p) + 1e-12), 5) AS db, CAST(round((bin - 8) * 2e3, 3) AS DOUBLE) AS freq_hz FROM psd GROUP BY 1, 2",
    "f10_spectrogram": f"{_SQL} SELECT frame_id, CAST(s AS INT) AS segment, round(s * 8e0 / 32e3, 9) AS time_s, bin, round(p, 12) AS psd FROM psd",
    "f11_native_psd": f"{_NATIVE_SQL} SELECT frame_id, bin, round(greatest(-200, 10 * log10(greatest(avg(p), 1e-20))), 5) AS db FROM psd GROUP BY 1, 2",
    "g01_welch_average": f"{_SQL} SELECT frame_id, bin, round(avg(p), 12) AS psd FROM psd GROUP BY 1, 2",
    "f12_frequency_shift": f"WITH {IQ_SQL}, x AS (SELECT *, 2 * pi() * 1500 / 32000 * n AS a FROM iq) SELECT frame_id, n, round(i * cos(a) - q * sin(a), 9) AS i, round(i * sin(a) + q * cos(a), 9) AS q FROM x",
    "f13_decimate": f"WITH {IQ_SQL}, h AS (SELECT {_TAPS} AS h) SELECT a.frame_id, CAST(m AS INT) AS n, round(sum(b.i * h[4 * m + 8 - b.n + 1]), 9) AS i, round(sum(b.q * h[4 * m + 8 - b.n + 1]), 9) AS q FROM (SELECT DISTINCT frame_id FROM iq) a, unnest(generate_series(0, 7)) u(m), h JOIN iq b ON b.frame_id = a.frame_id AND 4 * m + 8 - b.n BETWEEN 0 AND 16 GROUP BY 1, 2",
    "f15_envelope": f"WITH {IQ_SQL} SELECT frame_id, n, round(sqrt(i * i + q * q), 9) AS envelope FROM iq",
    "w19_instantaneous_frequency": f"""WITH {IQ_SQL}, d AS (SELECT frame_id, n, lead(atan2(q, i)) OVER w - atan2(q, i) AS d FROM iq WINDOW w AS (PARTITION BY frame_id ORDER BY n)),
f AS (SELECT frame_id, n, CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END * 32e3 / (2 * pi()) AS hz FROM d)
SELECT frame_id, n, round(coalesce(hz, lag(hz) OVER (PARTITION BY frame_id ORDER BY n)), 4) AS hz FROM f""",
    "w20_rolling_ema": _recursive("p", "0.1 * x.p + 0.9 * y.v"),
    "w21_running_average": _recursive("p", "y.v + (x.p - y.v) / least(x.n, 8)"),
    "w22_peak_hold": f"WITH {BINS_SQL} SELECT label, frame_id, bin, round(max(p) OVER (PARTITION BY label, bin ORDER BY frame_id ROWS UNBOUNDED PRECEDING), 9) AS value FROM bins",
    "w22_peak_hold_decay": _SERIES_SQL.replace("RECURSIVE ", "") + " SELECT label, frame_id, bin, round(max(db + 0.5 * n) OVER (PARTITION BY label, bin ORDER BY n ROWS UNBOUNDED PRECEDING) - 0.5 * n, 9) AS value FROM x",
    "w23_fixed_ema": _recursive("db", "0.3 * x.db + 0.7 * y.v"),
    "w24_persistence": f"""{_SERIES_SQL}, h AS (SELECT label, bin, n, greatest(0, least({LEVELS - 1}, CAST(trunc((db + 60) / 60 * {LEVELS}) AS INT))) AS level FROM x),
cells AS (SELECT DISTINCT label, bin, level FROM h), last AS (SELECT label, max(n) AS last FROM h GROUP BY 1),
y AS (SELECT c.*, 1 AS n, CASE WHEN h.level = c.level THEN 0.3e0 ELSE 0e0 END AS v FROM cells c JOIN h ON h.label = c.label AND h.bin = c.bin AND h.n = 1
UNION ALL SELECT y.label, y.bin, y.level, CAST(h.n AS INT), least(1e0, greatest(0e0, y.v - 0.02) + CASE WHEN h.level = y.level THEN 0.3e0 ELSE 0e0 END) FROM y JOIN h ON h.label = y.label AND h.bin = y.bin AND h.n = y.n + 1)
SELECT y.label, CAST(bin AS BIGINT) AS bin, level, round(v, 6) AS value FROM y JOIN last ON last.label = y.label AND n = last WHERE v > 1e-9""",
    "w25_waterfall": f"WITH {BINS_SQL} SELECT frame_id, label, bin, round(p, 10) AS p FROM bins WHERE frame_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id DESC LIMIT 256)",
    "f14_channelizer": f"""WITH {IQ_SQL}, h AS (SELECT {[float(x) for x in op.prototype(4, 8)]} AS h), arm AS (SELECT frame_id, t, r, sum(h[k * 4 + r + 1] * i) AS i, sum(h[k * 4 + r + 1] * q) AS q
  FROM h, unnest(generate_series(0, 7)) a(t), unnest(generate_series(0, 3)) b(r), unnest(generate_series(0, 7)) c(k) JOIN iq ON iq.n = 4 * (t - (k - 4)) + r GROUP BY 1, 2, 3),
ch AS (SELECT frame_id, t, c, sum(i * cos(pi() * r * c / 2) + q * sin(pi() * r * c / 2)) AS i, sum(q * cos(pi() * r * c / 2) - i * sin(pi() * r * c / 2)) AS q FROM arm, unnest(generate_series(0, 3)) d(c) GROUP BY 1, 2, 3)
SELECT frame_id, CAST(c * 8 + t AS INT) AS n, round(sqrt(i * i + q * q), 8) AS level FROM ch""",
    "f15_analytic": f"WITH {IQ_SQL}, hilbert AS (SELECT a.frame_id, a.n, sum(CASE WHEN (a.n - b.n) % 2 <> 0 THEN b.i / 16 / tan(pi() * (a.n - b.n) / 32) ELSE 0 END) AS v FROM iq a JOIN iq b USING (frame_id) GROUP BY 1, 2) SELECT frame_id, n, round(sqrt(i * i + v * v), 7) AS envelope FROM iq JOIN hilbert USING (frame_id, n)",
    "f16_lowpass": f"""WITH {IQ_SQL}, gain AS (SELECT k, CASE WHEN f <= 6000 THEN 1e0 WHEN f < 6600 THEN 0.5 * (1 + cos(pi() * (f - 6000) / 600)) ELSE 0 END AS g FROM (SELECT k, 1e3 * least(k, 32 - k) AS f FROM unnest(generate_series(0, 31)) u(k))),
h AS (SELECT d, sum(g * cos(2 * pi() * k * d / 32)) / 32 AS h FROM gain, unnest(generate_series(-31, 31)) v(d) GROUP BY d)
SELECT a.frame_id, a.n, round(sum(b.i * h), 8) + 0 AS i FROM iq a JOIN iq b USING (frame_id) JOIN h ON d = a.n - b.n GROUP BY 1, 2""",
    "f03_window_factors": f"WITH {FRAMES_SQL}, f AS (SELECT frame_id, list_avg(psd) AS p FROM frames), c AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x!r}e0' for x in v)})" for k, v in CORRECTIONS.items()) + f""") c("window", coherent_gain, noise_bandwidth, enbw, processing_gain_db, sidelobe_db) UNION ALL
(WITH w AS (SELECT n, {_BESSEL.format(x='6 * sqrt(greatest(0, 1 - pow(2 * n / 1023e0 - 1, 2)))')} / {_BESSEL.format(x='6e0')} AS w FROM unnest(generate_series(0, 1023)) u(n)),
s AS (SELECT b, sqrt(pow(sum(w * cos(2 * pi() * n * b / 8192)), 2) + pow(sum(w * sin(2 * pi() * n * b / 8192)), 2)) AS m FROM w, unnest(generate_series(0, 63)) v(b) GROUP BY b),
r AS (SELECT min(b) AS first FROM (SELECT b, lead(m) OVER (ORDER BY b) > m AS up FROM s) WHERE up)
SELECT 'kaiser', avg(w), count(*) * sum(w * w) / pow(sum(w), 2), count(*) * sum(w * w) / pow(sum(w), 2), -10 * log10(count(*) * sum(w * w) / pow(sum(w), 2)),
  (SELECT round(20 * log10(max(m) FILTER (b >= first) / max(m) FILTER (b = 0) + 1e-12), 9) FROM s, r) FROM w)) SELECT frame_id, c.window, round(p / pow(coherent_gain, 2), 9) AS amplitude, round(p / enbw, 9) AS noise, round(10 * log10(p + 1e-12) + processing_gain_db, 6) AS db FROM f, c""",
    "w28_bin_lookup": f"WITH {FRAMES_SQL} SELECT frame_id, CAST(floor((frame_id * 10.0 + 32000) / 64000 * 64) AS BIGINT) AS bin FROM frames",
    "w08_plane_cfar": _plane_sql(0),
    "w08_plane_cfar_reference": _plane_sql(5),
    "g20_psd_block_mean": f"WITH {BINS_SQL} SELECT frame_id, CAST(bin // 8 AS INT) AS bin, round(avg(p), 10) AS p FROM bins GROUP BY 1, 2",
    "g21_psd_block_max": f"WITH {BINS_SQL} SELECT frame_id, CAST(bin // 8 AS INT) AS bin, round(max(p), 10) AS p FROM bins GROUP BY 1, 2",
    "k06_quantized": f"WITH {BINS_SQL}, x AS (SELECT frame_id, bin, CAST(floor(greatest(0, least(255, (10 * log10(p + 1e-12) + 120) / 100 * 255))) AS INT) AS level FROM bins) SELECT frame_id, bin, level, round(level / 255.0e0 * 100 - 120, 6) AS db FROM x",
    "m02_spectral_shape": f"WITH {BINS_SQL}, t AS (SELECT frame_id, sum(p) AS total, exp(avg(ln(p + 1e-12))) / (avg(p) + 1e-12) AS flatness, sum(p * bin / 64) / (sum(p) + 1e-12) AS centroid FROM bins GROUP BY 1) SELECT frame_id, round(flatness, 8) AS flatness, round(centroid, 8) AS centroid, round(sqrt(sum(p * pow(bin / 64 - centroid, 2)) / (total + 1e-12)), 8) AS spread FROM bins JOIN t USING (frame_id) GROUP BY frame_id, flatness, centroid, total",
    "g18_mean_power": f"WITH {IQ_SQL} SELECT frame_id, round(10 * log10(avg(i * i + q * q) + 1e-12), 7) AS power_db FROM iq GROUP BY 1",
}
