"""Queries of forensics and demodulation over the sample blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import map_frames
from ..functions.windows import window
from ..operators import demod, forensics
from ..sources.tables import IQ_SQL, iq_frames, table

FS = 32_000.0
FREQS = (np.arange(16) - 8) * FS / 16


def scalars(kernel, outputs: str, digits: int = 7):
    """A query of one row a frame, doubles rounded."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = map_frames(iq_frames(spark, sf_dir), lambda i, q: kernel(i + 1j * q), ["i", "q"], outputs, ["frame_id"])
        return out.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))

    return query


def _cumulants(mode):
    def kernel(z):
        c = forensics.cumulants(z, mode)
        return c["c40"].real, c["c40"].imag, c["c42"].real, c["c42"].imag

    return scalars(kernel, "c40_re double, c40_im double, c42_re double, c42_im double")


def nearest_modulation(z):
    c = forensics.cumulants(z, "standard")
    names = list(forensics.CUMULANTS)
    table_ = np.array(list(forensics.CUMULANTS.values()))
    d = np.hypot(np.abs(c["c40"][:, None] - table_[None, :, 0]), np.abs(c["c42"][:, None] - table_[None, :, 1]))
    at = d.round(12).argmin(axis=1)
    best = d[np.arange(len(d)), at]
    return [names[k] for k in at], best, forensics.confidence(best)


def nearest_kurtosis(z):
    k = forensics.kurtosis(z)
    names, values = list(forensics.KURTOSIS), np.array(list(forensics.KURTOSIS.values()))
    return k, [names[a] for a in np.abs(k[:, None] - values).argmin(axis=1)]


def rates(z):
    """Both estimators over 32 points and their combination."""
    f2, c2, s2 = forensics.symbol_rate(z, FS, 2, 32)
    f4, c4, s4 = forensics.symbol_rate(z, FS, 4, 32, high=3e3)
    mean, conf = forensics.combined_rate(np.stack([f2, f4], 1), np.stack([c2, c4], 1))
    return f2, s2, f4, s4, mean, conf


def scd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    alphas = np.arange(-4, 5) * FS / 16

    def kernel(i, q):
        scd = forensics.spectral_correlation(i + 1j * q, 16, 4, alphas, FS, window("hann", 16))
        return [[forensics.cyclic_features(s, alphas, FREQS, FS / 32, 6.0) for s in scd]]

    kind = "found array<struct<cyclic_hz: double, spectral_hz: double, magnitude: double, phase: double, snr_db: double>>"
    return map_frames(iq_frames(spark, sf_dir), kernel, ["i", "q"], kind, ["frame_id"]).select("frame_id", F.posexplode("found").alias("place", "f")).select("frame_id", "place", *(F.round(f"f.{c}", 6).alias(c) for c in ("cyclic_hz", "spectral_hz", "magnitude", "phase", "snr_db")))


def scd_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectral correlation at one cyclic frequency, two bins."""

    def kernel(i, q):
        scd = forensics.spectral_correlation(i + 1j * q, 16, 8, np.array([2 * FS / 16]), FS, np.ones(16))
        return scd[:, 0].real, scd[:, 0].imag

    out = map_frames(iq_frames(spark, sf_dir), kernel, ["i", "q"], "re array<double>, im array<double>", ["frame_id"])
    return out.select("frame_id", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c")).select("frame_id", "bin", F.round("c.re", 8).alias("re"), F.round("c.im", 8).alias("im"))


def crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "utf-8").alias("data"))
    return b.select("item_id", demod.crc24_column(F.col("data")).cast("long").alias("crc"), F.upper(F.hex("data")).alias("hex"))


def pdus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 4096).cast("int").alias("header"))
    return e.groupBy(demod.pdu_type(F.col("header")).alias("pdu")).agg(F.count(F.lit(1)).alias("n"))


def qpsk(z):
    x = z[:, demod.best_phase(z, 1)[0] :]
    return (demod.decide(x, demod.constellation("QPSK")),)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = map_frames(iq_frames(spark, sf_dir), lambda i, q: qpsk(i + 1j * q), ["i", "q"], "s array<int>", ["frame_id"])
    return out.select("frame_id", F.posexplode("s").alias("n", "symbol"))


def discriminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = map_frames(iq_frames(spark, sf_dir), lambda i, q: (demod.discriminator(i + 1j * q, 4000.0, FS),), ["i", "q"], "y array<double>", ["frame_id"])
    return out.select("frame_id", F.posexplode("y").alias("n", "v")).select("frame_id", "n", F.round("v", 7).alias("v"))


def sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = map_frames(iq_frames(spark, sf_dir), lambda i, q: (demod.slice_bits(i, 4),), ["i", "q"], "b array<int>", ["frame_id"])
    return out.select("frame_id", F.aggregate("b", F.lit(0), lambda s, x: s * 2 + x).alias("bits"))


def costas_block(z):
    y = [demod.costas(x)[0] for x in z]
    return np.array([v[-1].real for v in y]), np.array([v[-1].imag for v in y])


def cyclic_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(i, q):
        z = forensics.cyclic_slice(i + 1j * q, 16, 2000.0, FS)
        return z.real, z.imag

    out = map_frames(iq_frames(spark, sf_dir), kernel, ["i", "q"], "re array<double>, im array<double>", ["frame_id"])
    return out.select("frame_id", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c")).select("frame_id", "bin", F.round("c.re", 8).alias("re"), F.round("c.im", 8).alias("im"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest modulation with a confidence lowered by an SNR of 6 dB."""
    def kernel(i, q):
        names, d, _ = nearest_modulation(i + 1j * q)
        return names, forensics.confidence(d, 6.0)

    out = map_frames(iq_frames(spark, sf_dir), kernel, ["i", "q"], "modulation string, confidence double", ["frame_id"])
    return out.select("frame_id", "modulation", F.round("confidence", 6).alias("confidence"))


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = map_frames(iq_frames(spark, sf_dir), lambda i, q: (forensics.features(i + 1j * q, FS),), ["i", "q"], "x array<double>", ["frame_id"])
    return out.select("frame_id", F.posexplode("x").alias("place", "v")).select("frame_id", "place", F.round("v", 6).alias("v"))


def constellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each frame's samples lie nearest to each point of three constellations, and how far off they are."""
    points = {m: demod.constellation(m) for m in ("BPSK", "QPSK", "8PSK")}

    def nearest(i, q):
        x = i + 1j * q
        at = {m: demod.decide(x, p) for m, p in points.items()}
        return [[{"modulation": m, "k": int(k), "error": float(abs(v - points[m][k]) ** 2)} for m in points for v, k in zip(row, at[m][r])] for r, row in enumerate(x)],

    out = map_frames(iq_frames(spark, sf_dir), nearest, ("i", "q"), "d array<struct<modulation: string, k: int, error: double>>", ("frame_id",))
    return out.select("frame_id", F.explode("d").alias("d")).groupBy("frame_id", "d.modulation", "d.k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d.error"), 6).alias("error"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the bits of each benchmark text that look like the access address by 22 of 32 bits or more."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "utf-8").alias("data"))

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            found = [demod.find_address(np.unpackbits(np.frombuffer(x.as_py(), np.uint8), bitorder="little")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["item_id", "at"])

    return b.mapInArrow(search, "item_id long, at array<int>").select("item_id", F.explode("at").alias("at"))


QUERIES = {
    "f21_cyclic_slice": cyclic_slice,
    "m19_classification": classified,
    "m01_feature_vectors": feature_vectors,
    "b04_address_search": addresses,
    "b09_constellations": constellations,
    "g14_constellation_stats": scalars(forensics.constellation_stats, "power_db double, evm_percent double, snr_db double", 6),
    "g02_cumulants_reference": _cumulants("reference"),
    "g02_cumulants_standard": _cumulants("standard"),
    "g03_kurtosis": scalars(lambda z: (forensics.kurtosis(z),), "kurtosis double"),
    "j06_nearest_modulation": scalars(nearest_modulation, "modulation string, distance double, confidence double", 6),
    "j07_nearest_kurtosis": scalars(nearest_kurtosis, "kurtosis double, modulation string"),
    "f22_symbol_rates": scalars(rates, "rate2_hz double, snr2_db double, rate4_hz double, snr4_db double, rate_hz double, confidence double", 5),
    "f25_gardner_error": scalars(lambda z: (forensics.gardner_error(z, 4),), "error double", 9),
    "f25_mueller_error": scalars(lambda z: (forensics.mueller_error(z, np.sign(z[:, ::4].real) + 0j, 4),), "error double", 9),
    "f18_spectral_correlation": scd_plane,
    "f19_cyclic_features": scd_features,
    "b01_discriminator": discriminated,
    "b03_sliced_bits": sliced,
    "b06_crc24": crc,
    "b08_pdu_types": pdus,
    "b10_costas": scalars(costas_block, "i double, q double"),
    "b11_timing_phase": scalars(lambda z: (demod.best_phase(z, 4),), "phase int"),
    "b12_qpsk_decisions": decisions,
    "g15_evm": scalars(lambda z: (demod.evm_percent(z / np.sqrt((np.abs(z) ** 2).mean(axis=1, keepdims=True)), demod.constellation("QPSK")),), "evm_percent double", 5),
    "b16_chirp_symbols": scalars(lambda z: (demod.dechirped(z, 5).argmax(axis=1),), "symbol int"),
    "b18_frequency_offset": scalars(lambda z: (demod.frequency_offset(z, 5, FS),), "offset_hz double", 4),
}

_NORMED = f"""WITH {IQ_SQL}, m AS (SELECT frame_id, n, i - avg(i) OVER w AS i, q - avg(q) OVER w AS q FROM iq WINDOW w AS (PARTITION BY frame_id)),
e AS (SELECT frame_id, n, i / sqrt(avg(i * i + q * q) OVER w) AS i, q / sqrt(avg(i * i + q * q) OVER w) AS q FROM m WINDOW w AS (PARTITION BY frame_id)),
p AS (SELECT frame_id, i, q, i * i - q * q AS r2, 2 * i * q AS s2, i * i + q * q AS a FROM e)"""
# x^2 conj(x)^2 = a^2, x^4 = (x^2)^2, x^2 conj(x) = a x, x^4 conj(x)^2 = a^2 x^2
_STANDARD = f"""{_NORMED}, k AS (SELECT frame_id, avg(r2) AS m20r, avg(s2) AS m20i, avg(a) AS m21, avg(r2 * r2 - s2 * s2) AS m40r, avg(2 * r2 * s2) AS m40i, avg(a * a) AS m42 FROM p GROUP BY 1),
c AS (SELECT frame_id, m40r - 3 * (m20r * m20r - m20i * m20i) AS c40_re, m40i - 6 * m20r * m20i AS c40_im, m42 - (m20r * m20r + m20i * m20i) - 2 * m21 * m21 AS c42_re, 0e0 AS c42_im FROM k)"""
_REFERENCE = f"""{_NORMED}, k AS (SELECT frame_id, avg(r2) AS m20r, avg(s2) AS m20i, avg(a * i) AS m21r, avg(a * q) AS m21i, avg(r2 * r2 - s2 * s2) AS m40r, avg(2 * r2 * s2) AS m40i, avg(a * a * r2) AS m42r, avg(a * a * s2) AS m42i FROM p GROUP BY 1),
c AS (SELECT frame_id, m40r - 3 * (m20r * m20r - m20i * m20i) AS c40_re, m40i - 6 * m20r * m20i AS c40_im, m42r - (m20r * m20r + m20i * m20i) - 2 * (m21r * m21r - m21i * m21i) AS c42_re, m42i - 4 * m21r * m21i AS c42_im FROM k)"""
_R7 = "frame_id, " + ", ".join(f"round({c}, 7) + 0 AS {c}" for c in ("c40_re", "c40_im", "c42_re", "c42_im"))
_KURT = f"WITH {IQ_SQL}, k AS (SELECT frame_id, avg(pow(i * i + q * q, 2)) / pow(avg(i * i + q * q), 2) AS kurtosis FROM iq GROUP BY 1)"


def _rows(values: dict) -> str:
    return ", ".join(f"({n}, '{k}', {', '.join(f'{float(x)!r}' for x in (v if isinstance(v, tuple) else (v,)))})" for n, (k, v) in enumerate(values.items()))


ORACLES = {
    "f21_cyclic_slice": f"""WITH {IQ_SQL}, z AS (SELECT frame_id, n // 16 AS s, n % 16 AS m, i, q, i * cos(a) + q * sin(a) AS yi, q * cos(a) - i * sin(a) AS yq FROM (SELECT *, pi() * 2000 * n / 32e3 AS a FROM iq)),
x AS (SELECT frame_id, s, CAST(b AS INT) AS bin, sum(i * cos(t) + q * sin(t)) AS re, sum(q * cos(t) - i * sin(t)) AS im, sum(yi * cos(t) + yq * sin(t)) AS yre, sum(yq * cos(t) - yi * sin(t)) AS yim FROM (SELECT *, pi() * m * (b - 8) / 8 AS t FROM z, unnest(generate_series(0, 15)) v(b)) GROUP BY ALL)
SELECT frame_id, bin, round(avg(re * yre + im * yim), 8) + 0 AS re, round(avg(im * yre - re * yim), 8) + 0 AS im FROM x GROUP BY 1, 2""",
    "m19_classification": f"""{_STANDARD}, t(k, modulation, a, b) AS (VALUES {_rows(forensics.CUMULANTS)}), d AS (SELECT frame_id, modulation, k, sqrt(pow(c40_re - a, 2) + pow(c40_im, 2) + pow(c42_re - b, 2)) AS d FROM c, t)
SELECT frame_id, modulation, round(least(1, greatest(0.1, 0.6e0 * CASE WHEN d < 1e-3 THEN 1 ELSE 1 / (1 + d) END)), 6) AS confidence FROM d QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(d, 12), k) = 1""",
    "b09_constellations": f"""WITH {IQ_SQL}, points AS (SELECT 'BPSK' AS modulation, CAST(k AS INT) AS k, CASE k WHEN 0 THEN 1e0 ELSE -1e0 END AS re, 0e0 AS im FROM unnest([0, 1]) u(k) UNION ALL SELECT 'QPSK', CAST(k AS INT), round(cos(pi() * k / 2 + pi() / 4), 15), round(sin(pi() * k / 2 + pi() / 4), 15) FROM unnest(generate_series(0, 3)) u(k) UNION ALL SELECT '8PSK', CAST(k AS INT), round(cos(pi() * k / 4), 15), round(sin(pi() * k / 4), 15) FROM unnest(generate_series(0, 7)) u(k)),
d AS (SELECT frame_id, n, modulation, min(struct_pack(e := pow(i - re, 2) + pow(q - im, 2), k := k)) AS m FROM iq, points GROUP BY 1, 2, 3)
SELECT frame_id, modulation, m.k AS k, count(*) AS n, round(sum(m.e), 6) AS error FROM d GROUP BY 1, 2, 3""",
    "g14_constellation_stats": f"WITH {IQ_SQL}, m AS (SELECT frame_id, avg(i * i + q * q) AS p, avg(i) AS mi, avg(q) AS mq FROM iq GROUP BY 1), s AS (SELECT frame_id, p, avg(pow(i - mi, 2) + pow(q - mq, 2)) AS e FROM iq JOIN m USING (frame_id) GROUP BY 1, 2) SELECT frame_id, round(10 * log10(p + 1e-10), 6) AS power_db, round(100 * sqrt(e / p), 6) AS evm_percent, round(greatest(0, least(60, 10 * log10(p / (e + 1e-10)))), 6) AS snr_db FROM s",
    "g02_cumulants_reference": f"{_REFERENCE} SELECT {_R7} FROM c",
    "g02_cumulants_standard": f"{_STANDARD} SELECT {_R7} FROM c",
    "g03_kurtosis": f"{_KURT} SELECT frame_id, round(kurtosis, 7) AS kurtosis FROM k",
    "j06_nearest_modulation": f"""{_STANDARD}, t(k, modulation, a, b) AS (VALUES {_rows(forensics.CUMULANTS)}), d AS (SELECT frame_id, modulation, k, sqrt(pow(c40_re - a, 2) + pow(c40_im, 2) + pow(c42_re - b, 2)) AS d FROM c, t)
SELECT frame_id, modulation, round(d, 6) AS distance, round(CASE WHEN d < 1e-3 THEN 1 ELSE 1 / (1 + d) END, 6) AS confidence FROM d QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(d, 12), k) = 1""",
    "j07_nearest_kurtosis": f"{_KURT}, t(n, modulation, v) AS (VALUES {_rows(forensics.KURTOSIS)}) SELECT frame_id, round(kurtosis, 7) AS kurtosis, modulation FROM k, t QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY abs(kurtosis - v), n) = 1",
    "f25_gardner_error": f"WITH {IQ_SQL} SELECT a.frame_id, round(avg((a.i - b.i) * m.i + (a.q - b.q) * m.q), 9) AS error FROM iq a JOIN iq b ON b.frame_id = a.frame_id AND b.n = a.n - 4 JOIN iq m ON m.frame_id = a.frame_id AND m.n = a.n - 2 WHERE a.n % 4 = 0 GROUP BY 1",
    "f25_mueller_error": f"WITH {IQ_SQL} SELECT a.frame_id, round(avg(sign(a.i) * b.i - sign(b.i) * a.i), 9) AS error FROM iq a JOIN iq b ON b.frame_id = a.frame_id AND b.n = a.n - 4 WHERE a.n % 4 = 0 GROUP BY 1",
    "f18_spectral_correlation": f"""WITH {IQ_SQL}, seg AS (SELECT frame_id, s, n - s * 8 AS m, i, q FROM iq, unnest([0, 1, 2]) u(s) WHERE n - s * 8 BETWEEN 0 AND 15),
x AS (SELECT frame_id, s, CAST(b AS INT) AS bin, sum(i * cos(pi() * m * (b - 8) / 8) + q * sin(pi() * m * (b - 8) / 8)) AS re, sum(q * cos(pi() * m * (b - 8) / 8) - i * sin(pi() * m * (b - 8) / 8)) AS im FROM seg, unnest(generate_series(0, 15)) v(b) GROUP BY ALL)
SELECT a.frame_id, a.bin, round(avg(a.re * b.re + a.im * b.im), 8) + 0 AS re, round(avg(a.im * b.re - a.re * b.im), 8) + 0 AS im FROM x a JOIN x b ON b.frame_id = a.frame_id AND b.s = a.s AND b.bin = (a.bin + 14) % 16 GROUP BY 1, 2""",
    "b01_discriminator": f"WITH {IQ_SQL} SELECT b.frame_id, b.n, round(atan2(a.q * b.i - a.i * b.q, a.i * b.i + a.q * b.q) / (2 * pi() * 4000 / 32e3), 7) AS v FROM iq a JOIN iq b ON b.frame_id = a.frame_id AND b.n = a.n - 1",
    "b03_sliced_bits": f"WITH {IQ_SQL} SELECT frame_id, CAST(sum(CASE WHEN i > 0 THEN 1 << (7 - n // 4) ELSE 0 END) AS INT) AS bits FROM iq WHERE n % 4 = 2 GROUP BY 1",
    "b06_crc24": f"""SELECT item_id, CAST(list_reduce(list_prepend({demod.CRC24_START}, flatten(list_transform(generate_series(1, strlen(text)), lambda p: list_transform(generate_series(0, 7), lambda k: (CAST('0x' || substr(hex(encode(text)), 2 * p - 1, 2) AS BIGINT) >> k) & 1)))),
  lambda s, b: CASE WHEN xor(s, b) & 1 = 1 THEN xor(s >> 1, {demod.CRC24_TAPS}) ELSE s >> 1 END) AS BIGINT) AS crc, hex(encode(text)) AS hex FROM benchmark""",
    "b08_pdu_types": "SELECT CASE event_id % 4096 & 15 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in demod.PDU_TYPES.items()) + " ELSE printf('UNKNOWN_%02X', event_id % 4096 & 15) END AS pdu, count(*) AS n FROM events GROUP BY 1",
    "b11_timing_phase": f"WITH {IQ_SQL}, p AS (SELECT frame_id, n % 4 AS phase, sum(i * i + q * q) AS e FROM iq GROUP BY 1, 2) SELECT frame_id, CAST(arg_max(phase, e) AS INT) AS phase FROM p GROUP BY 1",
    "b12_qpsk_decisions": f"WITH {IQ_SQL} SELECT frame_id, n, CASE WHEN i >= 0 THEN CASE WHEN q >= 0 THEN 0 ELSE 3 END ELSE CASE WHEN q >= 0 THEN 1 ELSE 2 END END AS symbol FROM iq",
    "g15_evm": f"""WITH {IQ_SQL}, e AS (SELECT frame_id, i / sqrt(avg(i * i + q * q) OVER w) AS i, q / sqrt(avg(i * i + q * q) OVER w) AS q FROM iq WINDOW w AS (PARTITION BY frame_id))
SELECT frame_id, round(100 * sqrt(avg(pow(i - sign(i) * sqrt(0.5), 2) + pow(q - sign(q) * sqrt(0.5), 2))), 5) AS evm_percent FROM e GROUP BY 1""",
    "b16_chirp_symbols": f"""WITH {IQ_SQL}, d AS (SELECT frame_id, n, i * cos(a) + q * sin(a) AS i, q * cos(a) - i * sin(a) AS q FROM (SELECT *, 2 * pi() * (n * n / 64 - n / 2) AS a FROM iq)),
s AS (SELECT frame_id, b, pow(sum(i * cos(pi() * n * b / 16) + q * sin(pi() * n * b / 16)), 2) + pow(sum(q * cos(pi() * n * b / 16) - i * sin(pi() * n * b / 16)), 2) AS p FROM d, unnest(generate_series(0, 31)) u(b) GROUP BY 1, 2)
SELECT frame_id, CAST(arg_max(b, p) AS INT) AS symbol FROM s GROUP BY 1""",
}


def _costas_constants(bandwidth: float = 0.01, damping: float = 0.707) -> tuple[float, float]:
    theta = bandwidth / (damping + 1 / (4 * damping))
    d = 1 + 2 * damping * theta + theta**2
    return 4 * damping * theta / d, 4 * theta**2 / d


_A, _B = _costas_constants()
_DFT32 = "dft AS (SELECT frame_id, k, sum(i * cos(pi() * n * k / 16) + q * sin(pi() * n * k / 16)) AS re, sum(q * cos(pi() * n * k / 16) - i * sin(pi() * n * k / 16)) AS im FROM iq, unnest(generate_series(0, 31)) u(k) GROUP BY 1, 2)"


def _line_sql(name: str, source: str, allowed: str) -> str:
    """Frequency and snr of the largest allowed line of a 32-point spectrum of ``source`` (frame_id, n, a, b)."""
    return f"""{name}_spec AS (SELECT frame_id, k, CASE WHEN k < 16 THEN k ELSE k - 32 END * 1e3 AS f, sqrt(pow(sum(a * cos(pi() * n * k / 16) + b * sin(pi() * n * k / 16)), 2) + pow(sum(b * cos(pi() * n * k / 16) - a * sin(pi() * n * k / 16)), 2)) AS m
  FROM {source}, unnest(generate_series(0, 31)) u(k) GROUP BY 1, 2),
{name} AS (SELECT frame_id, abs(arg_max(f, m)) AS f, 10 * log10(max(m) / (median(m) + 1e-12)) AS snr FROM {name}_spec WHERE {allowed} GROUP BY 1)"""


_SQUARED = "squared AS (SELECT frame_id, n, i * i + q * q - avg(i * i + q * q) OVER (PARTITION BY frame_id) AS a, 0e0 AS b FROM iq)"
_RATE2 = _SQUARED + ", " + _line_sql("r2", "squared", "f >= 1e3")
_RATE4 = "fourth AS (SELECT frame_id, n, pow(i * i - q * q, 2) - pow(2 * i * q, 2) AS a, 4 * i * q * (i * i - q * q) AS b FROM iq), " + _line_sql("r4", "fourth", "abs(f) BETWEEN 4e3 AND 12e3")

ORACLES |= {
    "b10_costas": f"""WITH RECURSIVE {IQ_SQL}, y(frame_id, n, phase, freq, re, im) AS (SELECT frame_id, -1, 0e0, 0e0, 0e0, 0e0 FROM iq WHERE n = 0
UNION ALL SELECT frame_id, n, phase + freq + {_B!r} * e + {_A!r} * e + pi() - 2 * pi() * floor((phase + freq + {_B!r} * e + {_A!r} * e + pi()) / (2 * pi())) - pi(), freq + {_B!r} * e, re, im
  FROM (SELECT *, sign(re) * im - sign(im) * re AS e FROM (SELECT y.frame_id, iq.n, phase, freq, iq.i * cos(phase) + iq.q * sin(phase) AS re, iq.q * cos(phase) - iq.i * sin(phase) AS im FROM y JOIN iq ON iq.frame_id = y.frame_id AND iq.n = y.n + 1)))
SELECT frame_id, round(re, 7) AS i, round(im, 7) AS q FROM y WHERE n = 31""",
    "b18_frequency_offset": f"""WITH {IQ_SQL}, d AS (SELECT frame_id, n, i * cos(a) + q * sin(a) AS i, q * cos(a) - i * sin(a) AS q FROM (SELECT *, 2 * pi() * (n * n / 64 - n / 2) AS a FROM iq)),
s AS (SELECT frame_id, k, pow(sum(i * cos(pi() * n * k / 64) + q * sin(pi() * n * k / 64)), 2) + pow(sum(q * cos(pi() * n * k / 64) - i * sin(pi() * n * k / 64)), 2) AS p FROM d, unnest(generate_series(0, 127)) u(k) GROUP BY 1, 2)
SELECT frame_id, CASE WHEN k < 64 THEN k ELSE k - 128 END * 250e0 AS offset_hz FROM (SELECT frame_id, arg_max(k, p) AS k FROM s GROUP BY 1)""",
    "f22_symbol_rates": f"""WITH {IQ_SQL}, {_RATE2}, {_RATE4},
c AS (SELECT frame_id, r2.f AS a, r4.f / 4 AS b, r2.snr AS sa, r4.snr AS sb, greatest(0, least(1, (r2.snr - 3) / 20)) AS wa, greatest(0, least(1, (r4.snr - 3) / 20)) AS wb FROM r2 JOIN r4 USING (frame_id))
SELECT frame_id, round(a, 5) AS rate2_hz, round(sa, 5) AS snr2_db, round(b, 5) AS rate4_hz, round(sb, 5) AS snr4_db, round(CASE WHEN wa + wb > 0 THEN (a * wa + b * wb) / (wa + wb) ELSE 0 END, 5) AS rate_hz,
  round(CASE WHEN wa + wb > 0 THEN (wa + wb) / 2 * (1 - least(1, pow((a - b) / 2, 2) / pow((a + b) / 2, 2))) ELSE 0 END, 5) AS confidence FROM c""",
    "f19_cyclic_features": f"""WITH {IQ_SQL}, seg AS (SELECT frame_id, s, n - s * 4 AS m, i * 0.5 * (1 - cos(2 * pi() * (n - s * 4) / 15)) AS i, q * 0.5 * (1 - cos(2 * pi() * (n - s * 4) / 15)) AS q FROM iq, unnest(generate_series(0, 4)) u(s) WHERE n - s * 4 BETWEEN 0 AND 15),
x AS (SELECT frame_id, s, b, sum(i * cos(pi() * m * (b - 8) / 8) + q * sin(pi() * m * (b - 8) / 8)) AS re, sum(q * cos(pi() * m * (b - 8) / 8) - i * sin(pi() * m * (b - 8) / 8)) AS im FROM seg, unnest(generate_series(0, 15)) v(b) GROUP BY ALL),
scd AS (SELECT x.frame_id, a, x.b, avg(x.re * y.re + x.im * y.im) AS re, avg(x.im * y.re - x.re * y.im) AS im FROM x, unnest(generate_series(-4, 4)) w(a) JOIN x y ON y.frame_id = x.frame_id AND y.s = x.s AND y.b = (x.b - a + 16) % 16 GROUP BY ALL),
z AS (SELECT *, sqrt(re * re + im * im) AS m, 20 * log10(sqrt(re * re + im * im) + 1e-12) AS level FROM scd), floors AS (SELECT frame_id, median(level) AS floor FROM z GROUP BY 1),
top AS (SELECT c.frame_id, c.a, c.b, c.re, c.im, c.m, c.level FROM z c JOIN z o ON o.frame_id = c.frame_id AND abs(o.a - c.a) <= 2 AND abs(o.b - c.b) <= 2 GROUP BY ALL HAVING c.level >= max(o.level))
SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY round(m, 9) DESC, a, b) - 1 AS INT) AS place, a * 2e3 AS cyclic_hz, (b - 8) * 2e3 AS spectral_hz, round(m, 6) AS magnitude, round(atan2(im, re), 6) AS phase, round(level - floor, 6) AS snr_db
FROM top JOIN floors USING (frame_id) WHERE level > floor + 6 AND a <> 0""",
    "m01_feature_vectors": f"""{_REFERENCE}, {_DFT32}, psd AS (SELECT frame_id, k, (re * re + im * im) / 32 AS p FROM dft),
shape AS (SELECT frame_id, exp(avg(ln(p + 1e-12))) / (avg(p) + 1e-12) AS flat, sum(p * k / 32) / (sum(p) + 1e-12) AS centre, sum(p) + 1e-12 AS total FROM psd GROUP BY 1),
spread AS (SELECT frame_id, sqrt(sum(p * pow(k / 32 - centre, 2)) / any_value(total)) AS spread FROM psd JOIN shape USING (frame_id) GROUP BY 1),
energy AS (SELECT frame_id, count(*) FILTER (e > 0.5 * mean) / 32 AS duty, avg(e * e) / (pow(any_value(mean), 2) + 1e-30) AS kurtosis FROM (SELECT frame_id, i * i + q * q AS e, avg(i * i + q * q) OVER (PARTITION BY frame_id) AS mean FROM iq) GROUP BY 1),
{_RATE2}, f AS (SELECT frame_id, [flat, centre, spread, 1e0, duty, 0e0, c40_re, c40_im, c42_re, c42_im, r2.f / 32e3, kurtosis] AS x FROM c JOIN shape USING (frame_id) JOIN spread USING (frame_id) JOIN energy USING (frame_id) JOIN r2 USING (frame_id))
SELECT frame_id, CAST(p - 1 AS INT) AS place, round(x[p], 6) + 0 AS v FROM f, unnest(generate_series(1, 12)) u(p)""",
    "b04_address_search": f"""WITH bytes AS (SELECT item_id, p, CAST('0x' || substr(hex(encode(text)), 2 * p + 1, 2) AS INT) AS b FROM benchmark, unnest(generate_series(0, strlen(text) - 1)) u(p)),
bits AS (SELECT item_id, list((b >> k) & 1 ORDER BY p, k) AS bits FROM bytes, unnest(generate_series(0, 7)) v(k) GROUP BY 1)
SELECT item_id, CAST(a AS INT) AS at FROM bits, unnest(generate_series(0, len(bits) - 33)) w(a) WHERE list_sum(list_transform(generate_series(0, 31), lambda j: CASE WHEN bits[a + j + 1] = ({0x8E89BED6} >> j) & 1 THEN 1 ELSE 0 END)) >= 23""",
}
