"""Queries of receivers, messages and bursts, and replays of order-dependent normalisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as msg
from ..functions import registered
from ..functions.frames import map_frames, per_row
from ..functions.windows import window
from ..operators import demod, readout
from ..operators import receivers as op
from ..sources.tables import BINS_SQL, DETECTIONS_SQL, IQ_SQL, detections, iq_frames, micros, psd_frames, table
from ..streaming import state
from .detection import FLAGSHIP_SQL
from .signals import FS, ORACLES as _SIGNALS, _NORMED

ADDRESS = 0x8E89BED6
SF = 5


def _long(df: DataFrame, digits: int, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(F.arrays_zip("i", "q")).alias("n", "c")).select(*keep, "n", F.round("c.i", digits).alias("i"), F.round("c.q", digits).alias("q"))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen samples around one detection of each frame, 8 kHz wide."""
    f = iq_frames(spark, sf_dir).withColumns({"detection_id": F.col("frame_id") % 5, "offset_hz": (F.col("frame_id") % 5 - 2) * 2000.0, "bandwidth_hz": F.lit(8000.0)})
    return _long(op.segments(f, FS, 16), 9, "frame_id", "detection_id")


def demodulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols and bits at four samples a symbol, with the metrics of each frame."""
    d = op.demodulated(iq_frames(spark, sf_dir), "QPSK", 4)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    return d.select("frame_id", text("symbols").alias("symbols"), text("bits").alias("bits"), F.round("evm_percent", 5).alias("evm_percent"), F.round("snr_db", 5).alias("snr_db"))


def packet_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that carry the digest of each benchmark text, one in three with a wrong CRC, behind a few other bits."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.unhex(F.sha2("text", 256)).alias("payload"))

    def kernel(item, payload):
        header = item % 7 | len(payload) << 8
        crc = demod.crc24(header.to_bytes(2, "little") + payload) ^ (item % 3 == 0)
        return ([0] * (item % 9) + op.packet_bits(ADDRESS, header, payload, crc) + [1] * 5,)

    return per_row(b, kernel, ("item_id", "payload"), "bits array<tinyint>", ("item_id",))


def decoded_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = op.packets(packet_frames(spark, sf_dir))
    return p.select("item_id", "at", "access_address", "pdu", F.hex("payload").alias("payload"), "crc_valid")


def packet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets as JSON events, read back."""
    p = op.packets(packet_frames(spark, sf_dir))
    text = msg.packet_json(F.col("item_id"), F.lit(37), F.lit(2402), F.col("access_address"), F.col("pdu"), F.col("payload"), F.col("crc_valid"))
    fields = ("channel", "centerFreqHz", "accessAddress", "pduType", "payloadHex", "crcValid")
    return p.select("item_id", *(F.get_json_object(text, f"$.data.{c}").alias(c) for c in fields))


def chirp_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chirp frames whose symbols are the low five bits of each benchmark text's digest, behind some silence."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.unhex(F.md5("text")).alias("d"))

    def kernel(item, d):
        z = op.chirp_signal([x & 31 for x in d], SF, lead=item % 50)
        return z.real.tolist(), z.imag.tolist()

    return per_row(b, kernel, ("item_id", "d"), "i array<double>, q array<double>", ("item_id",))


def chirp_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.chirp_frames(chirp_blocks(spark, sf_dir), SF).select("item_id", "start", F.array_join(F.transform("symbols", lambda x: x.cast("string")), ",").alias("symbols"))


def chirp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = op.chirp_frames(chirp_blocks(spark, sf_dir), SF)
    text = msg.chirp_json(F.col("item_id"), F.lit(868e6), SF, 125e3, F.col("symbols"), F.col("snr_db"))
    return c.select("item_id", *(F.get_json_object(text, f"$.data.{f}").alias(f) for f in ("centerFreqHz", "spreadingFactor", "bandwidthHz", "codingRate", "payloadHex")))


def iq_round_trip(short: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = iq_frames(spark, sf_dir).withColumns({"t": F.col("frame_id") / 8, "c": F.lit(2.4e9), "r": F.lit(FS)})
        back = msg.decode_iq(msg.encode_iq(f, "t", "c", "r", short=short).withColumn("size", F.length("message")), keep=("frame_id", "size"), short=short)
        return _long(back, 7, "frame_id", "size", "time", "sample_rate_hz")

    return query


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events, packed and unpacked; one in ten with a wrong magic number."""
    e = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 500).alias("id")).agg(F.array_sort(F.collect_list("event_id")).alias("n"))

    def kernel(ident, n):
        data = msg.burst(1, ident, ident * 1000, ident % 2, 868_000_000, 2_000_000, ident % 64, n * 1000, (n % 200 - 100) / 128 + 1j * (n % 50) / 64)
        return (b"\0" + data[1:] if ident % 10 == 0 else data,)

    made = per_row(e, kernel, ("id", "n"), "data binary", ("id",)).drop("error")
    u = msg.unpack_bursts(made).select("id", "error", "kind", F.col("flags").bitwiseAND(F.lit(1)).alias("overflow"), F.explode_outer(F.arrays_zip("t_ns", "i", "q")).alias("x"))
    return u.select("id", "error", "kind", "overflow", F.col("x.t_ns").alias("t_ns"), F.round("x.i", 9).alias("i"), F.round("x.q", 9).alias("q"))


def spectrum_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra as JSON with their frequencies, read back bin by bin."""
    f = psd_frames(spark, sf_dir).select("frame_id", F.transform("psd", lambda x: F.round(10 * F.log10(x + 1e-12), 4)).alias("db"))
    text = msg.spectrum_json(F.col("frame_id"), F.lit(915e6), F.lit(64e3), F.col("db"))
    got = F.from_json(text, "type string, fftSize int, centerFreqHz bigint, magnitudeDb array<double>, frequencyBins array<double>")
    return f.select("frame_id", F.explode(F.array(got)).alias("g")).select("frame_id", "g.type", "g.fftSize", "g.centerFreqHz", F.posexplode(F.arrays_zip("g.magnitudeDb", "g.frequencyBins")).alias("bin", "x")).select("frame_id", "type", "fftSize", "centerFreqHz", "bin", F.col("x.magnitudeDb").alias("db"), F.col("x.frequencyBins").alias("hz"))


def exported_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as JSON lines in camelCase."""
    d = detections(spark, sf_dir).select("detection_id", "modulation_type", "cluster_id")
    return d.select("detection_id", F.to_json(F.struct(*(F.col(c).alias(msg.camel(c)) for c in d.columns))).alias("line"))


def powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iq_frames(spark, sf_dir).select("frame_id", F.posexplode(op.auto_power(F.col("i"), F.col("q"))).alias("n", "db")).select("frame_id", "n", F.round("db", 6).alias("db"))


def order_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = map_frames(iq_frames(spark, sf_dir), lambda i, q: (op.order_vector(i + 1j * q),), ["i", "q"], "x array<double>", ["frame_id"])
    return out.select("frame_id", F.posexplode("x").alias("place", "v")).select("frame_id", "place", F.round("v", 6).alias("v"))


def scd_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectral correlation at the cyclic frequency next to 4.1 kHz."""
    from ..operators.forensics import spectral_correlation

    alphas = np.arange(-4, 5) * FS / 16

    def kernel(i, q):
        return (op.nearest_slice(spectral_correlation(i + 1j * q, 16, 8, alphas, FS, np.ones(16)), alphas, 4100.0),)

    out = map_frames(iq_frames(spark, sf_dir), kernel, ["i", "q"], "m array<double>", ["frame_id"])
    return out.select("frame_id", F.posexplode("m").alias("bin", "m")).select("frame_id", "bin", F.round("m", 8).alias("magnitude"))


def scd_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol rate by the strongest cyclic feature between 2 and 8 kHz."""
    out = map_frames(iq_frames(spark, sf_dir), lambda i, q: (op.scd_rate(i + 1j * q, FS, 16, 4, 2e3, 8e3, window("hann", 16)),), ["i", "q"], "rate_hz double", ["frame_id"])
    return out.select("frame_id", "rate_hz")


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "region").select("r_regionkey", (F.col("r_regionkey") * 0.3).alias("hos"), F.lit(0.35).alias("scd"), (F.col("r_regionkey") % 2).cast("double").alias("ml"))
    return w.select("r_regionkey", *op.fusion_weights("hos", "scd", "ml")).select("r_regionkey", *(F.round(c, 9).alias(c) for c in ("hos", "scd", "ml")))


def running_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value against the running mean and deviation of its user's events before it."""
    e = table(spark, sf_dir, "events").select("user_id", (micros("ts") / 1e6).alias("t"), "event_id", F.array("value").alias("x"))
    r = state.replay(e, "user_id", state.normalize_step(), "event_id long, z array<double>")
    return r.select("event_id", F.round(F.col("z")[0], 6).alias("z"))


def backpressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (micros("ts") / 1e6).alias("t"), F.col("value").alias("fill"))
    s = readout.throttle_summary(e, "user_id", "fill", "t", "t", "event_id")
    return s.select("user_id", "activations", F.round("mean_spell_s", 3).alias("mean_spell_s"), F.round("max_fill", 6).alias("max_fill"), F.round("recovery_s", 3).alias("recovery_s"))


def benchmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.when(F.col("value") > 120, F.col("value") / 100).otherwise(0.0).alias("drop_percent"))
    b = readout.benchmark_stats(e, "drop_percent", "k")
    return b.select("k", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")), "drop_free", "status")


def drop_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples received and lost of each user's blocks by gaps in their sequence; an event's number is its block's."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return state.lost_blocks(e, "user_id", "event_id", 1024).select("user_id", "blocks", "received", "lost", F.round("drop_percent", 6).alias("drop_percent"))


def weighted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = readout.cluster_rollup(detections(spark, sf_dir)).withColumn("into", F.col("cluster_id") % 3).withColumn("x", F.col("avg_power_db")).withColumn("y", F.col("avg_bandwidth_hz"))
    return readout.merge_clusters(c, "into", centroid=("x", "y")).select("into", "size", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most recent classifications and the five highest anomalies."""
    d = detections(spark, sf_dir)
    recent = readout.last_rows(d, 8, F.desc("ts"), F.desc("detection_id")).select(F.lit("recent").alias("list"), "detection_id")
    return recent.union(readout.last_rows(d, 5, F.desc("snr_db"), "detection_id").select(F.lit("anomalies").alias("list"), "detection_id"))


def decision_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bits of each frame's decisions at one sample a symbol."""
    d = op.demodulated(iq_frames(spark, sf_dir), "QPSK", 1)
    return d.select("frame_id", F.posexplode("bits").alias("n", "bit"))


def float_bytes(spark: SparkSession, sf_dir: str, order: str) -> DataFrame:
    """Blocks of samples as raw bytes in the given order, decoded again."""
    from ..sources import captures

    def kernel(i, q):
        return (np.stack([i, q], axis=1).astype(order + "f4").tobytes(),)

    raw = per_row(iq_frames(spark, sf_dir), kernel, ("i", "q"), "content binary", ("frame_id",))
    return _long(captures.decode(raw, "cf32", keep=("frame_id",), endian="big" if order == ">" else "little"), 7, "frame_id")


def inverse_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised columns turned back."""
    from ..operators import learning

    d = detections(spark, sf_dir).select("detection_id", "snr_db", "bandwidth_hz")
    stats = learning.fitted(d, ["snr_db", "bandwidth_hz"])
    return learning.restored(learning.scaled(d, stats), stats).select("detection_id", F.round("snr_db", 6).alias("snr_db"), F.round("bandwidth_hz", 4).alias("bandwidth_hz"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered scalar functions in SQL text over the detections."""
    registered.register(spark)
    return spark.sql("SELECT detection_id, CAST(quantize_db(peak_power_db) AS INT) AS level, round(dequantize_db(quantize_db(peak_power_db)), 6) AS db, snr_severity(snr_db) AS severity, advertising_mhz(CAST(detection_id % 40 AS INT)) AS mhz, safe_file_name(concat(modulation_type, ' ', detection_id)) AS file FROM {d}", d=detections(spark, sf_dir))


def sql_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector as a table function in SQL text."""
    registered.register(spark)
    return spark.sql("SELECT frame_id, start_bin, end_bin, peak_bin, round(peak_power_db, 6) AS peak_power_db, round(snr_db, 6) AS snr_db, round(center_freq_hz, 6) AS center_freq_hz FROM {f} f, LATERAL cfar_detect(f.psd)", f=psd_frames(spark, sf_dir))


def sql_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered Arrow functions in SQL text."""
    registered.register(spark)
    return spark.sql("SELECT frame_id, round(mean_power_db(i, q), 7) AS power_db FROM {x}", x=iq_frames(spark, sf_dir))


def whole_feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen features of each frame with a detection of its own."""
    from ..operators import forensics

    f = iq_frames(spark, sf_dir).withColumns({"center_freq_hz": F.col("frame_id") * 32.0, "bandwidth_hz": F.lit(4000.0), "peak_power_db": -F.col("frame_id") / 100, "snr_db": F.lit(12.5)})
    out = forensics.feature_vectors(f, FS, 32)
    return out.select("frame_id", F.posexplode("x").alias("place", "v")).select("frame_id", "place", F.round("v", 6).alias("v"))


QUERIES = {
    "f17_segments": segmented,
    "f20_scd_symbol_rate": scd_rates,
    "f28_auto_power": powers,
    "f29_order_vectors": order_vectors,
    "f29_scd_slice": scd_slices,
    "f30_fusion_weights": fused,
    "b05_packets": decoded_packets,
    "b12_decision_bits": decision_bits,
    "s02_decode_cf32": lambda s, d: float_bytes(s, d, "<"),
    "s07_decode_cf32_big_endian": lambda s, d: float_bytes(s, d, ">"),
    "m05_inverse": inverse_scaled,
    "m01_whole_vectors": whole_feature_vectors,
    "fn_sql_scalars": sql_functions,
    "fn_sql_detect": sql_detections,
    "fn_sql_kernels": sql_kernels,
    "b13_demodulate": demodulate,
    "b17_chirp_frames": chirp_symbols,
    "b19_protocols": lambda s, d: op.described(table(s, d, "benchmark").select("item_id", F.array(*(F.lit(n) for n, _ in op.PROTOCOLS), F.lit("other"))[(F.col("item_id") % 6).cast("int")].alias("protocol")), "protocol"),
    "s17_bursts": bursts,
    "k10_iq_message_float": iq_round_trip(False),
    "k11_iq_message_short": iq_round_trip(True),
    "k15_spectrum_json": spectrum_events,
    "k17_packet_json": packet_events,
    "k17_chirp_json": chirp_events,
    "k18_detections_export": exported_detections,
    "m14_running_scores": running_scores,
    "g07_weighted_centroids": weighted_clusters,
    "g11_benchmark_stats": benchmarked,
    "g19_backpressure": backpressure,
    "p12_recent_and_anomalies": top_lists,
    "t03_drop_accounting": drop_accounting,
}

_CRC = f"""list_reduce(list_prepend({demod.CRC24_START}, flatten(list_transform(generate_series(1, len(h) // 2), lambda p: list_transform(generate_series(0, 7), lambda k: (CAST('0x' || substr(h, 2 * p - 1, 2) AS BIGINT) >> k) & 1)))), lambda s, b: CASE WHEN xor(s, b) & 1 = 1 THEN xor(s >> 1, {demod.CRC24_TAPS}) ELSE s >> 1 END)"""
_PDU = "CASE item_id % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in demod.PDU_TYPES.items()) + " END"
_SEGMENT_GAIN = "[" + ", ".join("1e0" if k < 8 or k >= 24 else "0e0" for k in range(32)) + "]"  # a quarter of 32 bins on either side; the skirt is shorter than two bins
ORACLES = {
    "f17_segments": f"""WITH {IQ_SQL}, s AS (SELECT frame_id, n, i * cos(a) + q * sin(a) AS i, q * cos(a) - i * sin(a) AS q FROM (SELECT *, 2 * pi() * (frame_id % 5 - 2) * 2e3 / 32e3 * n AS a FROM iq)),
h AS (SELECT d, sum(g * cos(pi() * k * d / 16)) / 32 AS c, sum(g * sin(pi() * k * d / 16)) / 32 AS s FROM (SELECT k, {_SEGMENT_GAIN}[k + 1] AS g FROM unnest(generate_series(0, 31)) u(k)), unnest(generate_series(-31, 31)) v(d) GROUP BY d)
SELECT frame_id, frame_id % 5 AS detection_id, CAST(m - 8 AS INT) AS n, round(sum(i * c - q * h.s), 9) + 0 AS i, round(sum(q * c + i * h.s), 9) + 0 AS q FROM s, unnest(generate_series(8, 23)) w(m) JOIN h ON d = m - n GROUP BY 1, 2, 3""",
    "f28_auto_power": f"WITH {IQ_SQL} SELECT frame_id, n, round(CASE WHEN i * i + q * q > 0 THEN 20 * log10(sqrt(i * i + q * q)) ELSE -120 END, 6) AS db FROM iq",
    "f29_order_vectors": f"""{_NORMED}, k AS (SELECT frame_id, avg(r2) AS ar, avg(s2) AS ai, avg(a) AS m21, avg(r2 * r2 - s2 * s2) AS br, avg(2 * r2 * s2) AS bi, avg(a * a) AS m42,
  avg(r2 * (r2 * r2 - s2 * s2) - s2 * 2 * r2 * s2) AS cr, avg(r2 * 2 * r2 * s2 + s2 * (r2 * r2 - s2 * s2)) AS ci, avg(r2 * i - s2 * q) AS sr, avg(r2 * q + s2 * i) AS si FROM p GROUP BY 1),
f AS (SELECT frame_id, [br - 3 * (ar * ar - ai * ai), bi - 6 * ar * ai, m42 - (ar * ar + ai * ai) - 2 * m21 * m21, 0, cr - 15 * (br * ar - bi * ai) + 30 * (ar * ar * ar - 3 * ar * ai * ai), ci - 15 * (br * ai + bi * ar) + 30 * (3 * ar * ar * ai - ai * ai * ai), m42 / (m21 * m21), sr, si] AS x FROM k)
SELECT frame_id, CAST(n - 1 AS INT) AS place, round(x[n], 6) + 0 AS v FROM f, unnest(generate_series(1, 9)) u(n)""",
    "f29_scd_slice": f"SELECT frame_id, bin, round(sqrt(re * re + im * im), 8) AS magnitude FROM ({_SIGNALS['f18_spectral_correlation'].replace('round(avg(a.re * b.re + a.im * b.im), 8) + 0', 'avg(a.re * b.re + a.im * b.im)').replace('round(avg(a.im * b.re - a.re * b.im), 8) + 0', 'avg(a.im * b.re - a.re * b.im)')})",
    "f30_fusion_weights": "SELECT r_regionkey, round(r_regionkey * 0.3e0 / t, 9) AS hos, round(0.35e0 / t, 9) AS scd, round(r_regionkey % 2 / t, 9) AS ml FROM (SELECT r_regionkey, r_regionkey * 0.3e0 + 0.35e0 + r_regionkey % 2 AS t FROM region)",
    "b12_decision_bits": f"WITH {IQ_SQL}, k AS (SELECT frame_id, n, CASE WHEN i >= 0 THEN CASE WHEN q >= 0 THEN 0 ELSE 3 END ELSE CASE WHEN q >= 0 THEN 1 ELSE 2 END END AS k FROM iq) SELECT frame_id, CAST(2 * n + j AS INT) AS n, (k >> j) & 1 AS bit FROM k, unnest([0, 1]) u(j)",
    **{name: f"WITH {IQ_SQL} SELECT frame_id, n, round(i, 7) AS i, round(q, 7) AS q FROM iq" for name in ("s02_decode_cf32", "s07_decode_cf32_big_endian")},
    "m05_inverse": f"WITH {DETECTIONS_SQL} SELECT detection_id, round(snr_db, 6) AS snr_db, round(bandwidth_hz, 4) AS bandwidth_hz FROM detections",
    "b05_packets": f"SELECT item_id, CAST(item_id % 9 AS INT) AS at, CAST({ADDRESS} AS BIGINT) AS access_address, {_PDU} AS pdu, upper(sha256(text)) AS payload, item_id % 3 <> 0 AS crc_valid FROM benchmark",
    "b13_demodulate": f"""WITH {IQ_SQL}, s AS (SELECT frame_id, n, i, q, CASE WHEN i >= 0 THEN CASE WHEN q >= 0 THEN 0 ELSE 3 END ELSE CASE WHEN q >= 0 THEN 1 ELSE 2 END END AS k, pow(i - sign(i) * sqrt(0.5), 2) + pow(q - sign(q) * sqrt(0.5), 2) AS e FROM iq WHERE n % 4 = 2)
SELECT frame_id, string_agg(CAST(k AS VARCHAR), '' ORDER BY n) AS symbols, string_agg((k & 1) || '' || (k >> 1), '' ORDER BY n) AS bits, round(100 * sqrt(avg(e)), 5) AS evm_percent, round(10 * log10(1 / (avg(e) + 1e-12)), 5) AS snr_db FROM s GROUP BY 1""",
    "b17_chirp_frames": "SELECT item_id, CAST(item_id % 50 AS INT) AS start, array_to_string(list_transform(generate_series(1, 16), lambda p: CAST('0x' || substr(md5(text), 2 * p - 1, 2) AS INT) & 31), ',') AS symbols FROM benchmark",
    "b19_protocols": "SELECT item_id, coalesce(name, 'other') AS protocol, description FROM benchmark LEFT JOIN (VALUES " + ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(op.PROTOCOLS)) + ") p(k, name, description) ON k = item_id % 6",
    "s17_bursts": f"""WITH e AS (SELECT event_id % 500 AS id, event_id AS n FROM events)
SELECT id, NULL AS error, id % 2 AS kind, id % 64 & 1 AS overflow, n * 1000 AS t_ns, round(CASE WHEN id % 2 = 0 THEN trunc((n % 200 - 100) / 128e0 * 32768) / 32768 ELSE (n % 200 - 100) / 128e0 END, 9) AS i, round((n % 50) / 64e0, 9) AS q FROM e WHERE id % 10 <> 0
UNION ALL SELECT DISTINCT id, 'magic 0x56414C00, 0x{msg.BURST_MAGIC:08X} is wanted', NULL, NULL, NULL, NULL, NULL FROM e WHERE id % 10 = 0""",
    "k10_iq_message_float": f"WITH {IQ_SQL} SELECT frame_id, CAST(20 + 32 * 8 AS INT) AS size, frame_id / 8 AS time, 32e3 AS sample_rate_hz, n, round(i, 7) AS i, round(q, 7) AS q FROM iq",
    "k11_iq_message_short": f"WITH {IQ_SQL} SELECT frame_id, CAST(24 + 32 * 4 AS INT) AS size, frame_id / 8 AS time, 32e3 AS sample_rate_hz, n, round(trunc(greatest(-32768, least(32767, i * 32767))) / 32767, 7) + 0 AS i, round(trunc(greatest(-32768, least(32767, q * 32767))) / 32767, 7) + 0 AS q FROM iq",
    "k15_spectrum_json": f"WITH {BINS_SQL} SELECT frame_id, 'spectrum' AS type, CAST(64 AS INT) AS fftSize, CAST(915000000 AS BIGINT) AS centerFreqHz, bin, round(10 * log10(p + 1e-12), 4) AS db, 915e6 - 32e3 + bin * 1e3 AS hz FROM bins",
    "k17_packet_json": f"SELECT item_id, '37' AS channel, '2402000000' AS centerFreqHz, '0x{ADDRESS:08X}' AS accessAddress, {_PDU} AS pduType, sha256(text) AS payloadHex, CASE WHEN item_id % 3 <> 0 THEN 'true' ELSE 'false' END AS crcValid FROM benchmark",
    "k17_chirp_json": "SELECT item_id, '868000000' AS centerFreqHz, '5' AS spreadingFactor, '125000' AS bandwidthHz, '4/5' AS codingRate, array_to_string(list_transform(generate_series(1, 16), lambda p: printf('%02x', CAST('0x' || substr(md5(text), 2 * p - 1, 2) AS INT) & 31)), '') AS payloadHex FROM benchmark",
    "k18_detections_export": f"""WITH {DETECTIONS_SQL} SELECT detection_id, '{{"detectionId":' || detection_id || ',"modulationType":"' || modulation_type || '","clusterId":' || cluster_id || '}}' AS line FROM detections""",
    "m14_running_scores": """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, value AS z, value AS mean, 1e-6 AS dev FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.n, (e.value - r.mean) / greatest(r.dev, 1e-6), r.mean + (e.value - r.mean) / e.n, 0.99 * r.dev + 0.01 * abs(e.value - r.mean) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, round(z, 6) AS z FROM r""",
    "g11_benchmark_stats": """WITH d AS (SELECT user_id AS k, CASE WHEN value > 120 THEN value / 100 ELSE 0 END AS d FROM events)
SELECT k, count(*) AS n, round(avg(d), 6) AS mean, round(coalesce(stddev_samp(d), 0), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max, count(*) FILTER (d < 0.1) AS drop_free, CASE WHEN avg(d) < 0.5 AND max(d) < 2 THEN 'PASS' WHEN avg(d) < 2 THEN 'MARGINAL' ELSE 'FAIL' END AS status FROM d GROUP BY k""",
    "g19_backpressure": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value AS fill, CASE WHEN value > 85 THEN 1 WHEN value < 50 THEN 0 END AS edge FROM events),
o AS (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM e),
s AS (SELECT *, on_ = 1 AND coalesce(lag(on_) OVER w, 0) = 0 AS start, on_ = 0 AND coalesce(lag(on_) OVER w, 0) = 1 AS stop FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
x AS (SELECT a.*, (SELECT min(b.t) FROM s b WHERE b.user_id = a.user_id AND b.stop AND (b.t, b.event_id) > (a.t, a.event_id)) AS ended, (SELECT min(b.t) FROM s b WHERE b.user_id = a.user_id AND b.fill < 50 AND (b.t, b.event_id) >= (a.t, a.event_id)) AS low FROM s a)
SELECT user_id, count(*) FILTER (start) AS activations, round(coalesce(avg(ended - t) FILTER (start), 0), 3) AS mean_spell_s, round(max(fill), 6) AS max_fill, round(coalesce(arg_max(coalesce(low - t, 0), struct_pack(f := fill, t := t, e := event_id)), 0), 3) AS recovery_s FROM x GROUP BY user_id""",
    "g07_weighted_centroids": f"WITH {DETECTIONS_SQL} SELECT cluster_id % 3 AS into, count(*) AS size, round(avg(peak_power_db), 6) AS x, round(avg(bandwidth_hz), 6) AS y FROM detections GROUP BY 1",
    "p12_recent_and_anomalies": f"WITH {DETECTIONS_SQL} (SELECT 'recent' AS list, detection_id FROM detections ORDER BY ts DESC, detection_id DESC LIMIT 8) UNION ALL (SELECT 'anomalies', detection_id FROM detections ORDER BY snr_db DESC, detection_id LIMIT 5)",
    "t03_drop_accounting": "SELECT user_id, count(*) AS blocks, count(*) * 1024 AS received, CAST((max(event_id) - min(event_id) + 1 - count(*)) * 1024 AS BIGINT) AS lost, round(100 * (max(event_id) - min(event_id) + 1 - count(*)) / (max(event_id) - min(event_id) + 1), 6) AS drop_percent FROM events GROUP BY 1",
}
ORACLES |= {
    "fn_sql_scalars": f"WITH {DETECTIONS_SQL}, x AS (SELECT *, CAST(floor(greatest(0, least(255, (peak_power_db + 120) / 100 * 255))) AS INT) AS level, detection_id % 40 AS c FROM detections) SELECT detection_id, level, round(level / 255.0e0 * 100 - 120, 6) AS db, CASE WHEN snr_db > 25 THEN 'high' WHEN snr_db > 15 THEN 'medium' ELSE 'low' END AS severity, CAST(CASE c WHEN 37 THEN 2402 WHEN 38 THEN 2426 WHEN 39 THEN 2480 ELSE 2404 + 2 * c + CASE WHEN c > 10 THEN 2 ELSE 0 END END AS INT) AS mhz, modulation_type || '_' || detection_id AS file FROM x",
    "fn_sql_detect": f"SELECT frame_id, start_bin, end_bin, peak_bin, peak_power_db, snr_db, center_freq_hz FROM ({FLAGSHIP_SQL})",
    "fn_sql_kernels": f"WITH {IQ_SQL} SELECT frame_id, round(10 * log10(avg(i * i + q * q) + 1e-12), 7) AS power_db FROM iq GROUP BY 1",
    "m01_whole_vectors": f"SELECT frame_id, CAST(place + 4 AS INT) AS place, v FROM ({_SIGNALS['m01_feature_vectors']}) UNION ALL SELECT vec_id, CAST(p AS INT), round(CASE p WHEN 0 THEN vec_id * 32 / 32e3 WHEN 1 THEN 0.125 WHEN 2 THEN -vec_id / 100 ELSE 12.5 END, 6) + 0 FROM embeddings, unnest(generate_series(0, 3)) u(p)",
}
_SCD = _SIGNALS["f19_cyclic_features"]
ORACLES["f20_scd_symbol_rate"] = _SCD[: _SCD.index("scd AS")] + """scd AS (SELECT x.frame_id, a, x.b, avg(x.re * y.re + x.im * y.im) AS re, avg(x.im * y.re - x.re * y.im) AS im FROM x, unnest(generate_series(1, 4)) w(a) JOIN x y ON y.frame_id = x.frame_id AND y.s = x.s AND y.b = (x.b - a + 16) % 16 GROUP BY ALL),
z AS (SELECT *, sqrt(re * re + im * im) AS m, 20 * log10(sqrt(re * re + im * im) + 1e-12) AS level FROM scd), floors AS (SELECT frame_id, median(level) AS floor FROM z GROUP BY 1),
top AS (SELECT c.frame_id, c.a, c.b, c.m, c.level FROM z c JOIN z o ON o.frame_id = c.frame_id AND abs(o.a - c.a) <= 2 AND abs(o.b - c.b) <= 2 GROUP BY ALL HAVING c.level >= max(o.level)),
best AS (SELECT frame_id, a FROM top JOIN floors USING (frame_id) WHERE level > floor + 6 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY round(m, 9) DESC, a, b) = 1)
SELECT frame_id, coalesce(a * 2e3, 0) AS rate_hz FROM floors LEFT JOIN best USING (frame_id)"""
