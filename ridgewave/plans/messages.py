"""Queries of messages, synthetic captures and replays of stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as msg
from ..operators.cfar import Cfar
from ..operators.peaks import Peaks, detect
from ..sources import captures
from ..sources.tables import BINS_SQL, DETECTIONS_SQL, IQ_SQL, RATE, detections, iq_frames, micros, psd_frames, table
from ..streaming import state


def _db_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return psd_frames(spark, sf_dir).select("frame_id", "label", F.transform("psd", lambda x: 10 * F.log10(x + 1e-12)).alias("db"))


def spectrum_round_trip(version: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = _db_frames(spark, sf_dir).withColumns({"t": F.col("frame_id") / 8, "c": F.lit(2437e6), "s": F.lit(2e7)})
        sent = msg.encode_spectra(f, "t", "c", "s", "db", version=version).withColumn("size", F.length("message"))
        back = msg.decode_spectra(sent, keep=("frame_id", "size"), version=version)
        return back.select("frame_id", F.col("size").cast("long").alias("size"), "time", F.round("center_freq_hz", 0).alias("center_freq_hz"), "span_hz", F.aggregate("levels", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))

    return query


def _spectrum_sql(size: int) -> str:
    return f"WITH {BINS_SQL}, x AS (SELECT frame_id, CAST(floor(greatest(0, least(255, (10 * log10(p + 1e-12) + 120) / 100 * 255))) AS BIGINT) AS level FROM bins) SELECT frame_id, CAST({size} AS BIGINT) AS size, frame_id / 8 AS time, 2437e6 AS center_freq_hz, 2e7 AS span_hz, CAST(sum(level) AS BIGINT) AS total FROM x GROUP BY 1"


def iq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = iq_frames(spark, sf_dir).select("frame_id", F.posexplode(msg.decimated_pairs(F.col("i"), F.col("q"), 8)).alias("n", "x"))
    return p.select("frame_id", "n", F.round("x.i", 6).alias("i"), F.round("x.q", 6).alias("q"))


def detection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    text = msg.detection_json(F.col("detection_id"))
    got = F.from_json(text, "type string, timestamp bigint, data struct<detection_id: bigint, center_freq_hz: bigint, bandwidth_hz: bigint, bandwidth_3db_hz: bigint, peak_power_db: double, snr_db: double, modulation_type: string, duty_cycle: double, cluster_id: bigint>")
    # a generator in between, so that the text is parsed once and not for each field
    return d.select(F.explode(F.array(got)).alias("e")).select("e.type", "e.timestamp", "e.data.*")


def raw_decode(kind: str):
    """The vectors as bytes of a raw format, decoded again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.encode("text", "utf-8").alias("content"))
        out = captures.decode(text, kind, keep=("id",), block=100_000)
        return out.select("id", F.posexplode(F.arrays_zip("i", "q")).alias("n", "x")).select("id", "n", F.col("x.i").alias("i"), F.col("x.q").alias("q"))

    return query


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks over the frames of each label, ten frames a second."""
    d = detect(psd_frames(spark, sf_dir), Cfar(8, 2, 1e-2), Peaks(RATE, 1000.0), keep=("label", "frame_id"))
    frames = d.groupBy("label", "frame_id").agg(F.array_sort(F.collect_list("center_freq_hz")).alias("hz")).select("label", (F.col("frame_id") / 10).alias("t"), "hz")
    return state.replay(frames, "label", state.track_step(2000.0, 3.0), state.TRACK_OUT)


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (micros("ts") / 1e6).alias("t"), F.col("value").alias("fill"))
    r = state.replay(e, "user_id", state.throttle_step(), "t double, fill double, throttled boolean")
    return r.groupBy("user_id").agg(F.count_if("throttled").alias("n_throttled"), F.count(F.lit(1)).alias("n"))


def alerted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", (micros("ts") / 1e6).alias("t"), "event_id")
    return state.replay(e, "user_id", state.alert_step(7 * 86400.0), "t double, event_id long").select("user_id", "event_id")


def sigmf_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the JSON properties of events."""
    e = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"))


QUERIES = {
    "k08_spectrum_message_v1": spectrum_round_trip(1),
    "k09_spectrum_message_v2": spectrum_round_trip(2),
    "k12_iq_pairs": iq_pairs,
    "k13_detection_json": detection_events,
    "k16_stats_json": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e")).select("user_id", F.get_json_object(msg.stats_json(F.col("n") - F.col("e"), F.col("e")), "$.dropRate").cast("double").alias("drop_rate")),
    "k20_camel_case": lambda s, d: msg.camel_case(detections(s, d).select("detection_id", "track_id", "frames_seen")),
    "s08_decode_u8": raw_decode("u8"),
    "s03_decode_ci16": raw_decode("ci16"),
    "s04_decode_ci8": raw_decode("ci8"),
    "s10_decode_u16": raw_decode("u16"),
    "s11_guess_format": lambda s, d: table(s, d, "benchmark").select("item_id", captures.guess_format(F.encode("text", "utf-8")).alias("format")),
    "s12_json_meta": sigmf_meta,
    "s15_synthetic": lambda s, d: captures.synthetic(s, table(s, d, "supplier").select(F.col("s_suppkey").alias("seq")), 64, 1e7, noise_db=-400.0).select("seq", F.posexplode("i").alias("n", "i")).select("seq", "n", F.round("i", 6).alias("i")),
    "s20_safe_names": lambda s, d: table(s, d, "customer").select("c_custkey", msg.safe_file_name(F.concat("c_name", F.lit(" /"), "c_mktsegment")).alias("name")),
    "t02_throttle": throttled,
    "t04_tracks": tracks,
    "t08_alert_cooldown": alerted,
}
_BYTES = "b AS (SELECT item_id AS id, hex(encode(text)) AS h FROM benchmark)"


def _byte(at: str) -> str:
    return f"CAST('0x' || substr(h, 2 * ({at}) + 1, 2) AS INT)"


ORACLES = {
    "k08_spectrum_message_v1": _spectrum_sql(20 + 64).replace("2437e6", "round(CAST(CAST(2437e6 AS FLOAT) AS DOUBLE))"),
    "k09_spectrum_message_v2": _spectrum_sql(28 + 64),
    "k12_iq_pairs": f"WITH {IQ_SQL} SELECT frame_id, CAST(n // 4 AS INT) AS n, round(i, 6) AS i, round(q, 6) AS q FROM iq WHERE n % 4 = 0",
    "k13_detection_json": f"WITH {DETECTIONS_SQL} SELECT 'detection' AS type, detection_id AS timestamp, detection_id, CAST(trunc(center_freq_hz) AS BIGINT) AS center_freq_hz, CAST(trunc(bandwidth_hz) AS BIGINT) AS bandwidth_hz, CAST(trunc(bandwidth_3db_hz) AS BIGINT) AS bandwidth_3db_hz, round(peak_power_db, 2) AS peak_power_db, round(snr_db, 2) AS snr_db, modulation_type, round(duty_cycle, 3) AS duty_cycle, cluster_id FROM detections",
    "k16_stats_json": "SELECT user_id, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS drop_rate FROM events GROUP BY 1",
    "k20_camel_case": f'WITH {DETECTIONS_SQL} SELECT detection_id AS "detectionId", track_id AS "trackId", frames_seen AS "framesSeen" FROM detections',
    "s08_decode_u8": f"WITH {_BYTES} SELECT id, CAST(n AS INT) AS n, CAST({_byte('2 * n')} - 128 AS DOUBLE) AS i, CAST({_byte('2 * n + 1')} - 128 AS DOUBLE) AS q FROM b, unnest(generate_series(0, length(h) // 4 - 1)) u(n)",
    "s04_decode_ci8": f"WITH {_BYTES} SELECT id, CAST(n AS INT) AS n, CAST({_byte('2 * n')} - CASE WHEN {_byte('2 * n')} > 127 THEN 256 ELSE 0 END AS DOUBLE) AS i, CAST({_byte('2 * n + 1')} - CASE WHEN {_byte('2 * n + 1')} > 127 THEN 256 ELSE 0 END AS DOUBLE) AS q FROM b, unnest(generate_series(0, length(h) // 4 - 1)) u(n)",
    "s03_decode_ci16": f"WITH {_BYTES}, x AS (SELECT id, n, {_byte('4 * n')} + 256 * {_byte('4 * n + 1')} AS i, {_byte('4 * n + 2')} + 256 * {_byte('4 * n + 3')} AS q FROM b, unnest(generate_series(0, length(h) // 8 - 1)) u(n)) SELECT id, CAST(n AS INT) AS n, CAST(i - CASE WHEN i > 32767 THEN 65536 ELSE 0 END AS DOUBLE) AS i, CAST(q - CASE WHEN q > 32767 THEN 65536 ELSE 0 END AS DOUBLE) AS q FROM x",
    "s10_decode_u16": f"WITH {_BYTES} SELECT id, CAST(n AS INT) AS n, CAST({_byte('4 * n')} + 256 * {_byte('4 * n + 1')} - 32768 AS DOUBLE) AS i, CAST({_byte('4 * n + 2')} + 256 * {_byte('4 * n + 3')} - 32768 AS DOUBLE) AS q FROM b, unnest(generate_series(0, length(h) // 8 - 1)) u(n)",
    "s11_guess_format": "SELECT item_id, CASE WHEN text LIKE 'RIFF%' THEN 'wav' WHEN strlen(text) % 8 = 0 THEN 'cf32' WHEN strlen(text) % 4 = 0 THEN 'ci16' ELSE 'u8' END AS format FROM benchmark",
    "s12_json_meta": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "s15_synthetic": "SELECT s AS seq, CAST(n AS INT) AS n, round(" + " + ".join(f"{10 ** (db / 20)!r} * cos(2 * pi() * ({hz}) * (s * 64 + n) / 1e7)" for hz, db in captures.TONES) + ", 6) AS i FROM (SELECT s_suppkey AS s FROM supplier), unnest(generate_series(0, 63)) b(n)",
    "s20_safe_names": r"SELECT c_custkey, regexp_replace(c_name || ' /' || c_mktsegment, '[^\p{L}\p{N}._-]', '_', 'g') AS name FROM customer",
    "t02_throttle": """WITH e AS (SELECT *, CASE WHEN value > 85 THEN 1 WHEN value < 50 THEN 0 END AS edge FROM events),
t AS (SELECT user_id, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM e)
SELECT user_id, count(*) FILTER (on_ = 1) AS n_throttled, count(*) AS n FROM t GROUP BY 1""",
    "t08_alert_cooldown": """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'error'),
walk AS (SELECT user_id, event_id, n, ts AS last, true AS alert FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts - w.last >= INTERVAL 7 DAY THEN e.ts ELSE w.last END, e.ts - w.last >= INTERVAL 7 DAY FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, event_id FROM walk WHERE alert""",
}
