"""Queries of the read side over detections, events and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import readout as op
from ..operators.order import numbered
from ..sources.tables import DETECTIONS_SQL, detections, micros, table

D = f"WITH {DETECTIONS_SQL}"


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _sql6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _cols(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule for each nation: a frequency range and a level."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 4e6).alias("low_hz"), (F.col("n_nationkey") * 4e6 + 6e6).alias("high_hz"), (F.lit(-80.0) + F.col("n_regionkey") * 2).alias("level_db"))


_RULES_SQL = "rules AS (SELECT n_nationkey AS rule_id, n_name AS name, n_nationkey * 4e6 AS low_hz, n_nationkey * 4e6 + 6e6 AS high_hz, -80.0 + n_regionkey * 2 AS level_db FROM nation)"


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).select("detection_id", "center_freq_hz", "peak_power_db", "ts")
    hits = op.range_join(d, thresholds(spark, sf_dir), "center_freq_hz", "low_hz", "high_hz", 1e6)
    return hits.where("peak_power_db >= level_db").select("rule_id", "detection_id", "peak_power_db", "ts")


_VIOLATIONS_SQL = f"{D}, {_RULES_SQL}, violations AS (SELECT rule_id, detection_id, peak_power_db, ts FROM detections JOIN rules ON center_freq_hz BETWEEN low_hz AND high_hz AND peak_power_db >= level_db)"


def j02_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with a cooldown of a week for each rule."""
    return op.alerts(violations(spark, sf_dir), cooldown_s=7 * 86400.0).select("rule_id", "detection_id")


def p08_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.latest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


_ASKED = ("band2", "pcs", "gsm900", "trx0_400", "nothing", "imte", "rxlpf1200", "GSM850")


def p13_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band that each customer asks for by a name or an alias in any case, and whether it's a cellular one; none for other words."""
    asked = F.array(*map(F.lit, _ASKED))[F.pmod(F.col("c_custkey"), F.lit(len(_ASKED)))]
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, F.upper(asked)).otherwise(asked).alias("asked"))
    return op.bands_by_name(customers, "asked").select("c_custkey", "asked", "name", (F.col("category") == "cellular").alias("cellular"), "f_min_mhz")


def j10_band_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many detections lie in each band."""
    d = detections(spark, sf_dir).select((F.col("center_freq_hz") / 2.5e4).alias("mhz"))
    return op.range_join(d, op.bands(spark), "mhz", "f_min_mhz", "f_max_mhz", 100).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mhz"), 6).alias("mean_mhz"))


_BANDS_SQL = "bands(name, category, lo, hi) AS (VALUES " + ", ".join(f"('{n}', '{c}', {lo}, {hi})" for n, _, c, lo, hi in op.BANDS) + ")"


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cluster_rollup(detections(spark, sf_dir))


_CLUSTERS_SQL = f"""{D}, stats AS (SELECT cluster_id, count(*) AS size, avg(center_freq_hz) AS dominant_freq_hz, min(center_freq_hz) AS freq_min_hz, max(center_freq_hz) AS freq_max_hz,
  avg(snr_db) AS avg_snr_db, avg(peak_power_db) AS avg_power_db, avg(bandwidth_hz) AS avg_bandwidth_hz, avg(CASE WHEN bandwidth_hz > 0 THEN bandwidth_3db_hz / bandwidth_hz END) AS avg_bw_ratio,
  avg(duty_cycle) AS avg_duty_cycle, count(DISTINCT track_id) AS unique_tracks, first(detection_id ORDER BY snr_db DESC, detection_id) AS prototype_id FROM detections GROUP BY cluster_id),
modes AS (SELECT cluster_id, modulation_type AS modulation FROM detections WHERE modulation_type <> 'Unknown' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, modulation_type) = 1),
clusters AS (SELECT * FROM stats LEFT JOIN modes USING (cluster_id))"""
_HINT_SQL = """CASE WHEN d < 0.2 THEN CASE WHEN b >= 200000 THEN 'radar_pulse' ELSE 'pulsed_beacon' END
  WHEN b < 25000 THEN CASE WHEN d > 0.9 THEN 'narrowband_cw' WHEN d < 0.5 THEN 'narrowband_burst' ELSE 'narrowband_intermittent' END
  WHEN b < 200000 THEN CASE WHEN d > 0.9 THEN 'voice_fm' WHEN d >= 0.5 THEN 'digital_voice' ELSE 'medium_band_burst' END
  WHEN b < 1000000 THEN CASE WHEN d > 0.9 THEN 'wideband_digital' ELSE 'wideband_burst' END
  ELSE CASE WHEN d > 0.9 THEN 'spread_spectrum' ELSE 'frequency_hopping' END END"""


def m11_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return d.groupBy(op.signal_hint(F.col("bandwidth_hz") * F.col("cluster_id") * 4, F.col("duty_cycle")).alias("hint")).agg(F.count(F.lit(1)).alias("n"))


def m12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    return d.groupBy(op.rule_class(F.col("bandwidth_hz"), F.col("snr_db"), 4e5).alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def g08_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumn("anomaly_score", F.col("snr_db") / 30).withColumn("modulation_type", F.when(F.col("modulation_type") == "NO", "Unknown").otherwise(F.col("modulation_type")))
    s = op.classification_summary(d)
    return s.select("total", "classified", "unclassified", "anomalous", "confident", *r6("mean_confidence", "rate_percent"))


def g09_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = op.meter(table(spark, sf_dir, "events"), "value", "user_id", "ts", "event_id")
    return m.select("event_id", *r6("running_min", "running_max"), F.round("recent_mean", 9).alias("recent_mean"))


def g11_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    out = None
    for p in (50, 95, 99):
        got = op.index_percentile(d, "snr_db", p, "cluster_id").withColumn(f"p{p}", F.round(f"p{p}", 6))
        out = got if out is None else out.join(got, "cluster_id")
    return out


def g12_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overflow rate and drop percentage in windows of ten minutes; errors count as overflows."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count_if(F.col("event_type") == "error").alias("n_over"), F.count(F.lit(1)).alias("n"))
    return per.select(F.floor(micros("w.start") / 1000000).alias("start_s"), F.round(F.col("n_over") / 600, 6).alias("overflow_rate"), F.round(100 * F.col("n_over") / F.col("n"), 6).alias("drop_percent"))


def g23_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    h = op.health(F.col("cluster_id") / 6, F.col("snr_db") / 20, F.col("duty_cycle") * 100, F.col("bandwidth_hz") / 600)
    return d.select(h.alias("h")).groupBy("h.status", F.array_join("h.warnings", ",").alias("warnings")).agg(F.count(F.lit(1)).alias("n"))


def p11_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user in the last minutes, in order of time."""
    e = table(spark, sf_dir, "events")
    end = e.agg(F.max("ts").alias("end_ts"))
    recent = e.join(F.broadcast(end), F.col("ts") >= F.col("end_ts") - F.expr("INTERVAL 600 MINUTES"))  # one row
    return recent.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), micros(F.min("ts")).alias("first_us"))


def p12_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).groupBy("modulation_type").agg(F.count(F.lit(1)).alias("n"))
    return op.last_rows(d, 6, F.desc("n"), "modulation_type")


def p09_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = violations(spark, sf_dir).join(thresholds(spark, sf_dir).select("rule_id", "name", "low_hz"), "rule_id")
    mhz = F.format_string("%.2f", F.col("low_hz") / 1e6)
    return op.search(v.withColumn("mhz", mhz), "1", ["name", "mhz"]).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def p10_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_retailprice") * 1e5).alias("freq_hz"), F.array("p_brand", "p_type").alias("tags"))
    return op.search(p.where(F.col("freq_hz").between(9.5e7, 1.3e8)), "brand#1", ["name"], "tags").select("id")


def g19_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under throttling, activations and the largest fill of each user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("fill"))
    on = op.throttled(e, "user_id", "fill", "ts", "event_id")
    return on.groupBy("user_id").agg(F.sum("throttled").alias("n_throttled"), F.sum("start").alias("activations"), F.round(F.max("fill"), 6).alias("max_fill"))


def b11_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept by a rate limit: the first one of each user in each bucket of 30 minutes."""
    e = table(spark, sf_dir, "events")
    bucket = F.floor(micros("ts") / 1800000000)
    return e.groupBy("user_id", bucket.alias("bucket")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations as quoted CSV lines with fixed decimals."""
    v = violations(spark, sf_dir).join(thresholds(spark, sf_dir).select("rule_id", "name", "level_db"), "rule_id")
    cells = [F.col("name"), F.format_string("%.2f", "peak_power_db"), F.format_string("%.2f", "level_db"), F.format_string("%.2f", F.col("peak_power_db") - F.col("level_db"))]
    return v.select("detection_id", "rule_id", F.concat_ws(",", *(F.concat(F.lit('"'), c, F.lit('"')) for c in cells)).alias("line"))


def cluster_messages(spark: SparkSession, sf_dir: str, page: int = 1000) -> DataFrame:
    """All clusters as messages of at most ``page`` clusters, read back."""
    c = clusters(spark, sf_dir).select("cluster_id", "size", F.round("avg_snr_db", 2).alias("avg_snr_db"))
    placed = numbered(c.withColumn("key", F.lit(0)), "key", "cluster_id").withColumn("page", F.floor(F.col("place") / page))
    text = F.to_json(F.struct(F.lit("clusters").alias("type"), F.array_sort(F.collect_list(F.struct("cluster_id", "size", "avg_snr_db"))).alias("data")))
    back = F.from_json("m", "type string, data array<struct<cluster_id: bigint, size: bigint, avg_snr_db: double>>")
    read = placed.groupBy("page").agg(text.alias("m")).select("page", F.explode(F.array(back)).alias("b"))
    return read.select("page", "b.type", F.posexplode("b.data").alias("n", "d")).select("type", (F.col("page") * page + F.col("n")).cast("int").alias("place"), "d.*")


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to detections by their key."""
    d = detections(spark, sf_dir).select("detection_id", "snr_db")
    labels = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 10 + 1).alias("detection_id"), F.col("o_orderpriority").alias("label"))
    return d.join(labels, "detection_id").select("detection_id", "label", *r6("snr_db"))


QUERIES = {
    "k19_violation_lines": exported,
    "k14_cluster_message": cluster_messages,
    "j09_labels": zipped,
    "p15_recent": lambda s, d: op.last_rows(table(s, d, "events"), 100, F.desc("event_id")).select("event_id", "event_type"),
    "g17_feature_stats": lambda s, d: detections(s, d).agg(*(F.round(f(c), 6).alias(f"{n}_{c}") for c in ("snr_db", "bandwidth_hz") for n, f in (("mean", F.avg), ("std", F.stddev_pop)))),
    "k17_channels": lambda s, d: table(s, d, "events").select((F.col("event_id") % 40).cast("int").alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("n")).withColumn("freq_mhz", op.advertising_mhz(F.col("channel"))),
    "p01_detection_page": lambda s, d: op.page(detections(s, d), 10.0, 20, 100).select("detection_id", *r6("snr_db")),
    "p02_lookup": lambda s, d: detections(s, d).where("detection_id = 71").select("detection_id", *r6("center_freq_hz")),
    "p03_last_detections": lambda s, d: op.last_rows(detections(s, d), 1000, F.desc("detection_id")).select("detection_id"),
    "p05_dashboard_filter": lambda s, d: op.dashboard_filter(detections(s, d), 12.0, (2e7, 4e7), ["AF", "RF"], F.lit("1998-01-01").cast("timestamp_ntz"), 86400.0 * 3000).select("detection_id", "modulation_type"),
    "p06_sorted": lambda s, d: op.last_rows(detections(s, d), 50, F.desc("snr_db"), F.desc("peak_power_db"), "detection_id").select("detection_id", *r6("snr_db")),
    "p07_clusters_sorted": lambda s, d: op.last_rows(clusters(s, d), 5, F.desc("size"), "cluster_id").select("cluster_id", "size"),
    "p08_latest": p08_latest,
    "p09_violation_search": p09_search,
    "p10_bookmarks": p10_bookmarks,
    "p11_timeline": p11_timeline,
    "p12_top_modulations": p12_top,
    "p13_bands": p13_bands,
    "p14_region_filter": lambda s, d: detections(s, d).where("bandwidth_hz >= 5e3 AND snr_db >= 3").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("bandwidth_hz"), 3).alias("hz")),
    "j02_threshold_violations": lambda s, d: violations(s, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), *[F.max("peak_power_db").alias("top_db")]),
    "j02_alerts": j02_alerts,
    "j10_band_lookup": j10_band_lookup,
    "g04_cluster_stats": lambda s, d: clusters(s, d).select("cluster_id", "size", "unique_tracks", "signal_type", *r6("dominant_freq_hz", "freq_min_hz", "freq_max_hz", "avg_snr_db", "avg_power_db", "avg_bandwidth_hz", "avg_bw_ratio", "avg_duty_cycle")),
    "g05_cluster_mode": lambda s, d: clusters(s, d).select("cluster_id", "modulation", "prototype_id"),
    "g07_merged_clusters": lambda s, d: op.merge_clusters(clusters(s, d).withColumn("into", F.col("cluster_id") % 3), "into").select("into", "cluster_id", "size", *r6("avg_snr_db", "dominant_freq_hz")),
    "g08_classification": g08_summary,
    "g09_meter": g09_meter,
    "g10_timing": lambda s, d: op.timing_stats(table(s, d, "events"), "value", "event_type").select("event_type", "n", *r6("mean", "std", "min", "max", "total")),
    "g11_percentiles": g11_percentiles,
    "g12_sdr_rates": g12_rates,
    "g13_transfers": lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("max"), F.min("o_totalprice").alias("min"), F.round(F.sum("o_totalprice"), 2).alias("total")),
    "g19_throttle": g19_throttle,
    "g22_unique_tracks": lambda s, d: detections(s, d).groupBy("cluster_id").agg(F.count_distinct("track_id").alias("tracks"), F.min("center_freq_hz").alias("lo"), F.max("center_freq_hz").alias("hi")),
    "g23_health": g23_health,
    "k21_rate_limit": b11_modulo,
    "k23_severity": lambda s, d: detections(s, d).groupBy(op.severity(F.col("snr_db")).alias("severity")).agg(F.count(F.lit(1)).alias("n")),
    "m11_signal_hints": m11_hints,
    "m12_rule_classes": m12_rules,
}
ORACLES = {
    "k19_violation_lines": f"""{_VIOLATIONS_SQL} SELECT detection_id, rule_id, '"' || name || '","' || printf('%.2f', CAST(peak_power_db AS DOUBLE)) || '","' || printf('%.2f', CAST(level_db AS DOUBLE)) || '","' || printf('%.2f', CAST(peak_power_db - level_db AS DOUBLE)) || '"' AS line FROM violations JOIN rules USING (rule_id)""",
    "k14_cluster_message": f"{_CLUSTERS_SQL} SELECT 'clusters' AS type, CAST(row_number() OVER (ORDER BY cluster_id) - 1 AS INT) AS place, cluster_id, size, round(avg_snr_db, 2) AS avg_snr_db FROM clusters",
    "j09_labels": f"{D} SELECT detection_id, o_orderpriority AS label, round(snr_db, 6) AS snr_db FROM detections JOIN orders ON o_orderkey * 10 + 1 = detection_id",
    "p15_recent": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 100",
    "g17_feature_stats": f"{D} SELECT round(avg(snr_db), 6) AS mean_snr_db, round(stddev_pop(snr_db), 6) AS std_snr_db, round(avg(bandwidth_hz), 6) AS mean_bandwidth_hz, round(stddev_pop(bandwidth_hz), 6) AS std_bandwidth_hz FROM detections",
    "k17_channels": "SELECT CAST(event_id % 40 AS INT) AS channel, count(*) AS n, CAST(CASE event_id % 40 WHEN 37 THEN 2402 WHEN 38 THEN 2426 WHEN 39 THEN 2480 ELSE 2404 + 2 * (event_id % 40) + CASE WHEN event_id % 40 > 10 THEN 2 ELSE 0 END END AS INT) AS freq_mhz FROM events GROUP BY event_id % 40",
    "p01_detection_page": f"{D} SELECT detection_id, round(snr_db, 6) AS snr_db FROM detections WHERE snr_db >= 10 ORDER BY detection_id LIMIT 100 OFFSET 20",
    "p02_lookup": f"{D} SELECT detection_id, round(center_freq_hz, 6) AS center_freq_hz FROM detections WHERE detection_id = 71",
    "p03_last_detections": f"{D} SELECT detection_id FROM detections ORDER BY detection_id DESC LIMIT 1000",
    "p05_dashboard_filter": f"{D} SELECT detection_id, modulation_type FROM detections WHERE snr_db >= 12 AND center_freq_hz BETWEEN 2e7 AND 4e7 AND modulation_type IN ('AF', 'RF') AND ts > TIMESTAMP '1998-01-01' - INTERVAL 3000 DAY",
    "p06_sorted": f"{D} SELECT detection_id, round(snr_db, 6) AS snr_db FROM detections ORDER BY detections.snr_db DESC, peak_power_db DESC, detection_id LIMIT 50",
    "p07_clusters_sorted": f"{_CLUSTERS_SQL} SELECT cluster_id, size FROM clusters ORDER BY size DESC, cluster_id LIMIT 5",
    "p08_latest": "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "p09_violation_search": f"{_VIOLATIONS_SQL} SELECT name, count(*) AS n FROM violations JOIN rules USING (rule_id) WHERE lower(name) LIKE '%1%' OR printf('%.2f', low_hz / 1e6) LIKE '%1%' GROUP BY name",
    "p10_bookmarks": "SELECT p_partkey AS id FROM part WHERE p_retailprice * 1e5 BETWEEN 9.5e7 AND 1.3e8 AND (lower(p_name) LIKE '%brand#1%' OR lower(p_brand) LIKE '%brand#1%' OR lower(p_type) LIKE '%brand#1%')",
    "p11_timeline": "SELECT user_id, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id, epoch_us(min(ts)) AS first_us FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 600 MINUTE GROUP BY user_id",
    "p12_top_modulations": f"{D} SELECT modulation_type, count(*) AS n FROM detections GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6",
    "p13_bands": f"""WITH {_BANDS_SQL}, names(spelling, name) AS (VALUES {", ".join(f"('{x}', '{n}')" for n, a, *_ in op.BANDS for x in (n, *a))}),
c AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN upper(a) ELSE a END AS asked FROM (SELECT *, {list(_ASKED)!r}[c_custkey % {len(_ASKED)} + 1] AS a FROM customer))
SELECT c_custkey, asked, name, category = 'cellular' AS cellular, lo AS f_min_mhz FROM c LEFT JOIN names ON spelling = lower(asked) LEFT JOIN bands USING (name)""",
    "p14_region_filter": f"{D} SELECT count(*) AS n, round(sum(bandwidth_hz), 3) AS hz FROM detections WHERE bandwidth_hz >= 5e3 AND snr_db >= 3",
    "j02_threshold_violations": f"{_VIOLATIONS_SQL} SELECT rule_id, count(*) AS n, max(peak_power_db) AS top_db FROM violations GROUP BY rule_id",
    "j02_alerts": f"""WITH RECURSIVE {_VIOLATIONS_SQL.removeprefix("WITH ")}, strong AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts, detection_id) AS n FROM violations),
walk AS (SELECT rule_id, detection_id, n, ts AS last, true AS alert FROM strong WHERE n = 1
  UNION ALL SELECT s.rule_id, s.detection_id, s.n, CASE WHEN s.ts - w.last >= INTERVAL 7 DAY THEN s.ts ELSE w.last END, s.ts - w.last >= INTERVAL 7 DAY FROM walk w JOIN strong s ON s.rule_id = w.rule_id AND s.n = w.n + 1)
SELECT rule_id, detection_id FROM walk WHERE alert""",
    "j10_band_lookup": f"{D}, {_BANDS_SQL} SELECT name, count(*) AS n, round(avg(center_freq_hz / 2.5e4), 6) AS mean_mhz FROM detections JOIN bands ON center_freq_hz / 2.5e4 BETWEEN lo AND hi GROUP BY name",
    "g04_cluster_stats": f"{_CLUSTERS_SQL}, x AS (SELECT *, avg_bandwidth_hz AS b, avg_duty_cycle AS d FROM clusters) SELECT cluster_id, size, unique_tracks, {_HINT_SQL} AS signal_type, " + _sql6("dominant_freq_hz", "freq_min_hz", "freq_max_hz", "avg_snr_db", "avg_power_db", "avg_bandwidth_hz", "avg_bw_ratio", "avg_duty_cycle") + " FROM x",
    "g05_cluster_mode": f"{_CLUSTERS_SQL} SELECT cluster_id, modulation, prototype_id FROM clusters",
    "g07_merged_clusters": f"{_CLUSTERS_SQL} SELECT cluster_id % 3 AS into, min(cluster_id) AS cluster_id, CAST(sum(size) AS BIGINT) AS size, round(sum(avg_snr_db * size) / sum(size), 6) AS avg_snr_db, round(arg_min(dominant_freq_hz, clusters.cluster_id), 6) AS dominant_freq_hz FROM clusters GROUP BY 1",
    "g08_classification": f"{D} SELECT count(*) AS total, count(*) FILTER (modulation_type <> 'NO') AS classified, count(*) FILTER (modulation_type = 'NO') AS unclassified, count(*) FILTER (snr_db / 30 > 0.5) AS anomalous, count(*) FILTER (modulation_confidence > 0.8) AS confident, round(avg(modulation_confidence), 6) AS mean_confidence, round(100 * count(*) FILTER (modulation_type <> 'NO') / count(*), 6) AS rate_percent FROM detections",
    "g09_meter": "SELECT event_id, round(min(value) OVER w, 6) AS running_min, round(max(value) OVER w, 6) AS running_max, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING), 9) AS recent_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "g10_timing": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(sum(value), 6) AS total FROM events GROUP BY event_type",
    "g11_percentiles": f"{D}, s AS (SELECT cluster_id, list_sort(list(snr_db)) AS v, count(*) AS n FROM detections GROUP BY 1) SELECT cluster_id, " + ", ".join(f"round(v[least(CAST(floor(n * {p} / 100) AS BIGINT), n - 1) + 1], 6) AS p{p}" for p in (50, 95, 99)) + " FROM s",
    "g12_sdr_rates": "SELECT CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS start_s, round(count(*) FILTER (event_type = 'error') / 600, 6) AS overflow_rate, round(100 * count(*) FILTER (event_type = 'error') / count(*), 6) AS drop_percent FROM events GROUP BY 1",
    "g13_transfers": "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS max, min(o_totalprice) AS min, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "g19_throttle": """WITH e AS (SELECT *, CASE WHEN value > 85 THEN 1 WHEN value < 50 THEN 0 END AS edge FROM events),
t AS (SELECT *, coalesce(last_value(edge IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM e),
s AS (SELECT *, CASE WHEN on_ = 1 AND coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) = 0 THEN 1 ELSE 0 END AS start FROM t)
SELECT user_id, CAST(sum(on_) AS BIGINT) AS n_throttled, CAST(sum(start) AS BIGINT) AS activations, round(max(value), 6) AS max_fill FROM s GROUP BY user_id""",
    "g22_unique_tracks": f"{D} SELECT cluster_id, count(DISTINCT track_id) AS tracks, min(center_freq_hz) AS lo, max(center_freq_hz) AS hi FROM detections GROUP BY 1",
    "g23_health": f"""{D}, h AS (SELECT cluster_id / 6 > 1 AS o, snr_db / 20 > 1 AS p, duty_cycle * 100 > 80 AS f, bandwidth_hz / 600 > 70 AS t FROM detections)
SELECT CASE WHEN o OR p OR f THEN 'degraded' ELSE 'healthy' END AS status, concat_ws(',', CASE WHEN o THEN 'overflow' END, CASE WHEN p THEN 'drops' END, CASE WHEN f THEN 'buffer' END, CASE WHEN t THEN 'temperature' END) AS warnings, count(*) AS n FROM h GROUP BY 1, 2""",
    "k21_rate_limit": "SELECT user_id, CAST(floor(epoch(ts) / 1800) AS BIGINT) AS bucket, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1, 2",
    "k23_severity": f"{D} SELECT CASE WHEN snr_db > 25 THEN 'high' WHEN snr_db > 15 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n FROM detections GROUP BY 1",
    "m11_signal_hints": f"{D}, x AS (SELECT bandwidth_hz * cluster_id * 4 AS b, duty_cycle AS d FROM detections) SELECT {_HINT_SQL} AS hint, count(*) AS n FROM x GROUP BY 1",
    "m12_rule_classes": f"{D}, x AS (SELECT bandwidth_hz / 4e5 AS r, snr_db AS s FROM detections) SELECT CASE WHEN r BETWEEN 0 AND 0.01 AND s >= 10 THEN 'narrowband_cw' WHEN r BETWEEN 0 AND 0.01 AND s >= 0 THEN 'narrowband' WHEN r BETWEEN 0.01 AND 0.1 AND s >= 0 THEN 'medium_band' WHEN r BETWEEN 0.1 AND 1 AND s >= 3 THEN 'wideband' ELSE 'unknown' END AS rule, count(*) AS n FROM x GROUP BY 1",
}
