"""Queries of features, clustering and anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import autoencoder
from ..operators import learning as op
from ..operators.cfar import Cfar
from ..operators.peaks import Peaks, detect
from .detection import FLAGSHIP_SQL
from ..sources.tables import DETECTIONS_SQL, IQ_SQL, RATE, detections, iq_frames, psd_frames, table

EPS, MIN = 1.17, 5


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


_VECTORS_SQL = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x, label FROM embeddings)"
_LINKS_SQL = f"{_VECTORS_SQL}, links AS (SELECT a.id AS a, b.id AS b, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id < b.id WHERE list_distance(a.x, b.x) <= {EPS}), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumns({"start_bin": F.lit(4), "end_bin": F.lit(4) + (F.col("detection_id") % 7)})
    cols = op.cluster_features(1e6, 50e6, 1024)
    return d.select("detection_id", *cols)


_FEATURES_SQL = f"""{DETECTIONS_SQL}, f AS (SELECT detection_id, center_freq_hz / 100e6 AS freq, bandwidth_hz / 1e6 AS width, (peak_power_db + 120) / 120 AS power, snr_db / 60 AS snr,
  CASE WHEN bandwidth_hz > 0 THEN bandwidth_3db_hz / bandwidth_hz ELSE 0.5 END AS shape3, CASE WHEN bandwidth_hz > 0 THEN bandwidth_6db_hz / bandwidth_hz ELSE 0.7 END AS shape6,
  (detection_id % 7) / 1024 AS span, duty_cycle AS duty, least(frames_seen, 100) / 100 AS age FROM detections)"""
_F = ("freq", "width", "power", "snr", "shape3", "shape6", "span", "duty", "age")


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = op.normalized(features(spark, sf_dir), list(_F))
    return n.select("detection_id", *(F.round(c, 6).alias(c) for c in _F))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir).withColumns({"f": F.col("center_freq_hz") / 1e9, "b": F.col("bandwidth_hz") / 1e6})
    return op.z_anomaly(d, ["f", "b", "snr_db", "peak_power_db"], threshold=1.0).select("detection_id", F.round("anomaly_score", 6).alias("anomaly_score"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    v = vectors(spark, sf_dir)
    return op.nearest(v.where("id % 20 = 0"), v, EPS, skip_same=True).select("id", "nearest_id", "label", F.round("distance", 6).alias("distance"))


def reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return op.reconstruction_anomaly(v, *op.principal(v, 8), center=0.01, slope=500.0).select("id", F.round("anomaly_score", 6).alias("anomaly_score"))


def detection_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x): the twelve features of each detection, scaled."""
    d = detections(spark, sf_dir).withColumn("symbol_rate", F.col("bandwidth_hz") / 1.35)
    names = [f"a{k}" for k in range(12)]
    n = op.normalized(d.select("detection_id", *op.anomaly_features()), names)
    return n.select(F.col("detection_id").alias("id"), F.array(*names).alias("x"))


def autoencoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all detections by a network that learnt from them in sixteen steps, each over a quarter of the rows."""
    rows = detection_vectors(spark, sf_dir)
    learner, _ = autoencoder.train(rows, autoencoder.Learner.fresh(rate=1e-2), 16, parts=4)
    return autoencoder.scored(rows, learner, center=1.0, slope=2.0).select("id", F.round("anomaly_score", 6).alias("anomaly_score"))


def iq_autoencoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for blocks of samples: i and q of each frame through the innermost eight."""
    rows = iq_frames(spark, sf_dir).select(F.col("frame_id").alias("id"), F.concat("i", "q").alias("x"))
    shape = autoencoder.Shape((64, 32, 16, 8))
    learner, _ = autoencoder.train(rows, autoencoder.Learner.fresh(shape, 1e-2), 12)
    return autoencoder.scored(rows, learner, center=0.05, slope=20.0).select("id", F.round("anomaly_score", 6).alias("anomaly_score"))


def learnt_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and normal rows of eight batches of detections, learnt from one after the other."""
    rows = detection_vectors(spark, sf_dir)
    online = autoencoder.Online(autoencoder.temporary_folder(spark), autoencoder.Learner.fresh(rate=1e-2), interval=100, normal=0.5, center=1.0, slope=2.0)
    for k in range(8):
        online.learn(rows.where(F.pmod(F.xxhash64("id"), F.lit(8)) == k), k)
    return online.versions(spark).select("batch", "version", "rows", "low", F.round("loss", 6).alias("loss"))


def duty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of samples with more than half the mean energy, in the row."""
    e = iq_frames(spark, sf_dir).select("frame_id", F.zip_with("i", "q", lambda a, b: a * a + b * b).alias("e"))
    mean = F.aggregate("e", F.lit(0.0), lambda s, x: s + x) / F.size("e")
    return e.withColumn("m", mean).select("frame_id", F.round(F.size(F.filter("e", lambda x: x > F.col("m") * 0.5)) / F.size("e"), 6).alias("duty"))


def associated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest detection of the frame before, less than 3 kHz away, for each detection."""
    d = detect(psd_frames(spark, sf_dir), Cfar(8, 2, 1e-2), Peaks(RATE, 1000.0)).select("frame_id", "detection_id", F.round("center_freq_hz", 6).alias("center_freq_hz"))
    before = d.select((F.col("frame_id") + 1).alias("frame_id"), F.col("detection_id").alias("track"), F.col("center_freq_hz").alias("hz"))
    near = d.join(before, "frame_id", "left").withColumn("gap", F.abs(F.col("center_freq_hz") - F.col("hz")))
    best = F.min_by("track", F.when(F.col("gap") < 2999.5, F.struct(F.round("gap", 4), F.col("track"))))
    return near.groupBy("frame_id", "detection_id").agg(best.alias("track"), F.round(F.min(F.when(F.col("gap") < 2999.5, F.col("gap"))), 4).alias("gap_hz"))


QUERIES = {
    "m06_cluster_features": lambda s, d: features(s, d).select("detection_id", *(F.round(c, 9).alias(c) for c in _F)),
    "m05_normalized": scaled,
    "m13_anomaly_features": lambda s, d: detections(s, d).withColumn("symbol_rate", F.col("bandwidth_hz") / 1.35).select("detection_id", *op.anomaly_features()).select("detection_id", *(F.round(f"a{k}", 9).alias(f"a{k}") for k in range(12))),
    "m16_z_anomaly": anomalies,
    "m15_reconstruction_anomaly": reconstructed,
    "m15_autoencoder": autoencoded,
    "m15_iq_autoencoder": iq_autoencoded,
    "m17_online_learning": learnt_online,
    "m03_duty": duty,
    "m09_tuned_eps": lambda s, d: s.createDataFrame([(float(op.tuned_eps(vectors(s, d))),)], "eps double").select(F.round("eps", 9).alias("eps")),
    "m08_components": lambda s, d: op.cluster(vectors(s, d), EPS, MIN),
    "m07_dbscan": lambda s, d: op.cluster(vectors(s, d), EPS, MIN, "dbscan"),
    "g06_centroids": lambda s, d: vectors(s, d).select("label", F.posexplode("x").alias("place", "v")).groupBy("label", "place").agg(F.round(F.avg("v"), 8).alias("v"), F.count(F.lit(1)).alias("n")),
    "j01_association": associated,
    "j03_nearest_point": neighbours,
    "j04_eps_links": lambda s, d: op.eps_links(vectors(s, d), EPS).select("a", "b", F.round("distance", 6).alias("distance")),
    "w26_elbow": lambda s, d: op.elbow(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")), "v", "k").select("place", F.round("bend", 6).alias("bend")),
}


def _components_sql(edges: str, nodes: str) -> str:
    return f"""reach(id, root) AS (SELECT id, id FROM {nodes} UNION SELECT e.b, r.root FROM reach r JOIN {edges} e ON e.a = r.id WHERE r.root < e.b), roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""


_POINTS_SQL = f"points AS (SELECT id, count(b) + 1 AS n_neighbours, count(b) + 1 >= {MIN} AS core FROM v LEFT JOIN both_ways ON a = id GROUP BY id)"
ORACLES = {
    "m06_cluster_features": f"WITH {_FEATURES_SQL} SELECT detection_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in _F) + " FROM f",
    "m05_normalized": f"WITH {_FEATURES_SQL} SELECT detection_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () < 1e-8 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}" for c in _F) + " FROM f",
    "m13_anomaly_features": f"""WITH {DETECTIONS_SQL} SELECT detection_id, round(center_freq_hz / 1e9, 9) AS a0, round(bandwidth_hz / 1e6, 9) AS a1, round(bandwidth_3db_hz / greatest(bandwidth_hz, 1), 9) AS a2,
  round(bandwidth_6db_hz / greatest(bandwidth_hz, 1), 9) AS a3, round((peak_power_db + 120) / 100, 9) AS a4, round(snr_db / 60, 9) AS a5, round(modulation_confidence, 9) AS a6, round(CASE WHEN duty_cycle = 0 THEN 0.5 ELSE duty_cycle END, 9) AS a7,
  round((cluster_id + 1) / 100, 9) AS a8, round(least(greatest(frames_seen, 1), 100) / 100, 9) AS a9, round(bandwidth_hz / 1.35e0 / 1e6, 9) AS a10, 0e0 AS a11 FROM detections""",
    "m16_z_anomaly": f"""WITH {DETECTIONS_SQL}, z AS (SELECT detection_id, greatest({", ".join(f"abs(({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-6))" for c in ("center_freq_hz / 1e9", "bandwidth_hz / 1e6", "snr_db", "peak_power_db"))}) AS z FROM detections)
SELECT detection_id, round(1 / (1 + exp(-(z - 1))), 6) AS anomaly_score FROM z""",
    "m03_duty": f"WITH {IQ_SQL}, e AS (SELECT frame_id, i * i + q * q AS e, avg(i * i + q * q) OVER (PARTITION BY frame_id) AS m FROM iq) SELECT frame_id, round(count(*) FILTER (e > m * 0.5) / count(*), 6) AS duty FROM e GROUP BY 1",
    "m09_tuned_eps": f"WITH {_VECTORS_SQL} SELECT round(0.5 * stddev_pop(e), 9) AS eps FROM v, unnest(x) u(e)",
    "m08_components": f"WITH RECURSIVE {_LINKS_SQL}, {_POINTS_SQL}, {_components_sql('both_ways', 'v')}, named AS (SELECT root, min(id) AS cluster FROM roots JOIN points USING (id) WHERE core GROUP BY root) SELECT id, n_neighbours, core, coalesce(cluster, -1) AS cluster FROM points JOIN roots USING (id) LEFT JOIN named USING (root)",
    "m07_dbscan": f"""WITH RECURSIVE {_LINKS_SQL}, {_POINTS_SQL}, cores AS (SELECT id FROM points WHERE core), core_edges AS (SELECT a, b FROM both_ways WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)),
{_components_sql('core_edges', 'cores')}, border AS (SELECT a AS id, arg_min(root, b) AS near FROM both_ways JOIN roots ON roots.id = b GROUP BY a)
SELECT id, n_neighbours, core, coalesce(root, near, -1) AS cluster FROM points LEFT JOIN roots USING (id) LEFT JOIN border USING (id)""",
    "g06_centroids": f"WITH {_VECTORS_SQL} SELECT label, CAST(k - 1 AS INT) AS place, round(avg(x[k]), 8) AS v, count(*) AS n FROM v, unnest(generate_series(1, 64)) u(k) GROUP BY 1, 2",
    "j03_nearest_point": f"WITH {_VECTORS_SQL} SELECT q.id, p.id AS nearest_id, CASE WHEN list_distance(q.x, p.x) <= {EPS} THEN p.label ELSE -1 END AS label, round(list_distance(q.x, p.x), 6) AS distance FROM v q JOIN v p ON q.id % 20 = 0 AND p.id <> q.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.x, p.x), 9), p.id) = 1",
    "j04_eps_links": f"WITH {_LINKS_SQL} SELECT a, b, round(d, 6) AS distance FROM links",
    "w26_elbow": "WITH s AS (SELECT s_acctbal AS v, row_number() OVER w AS place, lead(s_acctbal, 2) OVER w - 2 * lead(s_acctbal, 1) OVER w + s_acctbal AS bend FROM supplier WINDOW w AS (ORDER BY s_acctbal, s_suppkey)) SELECT CAST(place AS INT) AS place, round(bend, 6) AS bend FROM s WHERE bend IS NOT NULL ORDER BY s.bend DESC, place LIMIT 1",
}
ORACLES["j01_association"] = f"""WITH d AS ({FLAGSHIP_SQL}) SELECT a.frame_id, a.detection_id, arg_min(b.detection_id, struct_pack(g := round(abs(a.center_freq_hz - b.center_freq_hz), 4), t := b.detection_id)) FILTER (abs(a.center_freq_hz - b.center_freq_hz) < 2999.5) AS track,
  round(min(abs(a.center_freq_hz - b.center_freq_hz)) FILTER (abs(a.center_freq_hz - b.center_freq_hz) < 2999.5), 4) AS gap_hz FROM d a LEFT JOIN d b ON b.frame_id = a.frame_id - 1 GROUP BY 1, 2"""
