"""Queries of thresholds and detections over the psd frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import map_frames
from ..operators import settings
from ..operators.cfar import Cfar, detect_bins
from ..operators.peaks import Peaks, detect, local_peaks
from ..sources.tables import BINS, BINS_SQL, FRAMES_SQL, RATE, psd_frames, table

R, G, PFA = 8, 2, 1e-2
STEP = RATE / BINS
_HZ = f"{STEP:.0f}e0"
ALPHA = Cfar(R, G, PFA).alpha


def long_bins(spark: SparkSession, sf_dir: str, cfar: Cfar, in_db: bool = False) -> DataFrame:
    """Detected bins of every frame with noise and snr."""
    frames = psd_frames(spark, sf_dir)
    if in_db:
        frames = frames.withColumn("psd", F.transform("psd", lambda x: 10 * F.log10(x + 1e-12)))
    bins = detect_bins(frames, cfar).select("frame_id", F.posexplode(F.arrays_zip("noise", "snr", "detected")).alias("bin", "c"))
    return bins.where("c.detected").select("frame_id", "bin", F.round("c.noise", 8).alias("noise"), F.round("c.snr", 6).alias("snr"))


def _side(first: str, last: str, edge: str) -> str:
    cell = {"edge": f"psd[greatest(1, least({BINS}, i))]", "wrap": f"psd[1 + (i - 1 + {BINS}) % {BINS}]", "zero": f"CASE WHEN i BETWEEN 1 AND {BINS} THEN psd[i] ELSE 0 END"}[edge]
    return f"list_transform(generate_series({first}, {last}), lambda i: {cell})"


def cfar_sql(variant: str, edge: str = "edge", domain: str = "linear", rank: int | None = None, where: str = "WHERE p > threshold") -> str:
    """DuckDB SQL of :func:`long_bins` with list functions."""
    left, right = _side(f"k - {G + R}", f"k - {G + 1}", edge), _side(f"k + {G + 1}", f"k + {G + R}", edge)
    noise = {
        "CA": f"(list_sum(l) + list_sum(r)) / {2 * R}", "GO": f"greatest(list_avg(l), list_avg(r))", "SO": "least(list_avg(l), list_avg(r))",
        "OS": "list_median(list_concat(l, r))" if rank is None else f"list_sort(list_concat(l, r))[{(rank or 0) + 1}]",
    }[variant]
    psd = "list_transform(psd, lambda x: 10 * log10(x + 1e-12))" if domain == "db" else "psd"
    threshold, snr = (f"noise + {10} * log10({ALPHA!r})", "p - noise") if domain == "db" else (f"{ALPHA!r} * noise", "p / greatest(noise, 1e-12)")
    return f"""WITH {FRAMES_SQL}, f AS (SELECT frame_id, {psd} AS psd FROM frames),
cells AS (SELECT frame_id, CAST(k - 1 AS INT) AS bin, psd[k] AS p, {left} AS l, {right} AS r FROM f, unnest(generate_series(1, {BINS})) u(k)),
est AS (SELECT frame_id, bin, p, {noise} AS noise FROM cells), thr AS (SELECT *, {threshold} AS threshold, {snr} AS snr FROM est)
SELECT frame_id, bin, round(noise, 8) AS noise, round(snr, 6) AS snr FROM thr {where}"""


_VARIANTS = {
    "w01_cfar_ca": Cfar(R, G, PFA),
    "w02_cfar_zero_pad": Cfar(R, G, PFA, edge="zero"),
    "w03_cfar_go": Cfar(R, G, PFA, "GO"),
    "w03_cfar_so": Cfar(R, G, PFA, "SO"),
    "w04_cfar_os": Cfar(R, G, PFA, "OS"),
    "w11_cfar_os_rank_wrap": Cfar(R, G, PFA, "OS", edge="wrap", rank=11),
}

DETECT = Peaks(RATE, merge_hz=STEP, min_bins=1, min_snr_db=3.0)


def flagship_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectrum to detections for every frame."""
    d = detect(psd_frames(spark, sf_dir), Cfar(R, G, PFA), DETECT)
    rounded = [F.round(c, 6).alias(c) for c in ("peak_power_db", "snr_db", "noise_floor_db", "center_freq_hz", "bandwidth_hz", "bandwidth_3db_hz", "bandwidth_6db_hz")]
    return d.select("frame_id", "detection_id", "start_bin", "end_bin", "peak_bin", *rounded)


REGIONS_SQL = f"""{BINS_SQL},
sums AS (SELECT frame_id, bin, p, (coalesce(sum(p) OVER l, 0) + greatest(0, {R} - greatest(0, bin - {G})) * first_value(p) OVER w
   + coalesce(sum(p) OVER r, 0) + greatest(0, {R} - greatest(0, {BINS - 1} - {G} - bin)) * last_value(p) OVER w) / {2 * R} AS noise FROM bins
   WINDOW l AS (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN {R + G} PRECEDING AND {G + 1} PRECEDING),
          r AS (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN {G + 1} FOLLOWING AND {R + G} FOLLOWING),
          w AS (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
levels AS (SELECT frame_id, bin, 10 * log10(p + 1e-12) AS db, p > {ALPHA!r} * noise AS hit, p / greatest(noise, 1e-12) AS snr FROM sums),
islands AS (SELECT frame_id, min(bin) AS a, max(bin) + 1 AS b FROM (SELECT frame_id, bin, bin - row_number() OVER (PARTITION BY frame_id ORDER BY bin) AS g FROM levels WHERE hit) GROUP BY frame_id, g)"""
MERGED_SQL = f"""{REGIONS_SQL},
flagged AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY frame_id ORDER BY a) <= 1 THEN 0 ELSE 1 END AS new FROM islands),
merged AS (SELECT frame_id, min(a) AS start_bin, max(b) AS end_bin FROM (SELECT *, sum(new) OVER (PARTITION BY frame_id ORDER BY a) AS g FROM flagged) GROUP BY frame_id, g)"""
FLAGSHIP_SQL = f"""WITH {MERGED_SQL},
floors AS (SELECT frame_id, coalesce(median(db) FILTER (NOT hit), min(db)) AS floor_db FROM levels GROUP BY frame_id),
tops AS (SELECT m.frame_id, start_bin, end_bin, arg_max(bin, struct_pack(d := db, b := -bin)) AS peak_bin, max(db) AS peak,
   sum((bin - 32) * {_HZ} * pow(10, db / 10)) / sum(pow(10, db / 10)) AS center FROM merged m JOIN levels l ON l.frame_id = m.frame_id AND bin >= start_bin AND bin < end_bin GROUP BY ALL),
good AS (SELECT t.*, floor_db, peak - floor_db AS snr FROM tops t JOIN floors USING (frame_id) WHERE peak - floor_db >= 3),
wide AS (SELECT g.frame_id, g.start_bin,
   coalesce(min(bin) FILTER (bin >= peak_bin AND db <= peak - 3), 63) - coalesce(max(bin) FILTER (bin <= peak_bin AND db <= peak - 3), 0) AS w3,
   coalesce(min(bin) FILTER (bin >= peak_bin AND db <= peak - 6), 63) - coalesce(max(bin) FILTER (bin <= peak_bin AND db <= peak - 6), 0) AS w6
   FROM good g JOIN levels l ON l.frame_id = g.frame_id GROUP BY ALL)
SELECT frame_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY start_bin) - 1 AS INT) AS detection_id, start_bin, end_bin, peak_bin, round(peak, 6) AS peak_power_db, round(snr, 6) AS snr_db,
  round(floor_db, 6) AS noise_floor_db, round(center, 6) AS center_freq_hz, round((end_bin - 1 - start_bin) * {_HZ}, 6) AS bandwidth_hz, round(w3 * {_HZ}, 6) AS bandwidth_3db_hz, round(w6 * {_HZ}, 6) AS bandwidth_6db_hz
FROM good JOIN wide USING (frame_id, start_bin)"""


#: Settings that change twice: a larger SNR from frame 100 on, fewer false alarms from frame 300 on.
BASE = {"cfar": {"reference": str(R), "guard": str(G), "pfa": "1e-2"}, "peaks": {"sample_rate": str(RATE), "merge_hz": str(STEP), "min_snr_db": "3.0"}}
CHANGES = [(100, "peaks", {"min_snr_db": "6.0"}), (300, "cfar", {"pfa": "1e-3"})]


def reconfigured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of frames, one a second, each under the settings of its own time."""
    changes = spark.createDataFrame(CHANGES, "at long, section string, settings map<string,string>").select(F.timestamp_seconds("at").alias("valid_from"), "section", "settings")
    versions = settings.Versions.read(changes, BASE)
    frames = psd_frames(spark, sf_dir).withColumn("version", versions.number_of(F.col("frame_id") * 1_000_000))
    out = versions.staged(frames, ("cfar", "peaks"), lambda part, cfar, peaks: detect(part, cfar, peaks, keep=("frame_id", "version")))
    return out.select("frame_id", "version", "start_bin", "end_bin", "peak_bin", F.round("snr_db", 6).alias("snr_db"))


def _spans(spark: SparkSession, sf_dir: str, gap: int | None) -> DataFrame:
    from ..operators.peaks import merge, regions

    cfar = Cfar(R, G, PFA)

    def kernel(psd):
        return [[regions(m) if gap is None else merge(regions(m), gap) for m in cfar(psd)[3]]]

    found = map_frames(psd_frames(spark, sf_dir), kernel, ["psd"], "found array<struct<start_bin: int, end_bin: int>>", ["frame_id"])
    return found.select("frame_id", F.explode("found").alias("d")).select("frame_id", "d.*")


def w12_local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima among detected bins."""
    cfar = Cfar(R, G, PFA)

    def kernel(psd):
        _, _, snr, mask = cfar(psd)
        return [[local_peaks(p, m, s, 2.0) for p, m, s in zip(psd, mask, snr)]]

    return map_frames(psd_frames(spark, sf_dir), kernel, ["psd"], "found array<int>", ["frame_id"]).select("frame_id", F.explode("found").alias("bin"))


def w09_threshold_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of the threshold map: alpha times noise, and power over snr."""
    bins = detect_bins(psd_frames(spark, sf_dir), Cfar(R, G, PFA), keep=("frame_id", "psd")).select("frame_id", F.posexplode(F.arrays_zip("psd", "threshold", "snr")).alias("bin", "c"))
    return bins.select("frame_id", "bin", F.round("c.threshold", 8).alias("threshold"), F.round(F.col("c.psd") / (F.col("c.snr") + 1e-12), 8).alias("reference_map"))


def g16_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median level of the bins without detection."""
    bins = detect_bins(psd_frames(spark, sf_dir), Cfar(R, G, PFA), keep=("frame_id", "psd"))
    quiet = F.transform(F.filter(F.arrays_zip("psd", "detected"), lambda c: ~c["detected"]), lambda c: 10 * F.log10(c["psd"] + 1e-12))
    level = F.array_sort(F.when(F.size(quiet) > 0, quiet).otherwise(F.array(F.array_min(F.transform("psd", lambda x: 10 * F.log10(x + 1e-12))))))
    n = F.size("s")
    middle = (F.element_at("s", F.floor((n + 1) / 2).cast("int")) + F.element_at("s", F.floor(n / 2 + 1).cast("int"))) / 2
    return bins.select("frame_id", level.alias("s")).select("frame_id", F.round(middle, 6).alias("noise_floor_db"))


def w05_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold factor of each order line's settings: reference cells from its line number, false alarms from its discount."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (4 * F.col("l_linenumber") + 4).alias("reference"), ((F.col("l_discount") + 0.001) / 10).alias("pfa"))
    return lines.select("l_orderkey", "l_linenumber", F.round(Cfar.alpha_of(F.col("reference"), F.col("pfa")), 6).alias("alpha"))


def w07_frames_share_cfar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections a frame and a label of the batched spectrogram."""
    per = detect_bins(psd_frames(spark, sf_dir), Cfar(R, G, PFA), keep=("frame_id", "label")).select("label", F.size(F.filter("detected", lambda x: x)).alias("n"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("n").alias("n_detected"), F.max("n").alias("most"))


QUERIES = {
    "t12_reconfigured": reconfigured,
    "flagship_detect": flagship_detect,
    **{name: (lambda s, d, c=c: long_bins(s, d, c)) for name, c in _VARIANTS.items()},
    "w10_cfar_db_wrap": lambda s, d: long_bins(s, d, Cfar(R, G, PFA, edge="wrap", domain="db"), in_db=True),
    "w05_cfar_alpha": w05_alpha,
    "w07_cfar_batched": w07_frames_share_cfar,
    "w09_threshold_map": w09_threshold_map,
    "w12_local_peaks": w12_local_peaks,
    "w13_regions": lambda s, d: _spans(s, d, None),
    "w14_merged_regions": lambda s, d: _spans(s, d, 1),
    "g16_noise_floor": g16_noise_floor,
}
ORACLES = {
    "t12_reconfigured": " UNION ALL ".join(
        f"SELECT frame_id, CAST({k} AS INT) AS version, start_bin, end_bin, peak_bin, snr_db FROM ({FLAGSHIP_SQL.replace(repr(ALPHA), repr(Cfar(R, G, pfa).alpha)).replace('peak - floor_db >= 3)', f'peak - floor_db >= {snr})')}) WHERE frame_id >= {a} AND frame_id < {b}"
        for k, (a, b, pfa, snr) in enumerate(((0, 100, 1e-2, 3), (100, 300, 1e-2, 6), (300, 1 << 60, 1e-3, 6)))
    ),
    "flagship_detect": FLAGSHIP_SQL,
    **{name: cfar_sql(c.variant, c.edge, c.domain, c.rank) for name, c in _VARIANTS.items()},
    "w10_cfar_db_wrap": cfar_sql("CA", "wrap", "db"),
    "w05_cfar_alpha": "SELECT l_orderkey, l_linenumber, round((8 * l_linenumber + 8) * (pow((l_discount + 0.001e0) / 10, -1e0 / (8 * l_linenumber + 8)) - 1), 6) AS alpha FROM lineitem",
    "w07_cfar_batched": f"WITH {REGIONS_SQL}, per AS (SELECT frame_id, count(*) FILTER (hit) AS n FROM levels GROUP BY 1) SELECT label, count(*) AS n_frames, CAST(sum(n) AS BIGINT) AS n_detected, CAST(max(n) AS INT) AS most FROM per JOIN frames USING (frame_id) GROUP BY label",
    "w09_threshold_map": cfar_sql("CA", where="").replace("round(noise, 8) AS noise, round(snr, 6) AS snr", "round(threshold, 8) AS threshold, round(p / (snr + 1e-12), 8) AS reference_map"),
    "w12_local_peaks": f"WITH {REGIONS_SQL}, n AS (SELECT *, lag(db, 1, -1e9) OVER w AS l, lead(db, 1, -1e9) OVER w AS r FROM levels WINDOW w AS (PARTITION BY frame_id ORDER BY bin)) SELECT frame_id, bin FROM n WHERE hit AND snr >= 2 AND db >= l AND db >= r QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY bin) <= 128",
    "w13_regions": f"WITH {REGIONS_SQL} SELECT frame_id, a AS start_bin, b AS end_bin FROM islands",
    "w14_merged_regions": f"WITH {MERGED_SQL} SELECT frame_id, start_bin, end_bin FROM merged",
    "g16_noise_floor": f"WITH {REGIONS_SQL} SELECT frame_id, round(coalesce(median(db) FILTER (NOT hit), min(db)), 6) AS noise_floor_db FROM levels GROUP BY frame_id",
}
