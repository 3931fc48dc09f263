"""The read side: filters, top-k, joins with rules and bands, rollups, meters.

Detections are a table with one row each; every function is DataFrame -> DataFrame and leaves the physical
plan to Catalyst.  Small rule tables (bands, thresholds, reference points) are inputs with a stated bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import micros
from .order import accumulated
from .scan import Cooldown, Meter, Spells, scan

#: Most rows of a rule table, one a bucket, that are broadcast; larger ones are joined by a shuffle.
MAX_RULES = 10_000


# -- filters, order, limits ------------------------------------------------------------------------
def page(df: DataFrame, min_snr_db: float | None = None, offset: int = 0, limit: int = 100, order: Sequence[str] = ("detection_id",)) -> DataFrame:
    """Detections with enough SNR (a missing one counts as 0), one page in order."""
    if not 0 < limit <= 1000 or offset < 0:
        raise ValueError("limit is 1 to 1000, offset at least 0")
    kept = df if min_snr_db is None else df.where(F.coalesce(F.col("snr_db"), F.lit(0.0)) >= min_snr_db)
    return kept.orderBy(*order).offset(offset).limit(limit)


def dashboard_filter(df: DataFrame, min_snr: float | None = None, freq: tuple[float, float] | None = None, modulations: Sequence[str] | None = None, active_before: Column | None = None, age_s: float = 5.0) -> DataFrame:
    """Each given condition must hold; bounds are inclusive."""
    for cond in (
        None if min_snr is None else F.col("snr_db") >= min_snr,
        None if freq is None else F.col("center_freq_hz").between(*freq),
        None if not modulations else F.col("modulation_type").isin(list(modulations)),
        None if active_before is None else F.col("ts") > active_before - F.make_interval(secs=F.lit(age_s)),
    ):
        df = df if cond is None else df.where(cond)
    return df


def last_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in the given order: a top-k, never a global window."""
    return df.orderBy(*order).limit(n)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row written for each key: one aggregation, combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(key).agg(best).select(key, "r.*")


def search(df: DataFrame, text: str, columns: Sequence[str], tags: str | None = None) -> DataFrame:
    """Rows where a column, or one of the tags, contains the text, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(text.lower()))
    if tags:
        found = found | F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(text.lower())))
    return df.where(found)


# -- rules and bands -------------------------------------------------------------------------------
#: Name, aliases, category, lowest and highest MHz.
BANDS = (
    ("band2", ("pcs", "gsm1900"), "cellular", 1850, 1990),
    ("band3", ("dcs", "gsm1800"), "cellular", 1710, 1880),
    ("band5", ("gsm850",), "cellular", 824, 894),
    ("band7", ("imte",), "cellular", 2500, 2690),
    ("band8", ("gsm900",), "cellular", 880, 960),
    ("txlpf400", (), "tx_only", 0, 400),
    ("txlpf1200", (), "tx_only", 0, 1200),
    ("txlpf2100", (), "tx_only", 0, 2100),
    ("txlpf4200", (), "tx_only", 0, 4200),
    ("rxlpf1200", (), "rx_only", 0, 1200),
    ("rxlpf2100", (), "rx_only", 0, 2100),
    ("rxbpf2100_3000", (), "rx_only", 2100, 3000),
    ("rxbpf3000_4200", (), "rx_only", 3000, 4200),
    ("trx0_400", (), "tdd", 0, 400),
    ("trx400_1200", (), "tdd", 400, 1200),
    ("trx1200_2100", (), "tdd", 1200, 2100),
    ("trx2100_3000", (), "tdd", 2100, 3000),
    ("trx3000_4200", (), "tdd", 3000, 4200),
)


def bands(spark) -> DataFrame:
    """The table of duplexer bands."""
    return spark.createDataFrame([(n, list(a), c, lo, hi) for n, a, c, lo, hi in BANDS], "name string, aliases array<string>, category string, f_min_mhz int, f_max_mhz int")


def bands_by_name(df: DataFrame, asked: str) -> DataFrame:
    """``df`` with the band (name, category, f_min_mhz, f_max_mhz) whose name or alias ``asked`` is, in any case; nulls if there is none."""
    known = bands(df.sparkSession).select(F.explode(F.concat(F.array("name"), "aliases")).alias("__spelling"), "name", "category", "f_min_mhz", "f_max_mhz")
    return df.join(F.broadcast(known), F.lower(asked) == F.col("__spelling"), "left").drop("__spelling")  # a fixed table


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bucket: float, max_rules: int = MAX_RULES) -> DataFrame:
    """Rows of both sides where low <= point <= high, an equi-join on buckets of ``bucket`` width.

    A range is a row of each bucket that it touches; up to ``max_rules`` such rows are broadcast.
    """
    cut = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    few = cut.limit(max_rules + 1).count() <= max_rules
    on = (F.col("__at") == F.col("__bucket")) & F.col(point).between(F.col(low), F.col(high))
    return points.withColumn("__at", F.floor(F.col(point) / bucket)).join(F.broadcast(cut) if few else cut, on).drop("__at", "__bucket")


def alerts(violations: DataFrame, cooldown_s: float = 5.0, rule: str = "rule_id", ts: str = "ts", tie: str = "detection_id") -> DataFrame:
    """Violations that raise an alert: the first one of a rule, then the first one after each cooldown.

    A rule's rows are spread over tasks by time; a range of them is a table of jumps between alerts (:mod:`.scan`).
    """
    timed = violations.withColumn("__t", micros(ts) / 1e6)
    return scan(timed, rule, ("__t", tie), ("__t",), Cooldown(cooldown_s)).drop("__t")


# -- classification rules --------------------------------------------------------------------------
def signal_hint(bandwidth: Column, duty: Column) -> Column:
    """Signal type from bandwidth and duty cycle."""
    steady = duty > 0.9
    return (
        F.when(duty < 0.2, F.when(bandwidth >= 200_000, "radar_pulse").otherwise("pulsed_beacon"))
        .when(bandwidth < 25_000, F.when(steady, "narrowband_cw").when(duty < 0.5, "narrowband_burst").otherwise("narrowband_intermittent"))
        .when(bandwidth < 200_000, F.when(steady, "voice_fm").when(duty >= 0.5, "digital_voice").otherwise("medium_band_burst"))
        .when(bandwidth < 1_000_000, F.when(steady, "wideband_digital").otherwise("wideband_burst"))
        .when(bandwidth >= 1_000_000, F.when(steady, "spread_spectrum").otherwise("frequency_hopping"))
        .otherwise("unknown")
    )


def rule_class(bandwidth: Column, snr: Column, sample_rate: float) -> Column:
    """The first template, narrow to wide, that fits bandwidth ratio and SNR."""
    ratio = bandwidth / F.lit(sample_rate) if sample_rate > 0 else F.lit(0.0)
    return (
        F.when(ratio.between(0, 0.01) & (snr >= 10), "narrowband_cw")
        .when(ratio.between(0, 0.01) & (snr >= 0), "narrowband")
        .when(ratio.between(0.01, 0.1) & (snr >= 0), "medium_band")
        .when(ratio.between(0.1, 1.0) & (snr >= 3), "wideband")
        .otherwise("unknown")
    )


def advertising_mhz(channel: Column) -> Column:
    """Frequency of a low-energy channel: three advertising channels, and data channels around the second one."""
    data = 2404 + 2 * channel + F.when(channel > 10, 2).otherwise(0)
    return F.when(channel == 37, 2402).when(channel == 38, 2426).when(channel == 39, 2480).otherwise(data).cast("int")


def severity(snr: Column) -> Column:
    return F.when(snr > 25, "high").when(snr > 15, "medium").otherwise("low")


# -- rollups ---------------------------------------------------------------------------------------
def cluster_rollup(df: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Means, extremes, counts, prototype (largest SNR, then smallest id) and modulation mode of each cluster.

    The mode leaves out Unknown; ties go to the name that is first in order.  Both aggregations combine before
    their shuffles, so a hot cluster sends one row a task.
    """
    stats = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("center_freq_hz").alias("dominant_freq_hz"),
        F.min("center_freq_hz").alias("freq_min_hz"),
        F.max("center_freq_hz").alias("freq_max_hz"),
        F.avg("snr_db").alias("avg_snr_db"),
        F.avg("peak_power_db").alias("avg_power_db"),
        F.avg("bandwidth_hz").alias("avg_bandwidth_hz"),
        F.avg(F.when(F.col("bandwidth_hz") > 0, F.col("bandwidth_3db_hz") / F.col("bandwidth_hz"))).alias("avg_bw_ratio"),
        F.avg("duty_cycle").alias("avg_duty_cycle"),
        F.count_distinct("track_id").alias("unique_tracks"),
        F.max_by("detection_id", F.struct("snr_db", -F.col("detection_id"))).alias("prototype_id"),
    )
    counts = df.where("modulation_type <> 'Unknown'").groupBy(key, "modulation_type").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy(key).agg(F.min_by("modulation_type", F.struct(-F.col("n"), F.col("modulation_type"))).alias("modulation"))
    return stats.join(mode, key, "left").withColumn("signal_type", signal_hint(F.col("avg_bandwidth_hz"), F.col("avg_duty_cycle")))


def merge_clusters(df: DataFrame, into: str, order: str = "cluster_id", centroid: Sequence[str] = ()) -> DataFrame:
    """Clusters merged by ``into``: sizes added, SNR and ``centroid`` columns weighted by size, smallest id, the first one's frequency."""

    def weighted(c: str) -> Column:
        return (F.sum(F.col(c) * F.col("size")) / F.sum("size")).alias(c)

    return df.groupBy(into).agg(
        F.min(order).alias("cluster_id"),
        F.sum("size").alias("size"),
        weighted("avg_snr_db"),
        F.min_by("dominant_freq_hz", order).alias("dominant_freq_hz"),
        *map(weighted, centroid),
    )


def classification_summary(df: DataFrame) -> DataFrame:
    """Counts and rates of the classification dashboard, one row."""
    n = F.count(F.lit(1))
    known = F.count_if(F.col("modulation_type") != "Unknown")
    return df.agg(n.alias("total"), known.alias("classified"), (n - known).alias("unclassified"), F.count_if(F.col("anomaly_score") > 0.5).alias("anomalous"), F.count_if(F.col("modulation_confidence") > 0.8).alias("confident"), F.avg("modulation_confidence").alias("mean_confidence"), (100 * known / n).alias("rate_percent"))


def timing_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, population deviation, extremes and total."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("total"))


def index_percentile(df: DataFrame, value: str, p: int, *keys: str) -> DataFrame:
    """The value at place int(n * p / 100) of the sorted values, exactly.

    Values are counted per key before any shuffle of rows; counts are added up in order over ranges of key and value
    (:func:`.order.accumulated`), so continuous values of one key are spread as well.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__key", F.struct(*keys) if keys else F.lit(0))
    all_ = counts.groupBy("__key").agg(F.sum("__n").alias("__all"))
    placed = accumulated(counts, "__key", "__n", value).join(all_.withColumnRenamed("__key", "__own"), F.col("__key").eqNullSafe(F.col("__own")))
    place = F.least(F.floor(F.col("__all") * p / 100), F.col("__all") - 1)
    return placed.where((F.col("place") <= place) & (F.col("place") + F.col("__n") > place)).select(*keys, F.col(value).alias(f"p{p}"))


def benchmark_stats(df: DataFrame, drop_percent: str, *keys: str) -> DataFrame:
    """Mean, sample deviation and extremes of drop rates, intervals below 0.1 %, and the verdict."""
    mean, most = F.avg(drop_percent), F.max(drop_percent)
    verdict = F.when((mean < 0.5) & (most < 2.0), "PASS").when(mean < 2.0, "MARGINAL").otherwise("FAIL")
    deviation = F.when(F.count(drop_percent) > 1, F.stddev_samp(drop_percent)).otherwise(0.0)
    return df.groupBy(*keys).agg(F.count(drop_percent).alias("n"), mean.alias("mean"), deviation.alias("std"), F.min(drop_percent).alias("min"), most.alias("max"), F.count_if(F.col(drop_percent) < 0.1).alias("drop_free"), verdict.alias("status"))


def throttled(df: DataFrame, key: str, fill: str, *order: str, on: float = 85.0, off: float = 50.0) -> DataFrame:
    """``df`` with ``throttled`` (0 or 1): on above ``on``, off below ``off``, else as before; ``start`` and ``stop`` of spells, and the ``spell``'s number."""
    out = scan(df, key, order, (fill,), Spells(on, off), "__s struct<throttled: int, start: int, stop: int, spell: int>")
    return out.select(*df.columns, "__s.*")


def throttle_summary(df: DataFrame, key: str, fill: str, seconds: str, *order: str, on: float = 85.0, off: float = 50.0) -> DataFrame:
    """Activations, mean spell (a start to the next stop), largest fill, and the time from its last occurrence to the first fill below ``off`` after it."""
    rows = throttled(df, key, fill, *order, on=on, off=off)
    border = lambda c: F.min(F.when(F.col(c) == 1, F.col(seconds)))
    each = rows.where("start = 1 OR stop = 1").groupBy(key, "spell").agg((border("stop") - border("start")).alias("length"))
    spells = each.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("activations"), F.avg("length").alias("mean_spell_s"))
    place = F.struct(*order)
    peaks = df.groupBy(F.col(key).alias("__key")).agg(F.max(fill).alias("max_fill"), F.max_by(F.struct(place.alias("place"), F.col(seconds).alias("t")), F.struct(F.col(fill), *order)).alias("peak"))
    after = df.where(F.col(fill) < off).join(peaks.select("__key", "peak"), F.col(key).eqNullSafe(F.col("__key")) & (place >= F.col("peak.place")))
    low = after.groupBy("__key").agg(F.min_by(F.col(seconds), place).alias("low"))
    same = lambda a, b: F.col(f"{a}.__key").eqNullSafe(F.col(f"{b}.__key"))
    joined = peaks.alias("p").join(spells.alias("s"), same("p", "s"), "left").join(low.alias("l"), same("p", "l"), "left")
    recovery = F.coalesce(F.col("low") - F.col("peak.t"), F.lit(0.0))
    return joined.select(F.col("p.__key").alias(key), F.coalesce("activations", F.lit(0)).alias("activations"), F.coalesce("mean_spell_s", F.lit(0.0)).alias("mean_spell_s"), "max_fill", recovery.alias("recovery_s"))


def meter(df: DataFrame, value: str, key: str, *order: str, last: int = 100) -> DataFrame:
    """Running extremes and the mean of the last values of each key."""
    kind = df.schema[value].dataType.simpleString()
    out = scan(df, key, order, (value,), Meter(last), f"__m struct<running_min: {kind}, running_max: {kind}, recent_mean: double>")
    return out.select(*df.columns, "__m.*")


def health(overflow_rate: Column, drop_percent: Column, fill_percent: Column, temperature: Column) -> Column:
    """(status, warnings): temperature warns without degrading."""
    warn = F.filter(F.array(F.when(overflow_rate > 1, "overflow"), F.when(drop_percent > 1, "drops"), F.when(fill_percent > 80, "buffer"), F.when(temperature > 70, "temperature")), lambda x: x.isNotNull())
    bad = (overflow_rate > 1) | (drop_percent > 1) | (fill_percent > 80)
    return F.struct(F.when(bad, "degraded").otherwise("healthy").alias("status"), warn.alias("warnings"))
