"""RF views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rate of the frames made from vectors: 64 bins of 1 kHz.
BINS, RATE = 64, 64_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def psd_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, label, psd: squares of each vector."""
    square = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "label", square.alias("psd"))


def iq_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, label, i, q: even and odd places of each vector."""

    def every_other(first: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.element_at("embedding", 2 * k + first + 1).cast("double"))

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "label", every_other(0).alias("i"), every_other(1).alias("q"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for each order line."""
    price, qty = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("detection_id"),
        (price * 1e3).alias("center_freq_hz"),
        (qty * 1e3).alias("bandwidth_hz"),
        (qty * 1e3 * (1 - F.col("l_discount"))).alias("bandwidth_3db_hz"),
        (qty * 1e3 * (1 - F.col("l_tax"))).alias("bandwidth_6db_hz"),
        (qty - 120).alias("peak_power_db"),
        (F.col("l_discount") * 300).alias("snr_db"),
        F.concat("l_returnflag", "l_linestatus").alias("modulation_type"),
        (F.col("l_tax") * 10).alias("modulation_confidence"),
        F.col("l_suppkey").alias("track_id"),
        (F.col("l_partkey") % 12).alias("cluster_id"),
        (F.col("l_linenumber") / 8).alias("duty_cycle"),
        (F.col("l_orderkey") % 150).alias("frames_seen"),
        F.col("l_shipdate").alias("ts"),
    )


#: The same views for DuckDB.
FRAMES_SQL = f"frames AS (SELECT vec_id AS frame_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS psd FROM embeddings)"
BINS_SQL = FRAMES_SQL + f", bins AS (SELECT frame_id, label, CAST(k - 1 AS INT) AS bin, psd[k] AS p FROM frames, unnest(generate_series(1, {BINS})) u(k))"
IQ_SQL = "iq AS (SELECT vec_id AS frame_id, label, CAST(k AS INT) AS n, CAST(embedding[2 * k + 1] AS DOUBLE) AS i, CAST(embedding[2 * k + 2] AS DOUBLE) AS q FROM embeddings, unnest(generate_series(0, 31)) u(k))"
DETECTIONS_SQL = """detections AS (SELECT l_orderkey * 10 + l_linenumber AS detection_id, l_extendedprice * 1e3 AS center_freq_hz, l_quantity * 1e3 AS bandwidth_hz,
  l_quantity * 1e3 * (1 - l_discount) AS bandwidth_3db_hz, l_quantity * 1e3 * (1 - l_tax) AS bandwidth_6db_hz, l_quantity - 120 AS peak_power_db,
  l_discount * 300 AS snr_db, l_returnflag || l_linestatus AS modulation_type, l_tax * 10 AS modulation_confidence, l_suppkey AS track_id,
  l_partkey % 12 AS cluster_id, l_linenumber / 8 AS duty_cycle, l_orderkey % 150 AS frames_seen, l_shipdate AS ts FROM lineitem)"""
