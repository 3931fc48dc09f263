"""Recordings as a set of SigMF files: record with a limit, annotate, list, find, delete, export; sources by name.

A recording is a data file and a meta file in one folder, or a collection of such segments.  Files are written by tasks through a
file system that all of them share (:mod:`.sink`); annotations are a table until a recording is written.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import Stored
from .captures import read_raw, read_sigmf, sigmf_catalogue, synthetic
from .ranges import register as register_iq
from .ranges import store_of
from .sink import finished, old_files, write_recordings

ANNOTATIONS = "name string, sample_start long, sample_count long, freq_lower_hz double, freq_upper_hz double, label string, comment string"


def within(blocks: DataFrame, seconds: float, key: str = "name", ts: str = "ts") -> DataFrame:
    """Blocks of each recording up to ``seconds`` after its first one: the limit is event time, so a replay gives the same."""
    first = blocks.groupBy(key).agg(F.min(ts).alias("__first"))
    age = F.timestamp_diff("MICROSECOND", F.col("__first"), F.col(ts)) / 1e6
    return blocks.join(first, key).where(age < seconds).drop("__first")


def record(blocks: DataFrame, path: str, seconds: float | None = None, annotations: DataFrame | None = None, description: str = "", overwrite: bool = False) -> DataFrame:
    """Write blocks (name, seq, sample_rate, center_freq_hz, i, q; ts with a limit) as recordings; name and samples of each.

    Tasks write ranges of blocks as parts (:mod:`.sink`), so a recording may be larger than any task's memory; then each
    recording becomes one data file, its annotations in its meta file.
    """
    kept = blocks if seconds is None else within(blocks, seconds)
    written = write_recordings(kept, path, description, overwrite=overwrite)
    return Stored(blocks.sparkSession).write(finished(blocks.sparkSession, path, annotations, description, written))


def record_stream(blocks: DataFrame, path: str, checkpoint: str, seconds: float):
    """A streaming query that keeps each recording's blocks up to its limit, as Parquet by recording under ``path``.

    The first time of each recording is kept as state; :func:`record` makes files of the table when it's finished.
    """
    import pandas as pd

    names = blocks.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)

    def keep(key, parts, state):
        del key
        rows = pd.concat(list(parts)).sort_values("ts")
        first = state.get[0] if state.exists else rows["ts"].iloc[0].value
        state.update((int(first),))
        yield rows[rows["ts"].map(lambda t: (t.value - first) / 1e9 < seconds)][names]

    limited = blocks.groupBy("name").applyInPandasWithState(keep, kinds, "first long", "append", "NoTimeout")
    return limited.writeStream.partitionBy("name").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")


def annotate(annotations: DataFrame, name: str, sample_start: int, sample_count: int, freq_lower_hz: float, freq_upper_hz: float, label: str, comment: str = "", active: frozenset[str] | None = None) -> DataFrame:
    """The table of annotations with one more row; where ``active`` is given, only for a recording that it names."""
    if active is not None and name not in active:
        raise ValueError(f"{name} isn't being recorded")
    row = annotations.sparkSession.createDataFrame([(name, sample_start, sample_count, freq_lower_hz, freq_upper_hz, label, comment)], ANNOTATIONS)
    return annotations.unionByName(row)


def annotate_detections(detections: DataFrame, rate: float) -> DataFrame:
    """Annotations of detections (name, t, seconds, center_freq_hz, bandwidth_hz, label)."""
    return detections.select("name", F.floor(F.col("t") * rate).alias("sample_start"), F.ceil(F.col("seconds") * rate).alias("sample_count"), (F.col("center_freq_hz") - F.col("bandwidth_hz") / 2).alias("freq_lower_hz"), (F.col("center_freq_hz") + F.col("bandwidth_hz") / 2).alias("freq_upper_hz"), "label", F.lit("").alias("comment"))


def find(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The catalogue's row of one recording; none if it doesn't exist."""
    return sigmf_catalogue(spark, path).where(F.col("name") == name)


def delete(path: str, name: str, active: frozenset[str] = frozenset()) -> bool:
    """Remove a recording's files, meta first; False if there are none.  One that is being written is refused."""
    if name in active:
        raise ValueError(f"{name} is being recorded")
    store, root = store_of(path.rstrip("/"))
    there = old_files(store, root, name)
    for f in there:
        store.delete_file(f)
    return bool(there)


def export_zip(names: DataFrame, path: str, to: str) -> DataFrame:
    """One archive ``to``/name.zip with all files of each recording named in ``names``, written by tasks; name and bytes.

    Files are copied through in pieces, so an archive may be larger than memory.
    """

    def run(batches):
        store, root = store_of(path.rstrip("/"))
        target, folder = store_of(to.rstrip("/"))
        for b in batches:
            sizes = []
            for name in b.column(0).to_pylist():
                with target.open_output_stream(f"{folder}/{name}.zip") as out:
                    counted = _Counted(out)
                    with zipfile.ZipFile(counted, "w", zipfile.ZIP_DEFLATED) as archive:
                        there = old_files(store, root, name)
                        if not there:
                            raise FileNotFoundError(f"no recording {name}")
                        for file in there:
                            with store.open_input_stream(file) as source, archive.open(file.rpartition("/")[2], "w", force_zip64=True) as entry:
                                while piece := source.read(1 << 20):
                                    entry.write(piece)
                sizes.append(counted.n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return names.select("name").mapInArrow(run, "name string, bytes long")


class _Counted(io.RawIOBase):
    """A stream that can only be written to; archives are then written without seeking."""

    def __init__(self, out):
        self.out, self.n = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.n += len(data)
        return len(data)


# -- sources by name -------------------------------------------------------------------------------
SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable:
    """Register a source of blocks: (spark, **options) -> DataFrame."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SOURCES[name] = f
        return f

    return register


source("sigmf")(lambda spark, path, **options: read_sigmf(spark, path, **options))
source("raw")(lambda spark, path, format, **options: read_raw(spark, path, format, **options))
source("synthetic")(lambda spark, **options: synthetic(spark, **options))


@source("growing")
def _growing(spark: SparkSession, path: str, format: str, **options) -> DataFrame:
    """A stream of the samples of files that are still written."""
    register_iq(spark)
    reader = spark.readStream.format("iq").option("format", format)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(path)


@source("live")
def _live(spark: SparkSession, path: str, **options) -> DataFrame:
    from ..streaming.state import iq_stream

    return iq_stream(spark, path, **options)


def open_source(spark: SparkSession, name: str, **options) -> DataFrame:
    """Blocks of a registered source; devices can't be opened from a cluster, their blocks land in files and are read as "live" (Parquet) or "growing" (raw samples)."""
    if name not in SOURCES:
        raise ValueError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](spark, **options)


def lost_samples(blocks: DataFrame, key: str = "capture_id", order: str = "seq") -> DataFrame:
    """Blocks with ``lost``, the blocks missing before each of them."""
    w = Window.partitionBy(key).orderBy(order)
    return blocks.withColumn("lost", F.greatest(F.lit(0), F.col(order) - F.lag(order).over(w) - 1))
