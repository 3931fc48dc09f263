"""Captures from files: raw sample formats, WAV, and SigMF recordings; synthetic samples.

Files are read by byte ranges (:mod:`.ranges`), so a file may be of any size and is read by many tasks.  In a store that only
Spark's readers reach, and for decoders registered without a sample size, a file is one row of Spark's binary reader, 2 GB at
most, until it's cut into blocks; decoding is an Arrow function on the bytes either way.
"""

from __future__ import annotations

import io
import json
import math
import wave
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Decoder = Callable[[bytes, dict], np.ndarray]
DECODERS: dict[str, Decoder] = {}


def decoder(name: str) -> Callable[[Decoder], Decoder]:
    """Register a decoder: (bytes, options) -> complex samples."""

    def register(f: Decoder) -> Decoder:
        DECODERS[name] = f
        return f

    return register


def _pairs(values: np.ndarray, options: dict) -> np.ndarray:
    """Complex samples of one channel; channels are interleaved sample by sample (or one after another in each half of IIQQ)."""
    channels, channel = int(options.get("channels", 1)), int(options.get("channel", 0))
    if not 0 <= channel < channels:
        raise ValueError(f"channel {channel} of {channels}")
    n = len(values) // (2 * channels)
    if options.get("layout", "IQIQ") == "IIQQ":
        halves = values[: 2 * n * channels].reshape(2, n, channels)
        return halves[0, :, channel] + 1j * halves[1, :, channel]
    pairs = values[: 2 * n * channels].reshape(n, channels, 2)
    return pairs[:, channel, 0] + 1j * pairs[:, channel, 1]


def _whole(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, len(data) // size).astype(float)


def _order(options: dict) -> str:
    return ">" if options.get("endian") == "big" else "<"


@decoder("cf32")
def _cf32(data: bytes, options: dict) -> np.ndarray:
    return _pairs(_whole(data, _order(options) + "f4"), options)


@decoder("cf64")
def _cf64(data: bytes, options: dict) -> np.ndarray:
    return _pairs(_whole(data, _order(options) + "f8"), options)


@decoder("ci16")
def _ci16(data: bytes, options: dict) -> np.ndarray:
    return _pairs(_whole(data, _order(options) + "i2"), options) / float(options.get("scale", 1.0))


@decoder("ci8")
def _ci8(data: bytes, options: dict) -> np.ndarray:
    return _pairs(_whole(data, "i1"), options) / float(options.get("scale", 1.0))


@decoder("u8")
def _u8(data: bytes, options: dict) -> np.ndarray:
    return _pairs(_whole(data, "u1") - float(options.get("offset", 128.0)), options) / float(options.get("scale", 1.0))


@decoder("wav")
def _wav(data: bytes, options: dict) -> np.ndarray:
    with wave.open(io.BytesIO(data)) as w:
        if w.getnchannels() != 2 or w.getsampwidth() != 2:
            raise ValueError("two channels of 16 bits are wanted")
        if options.get("rate") and int(options["rate"]) != w.getframerate():
            raise ValueError("the header's rate isn't the capture's")
        return _pairs(_whole(w.readframes(w.getnframes()), "<i2"), {}) / 32768.0


@decoder("ci32")
def _ci32(data: bytes, options: dict) -> np.ndarray:
    return _pairs(_whole(data, _order(options) + "i4"), options) / float(options.get("scale", 1.0))


@decoder("u16")
def _u16(data: bytes, options: dict) -> np.ndarray:
    return _pairs(_whole(data, _order(options) + "u2") - float(options.get("offset", 32768.0)), options) / float(options.get("scale", 1.0))


#: Declared formats, the decoders that read them, and their options where they differ.
FORMATS = {
    "ci8": ("ci8", {}), "ci16": ("ci16", {}), "ci32": ("ci32", {}), "cf32": ("cf32", {}), "cf64": ("cf64", {}), "u8": ("u8", {}), "u16": ("u16", {}), "wav_iq": ("wav", {}),
    "complex64": ("cf32", {}), "gr_complex64": ("cf32", {}), "hackrf_raw": ("ci8", {"scale": 128.0}), "rtlsdr_u8": ("u8", {"offset": 127.5, "scale": 127.5}),
}


@dataclass(frozen=True)
class Capture:
    """How the samples of a capture are encoded."""

    format: str
    sample_rate_hz: int
    center_frequency_hz: int | None = None
    endianness: str = "little"
    interleaving: str = "IQIQ"
    scale_factor: float | None = None
    num_channels: int = 1
    channel: int = 0
    iq_offset: float | None = None

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ValueError(f"no format {self.format}; there are {', '.join(sorted(FORMATS))}")
        if self.sample_rate_hz <= 0 or (self.center_frequency_hz is not None and self.center_frequency_hz <= 0) or not 0 <= self.channel < self.num_channels:
            raise ValueError("sample rate, centre frequency or channel out of range")
        if self.endianness not in ("little", "big") or self.interleaving not in ("IQIQ", "IIQQ"):
            raise ValueError("endianness is little or big, interleaving IQIQ or IIQQ")

    @property
    def decoder(self) -> tuple[str, dict]:
        """The decoder's name and its options."""
        name, own = FORMATS[self.format]
        given = {"scale": self.scale_factor, "offset": self.iq_offset, "rate": self.sample_rate_hz if name == "wav" else None}
        return name, {**own, "endian": self.endianness, "layout": self.interleaving, "channels": self.num_channels, "channel": self.channel, **{k: v for k, v in given.items() if v is not None}}

    def read(self, spark: SparkSession, path: str, block: int = 65_536) -> DataFrame:
        """Blocks of the files under ``path``, with rate and centre."""
        name, options = self.decoder
        out = read_raw(spark, path, name, block=block, **options)
        return out.withColumns({"sample_rate_hz": F.lit(float(self.sample_rate_hz)), "center_freq_hz": F.lit(None if self.center_frequency_hz is None else float(self.center_frequency_hz)).cast("double")})


def guess_format(content: Column, mode: str = "standard") -> Column:
    """Format by content and length; mode "reference" says u8 for every file."""
    if mode == "reference":
        return F.lit("u8")
    n = F.length(content)
    return F.when(F.substring(content, 1, 4) == F.lit(b"RIFF"), "wav").when(n % 8 == 0, "cf32").when(n % 4 == 0, "ci16").otherwise("u8")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays as one Arrow list column, without Python numbers."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0)))


def decode(df: DataFrame, format: str | dict[str, tuple[str, dict]], block: int = 65_536, content: str = "content", keep: tuple[str, ...] = ("path",), format_col: str | None = None, **options) -> DataFrame:
    """``keep``, seq, i and q: the samples of each row's bytes in blocks.

    ``format`` is a decoder's name, or maps the values of ``format_col`` to decoders and options; rows with another
    value are left out.
    """
    kinds = {None: (format, options)} if isinstance(format, str) else format
    for name, _ in kinds.values():
        if name not in DECODERS:
            raise ValueError(f"no decoder for {name}; there are {', '.join(sorted(DECODERS))}")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                kind = b.column(len(keep) + 1)[r].as_py() if format_col else None
                if kind not in kinds:
                    continue
                name, chosen = kinds[kind]
                x = DECODERS[name](b.column(len(keep))[r].as_py() or b"", chosen)
                count = max(1, -(-len(x) // block))
                for first in range(0, count, 64):
                    n = min(64, count - first)
                    parts = [x[k * block : (k + 1) * block] for k in range(first, first + n)]
                    fixed = [pa.array([b.column(k)[r].as_py()] * n, b.schema.field(k).type) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(first, first + n), pa.int64()), _lists([p.real for p in parts]), _lists([p.imag for p in parts])], names=[*keep, "seq", "i", "q"])

    from pyspark.sql.types import StructType

    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL("seq long, i array<double>, q array<double>").fields])
    return df.select(*keep, content, *([format_col] if format_col else [])).mapInArrow(run, schema)


def read_raw(spark: SparkSession, path: str, format: str, block: int = 65_536, **options) -> DataFrame:
    """Blocks (path, seq, sample_start, i, q) of the files under ``path``."""
    from . import ranges

    if format in ranges.PAIR_BYTES and ranges.readable(path):
        return ranges.read_files(spark, path, format, block, **options)
    whole = decode(spark.read.format("binaryFile").load(path), format, block, **options)
    return whole.select("path", "seq", (F.col("seq") * block).alias("sample_start"), "i", "q")


# -- SigMF -----------------------------------------------------------------------------------------
#: SigMF data types and their decoders.
SIGMF_TYPES = {"cf32_le": ("cf32", {}), "cf32_be": ("cf32", {"endian": "big"}), "ci16_le": ("ci16", {}), "ci16_be": ("ci16", {"endian": "big"}), "cu8": ("u8", {}), "ci8": ("ci8", {})}
_META = "`global` struct<`core:datatype`: string, `core:sample_rate`: double, `core:version`: string, `core:description`: string, `core:offset`: bigint, `core:collection`: string>, captures array<struct<`core:sample_start`: bigint, `core:frequency`: double>>, annotations array<struct<`core:sample_start`: bigint, `core:sample_count`: bigint, `core:freq_lower_edge`: double, `core:freq_upper_edge`: double, `core:label`: string, `core:comment`: string>>"


def _stem(column: Column) -> Column:
    return F.regexp_extract(column, r"([^/]+)\.sigmf-(?:meta|data)$", 1)


def sigmf_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row for each data file that has a meta file: name, path, datatype, rate, centre, size, samples, first_sample, annotations.

    A recording in several segments has a row for each: their name is that of their collection, and ``first_sample`` is a
    segment's place in the recording.
    """
    meta = spark.read.schema(_META).option("multiLine", True).json(f"{path}/*.sigmf-meta").select(_stem(F.col("_metadata.file_path")).alias("stem"), "*")
    data = spark.read.format("binaryFile").load(f"{path}/*.sigmf-data").select(_stem(F.col("path")).alias("stem"), "path", "length")
    size = F.when(F.col("datatype").startswith("cf32"), 8).when(F.col("datatype").startswith("ci16"), 4).otherwise(2)
    own = F.col("global")
    split = own["core:collection"].isNotNull()
    joined = meta.join(data, "stem").select(F.coalesce(own["core:collection"], "stem").alias("name"), "path", "length", own["core:datatype"].alias("datatype"), own["core:sample_rate"].alias("sample_rate"), F.element_at("captures", 1)["core:frequency"].alias("center_freq_hz"), F.coalesce(own["core:offset"], F.lit(0)).alias("first_sample"), "annotations", split.alias("__split"))
    # segments that have been joined to one file count no more
    whole = meta.where(~split).select(F.col("stem").alias("name"), F.lit(True).alias("__split"))
    return joined.join(whole, ["name", "__split"], "left_anti").drop("__split").withColumn("n_samples", F.floor(F.col("length") / size))


def read_sigmf(spark: SparkSession, path: str, block: int = 65_536) -> DataFrame:
    """Blocks (name, sample_rate, center_freq_hz, seq, sample_start, i, q) of all recordings under ``path``.

    ``sample_start`` is a block's place in its recording and seq the block of that place.
    """
    from . import ranges

    known, keep = sigmf_catalogue(spark, path), ("name", "sample_rate", "center_freq_hz")
    if ranges.readable(path):
        return ranges.read_ranges(known, SIGMF_TYPES, block, keep)
    data = spark.read.format("binaryFile").load(f"{path}/*.sigmf-data").select("path", "content").join(known.drop("length"), "path")
    start = F.col("first_sample") + F.col("seq") * block
    whole = decode(data, SIGMF_TYPES, block, keep=(*keep, "first_sample"), format_col="datatype")
    return whole.select(*keep, F.floor(start / block).alias("seq"), start.alias("sample_start"), "i", "q")


_NOTE_KEYS = {"sample_start": "core:sample_start", "sample_count": "core:sample_count", "freq_lower_hz": "core:freq_lower_edge", "freq_upper_hz": "core:freq_upper_edge", "label": "core:label", "comment": "core:comment"}


def sigmf_meta(rate: float | None, center: float | None, description: str = "", notes=(), **more) -> bytes:
    """A meta file; ``more`` are further global fields, without their prefix."""
    marks = [{_NOTE_KEYS[c]: v for c, v in note.items() if v is not None} for note in notes or ()]
    own = {"datatype": "cf32_le", "sample_rate": rate, "version": "1.0.0", "description": description, **more}
    meta = {"global": {f"core:{k}": v for k, v in own.items()}, "captures": [{"core:sample_start": 0, "core:frequency": center}], "annotations": marks}
    return json.dumps(meta, indent=2).encode("utf-8")


def write_sigmf(df: DataFrame, path: str, description: str = "", annotations: DataFrame | None = None) -> DataFrame:
    """Write each row (name, sample_rate, center_freq_hz, i, q) as a recording; returns name and samples written.

    ``annotations`` (name, sample_start, sample_count, freq_lower_hz, freq_upper_hz, label, comment) go into the
    meta files.  Tasks write through a file system that all of them share (a path or URI that Arrow understands), data
    before meta, so a recording with a meta file is complete.
    """
    if annotations is None:
        rows = df.withColumn("__notes", F.array().cast("array<struct<sample_start: bigint>>"))
    else:
        notes = annotations.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("sample_start", "sample_count", "freq_lower_hz", "freq_upper_hz", "label", "comment"))).alias("__notes"))
        rows = df.join(notes, "name", "left")
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for b in batches:
            names, counts = b.column(0).to_pylist(), []
            for k, (name, rate, center, noted) in enumerate(zip(names, *(b.column(c).to_pylist() for c in (1, 2, 5)))):
                i, q = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                pairs = np.stack([i.astype("<f4"), q.astype("<f4")], axis=1)
                with store.open_output_stream(f"{root}/{name}.sigmf-data") as f:
                    f.write(pairs.tobytes())
                with store.open_output_stream(f"{root}/{name}.sigmf-meta") as f:
                    f.write(sigmf_meta(rate, center, description, noted))
                counts.append(len(pairs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["name", "n_samples"])

    return rows.select("name", F.col("sample_rate").cast("double"), F.col("center_freq_hz").cast("double"), "i", "q", "__notes").mapInArrow(run, "name string, n_samples long")


# -- synthetic -------------------------------------------------------------------------------------
#: Offsets in Hz and levels in dBFS.  Fixed values.
TONES = ((0.0, -30.0), (100e3, -40.0), (-250e3, -45.0), (500e3, -50.0), (1e6, -55.0), (-2e6, -60.0))


def synthetic(spark: SparkSession, blocks: int | DataFrame, size: int, rate: float, tones=TONES, noise_db: float = -90.0, seed: int = 7, noise: str = "uniform") -> DataFrame:
    """Blocks (seq, i, q) of tones and noise from closed forms: a block only depends on its number.

    ``blocks`` is their number, or a table of block numbers ``seq``.
    ``noise`` is "uniform" or "gaussian" (Box-Muller; the level is then the deviation of i and q).
    """
    if noise not in ("uniform", "gaussian"):
        raise ValueError("noise is uniform or gaussian")
    n = F.sequence(F.lit(0), F.lit(size - 1))
    level = 10 ** (noise_db / 20)

    def part(wave_of, salt: int) -> Column:
        def sample(k):
            t = (F.col("seq") * size + k) / rate
            tone = sum((F.lit(10 ** (db / 20)) * wave_of(F.lit(2 * math.pi * hz) * t) for hz, db in tones), F.lit(0.0))
            unit = lambda more: F.pmod(F.xxhash64(F.col("seq"), k, F.lit(seed + more)), F.lit(1 << 30)) / float(1 << 30)
            if noise == "gaussian":  # both parts come from the same two numbers
                return tone + F.lit(level) * F.sqrt(-2 * F.log(1 - unit(2))) * wave_of(F.lit(2 * math.pi) * unit(3))
            return tone + F.lit(level) * (2 * unit(salt) - 1)

        return F.transform(n, sample)

    numbers = spark.range(blocks).select(F.col("id").alias("seq")) if isinstance(blocks, int) else blocks
    return numbers.select("seq", part(F.cos, 0).alias("i"), part(F.sin, 1).alias("q"))
