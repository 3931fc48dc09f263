"""Binary and JSON messages: headers, quantised spectra, sample pairs, event objects."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import per_row

#: Headers, little-endian.  Fixed values.
SPECTRUM_V1 = "<dffHH"  # time, centre, span, bins, flags
SPECTRUM_V2 = "<dddI"  # time, centre, span, bins
IQ_FLOAT = "<dffI"  # time, centre, rate, samples
IQ_SHORT = "<dffII"  # time, centre, rate, samples, flags
BURST_MAGIC, BURST = 0x56414C52, "<IIQQIIQII16s"  # magic, version, sequence, time, samples, format, centre, rate, flags
FRAME_SHORT, FRAME_FLOAT = np.dtype([("t", "<u8"), ("i", "<i2"), ("q", "<i2")]), np.dtype([("t", "<u8"), ("i", "<f4"), ("q", "<f4")])
BURST_FLAGS = {"overflow": 1, "underflow": 2, "pps_locked": 4, "gpsdo_locked": 8, "time_valid": 16, "adc_overload": 32}


def quantize(db: np.ndarray) -> np.ndarray:
    """dB from -120 to -20 as bytes, truncating."""
    return np.clip((db + 120) / 100 * 255, 0, 255).astype(np.uint8)


def dequantize(level: np.ndarray) -> np.ndarray:
    return level / 255.0 * 100 - 120


def quantize_column(db: Column) -> Column:
    """:func:`quantize` of an array column, as small integers."""
    return F.transform(db, lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x + 120) / 100 * 255))).cast("smallint"))


def dequantize_column(level: Column) -> Column:
    return F.transform(level, lambda v: v / 255.0 * 100 - 120)


def spectrum_message(time: float, center: float, span: float, db: np.ndarray, version: int = 2) -> bytes:
    head = struct.pack(SPECTRUM_V2, time, center, span, len(db)) if version == 2 else struct.pack(SPECTRUM_V1, time, center, span, len(db), 0)
    return head + quantize(db).tobytes()


def parse_spectrum(data: bytes, version: int = 2) -> tuple[float, float, float, np.ndarray]:
    form = SPECTRUM_V2 if version == 2 else SPECTRUM_V1
    size = struct.calcsize(form)
    if len(data) < size:
        raise ValueError("short message")
    time, center, span, n, *_ = struct.unpack_from(form, data)
    if len(data) != size + n:
        raise ValueError("message length doesn't match its header")
    return time, center, span, np.frombuffer(data, np.uint8, n, size)


def iq_message(time: float, center: float, rate: float, x: np.ndarray, short: bool = False) -> bytes:
    pairs = np.stack([x.real, x.imag], axis=1).ravel()
    if short:
        return struct.pack(IQ_SHORT, time, center, rate, len(x), 0) + np.clip(pairs * 32767, -32768, 32767).astype("<i2").tobytes()
    return struct.pack(IQ_FLOAT, time, center, rate, len(x)) + pairs.astype("<f4").tobytes()


def parse_iq(data: bytes, short: bool = False) -> tuple[float, float, float, np.ndarray]:
    form = IQ_SHORT if short else IQ_FLOAT
    size = struct.calcsize(form)
    time, center, rate, n, *_ = struct.unpack_from(form, data)
    kind, scale = ("<i2", 32767.0) if short else ("<f4", 1.0)
    pairs = np.frombuffer(data, kind, 2 * n, size).astype(float) / scale
    return time, center, rate, pairs[::2] + 1j * pairs[1::2]


def decimated_pairs(i: Column, q: Column, most: int = 256) -> Column:
    """At most ``most`` pairs, every (length / most)-th one."""
    step = F.greatest(F.lit(1), F.floor(F.size(i) / most)).cast("int")
    return F.slice(F.filter(F.arrays_zip(i, q), lambda x, k: k % step == 0), 1, most)


def encode_spectra(df: DataFrame, time: str, center: str, span: str, db: str, keep: tuple[str, ...] = ("frame_id",), version: int = 2) -> DataFrame:
    """``keep`` and the binary message of each frame."""

    def run(batches):
        for b in batches:
            n = len(keep)
            rows = zip(*(b.column(n + k).to_pylist() for k in range(4)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([spectrum_message(t, c, s, np.array(x, float), version) for t, c, s, x in rows], pa.binary())], names=[*b.schema.names[:n], "message"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*(df.schema[c] for c in keep), StructField("message", BinaryType())])
    return df.select(*keep, F.col(time).cast("double"), F.col(center).cast("double"), F.col(span).cast("double"), db).mapInArrow(run, schema)


def decode_spectra(df: DataFrame, message: str = "message", keep: tuple[str, ...] = ("frame_id",), version: int = 2) -> DataFrame:
    """``keep``, time, center, span and levels; a message that can't be read gives nulls and its error."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for data in b.column(len(keep)).to_pylist():
                try:
                    t, c, s, x = parse_spectrum(data or b"", version)
                    out.append((t, c, s, x.tolist(), None))
                except (ValueError, struct.error) as e:
                    out.append((None, None, None, None, str(e)))
            cols = list(zip(*out)) or [()] * 5
            types = (pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int16()), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(c, t) for c, t in zip(cols, types))], names=[*b.schema.names[: len(keep)], "time", "center_freq_hz", "span_hz", "levels", "error"])

    from pyspark.sql.types import StructType

    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL("time double, center_freq_hz double, span_hz double, levels array<smallint>, error string").fields])
    return df.select(*keep, message).mapInArrow(run, schema)


def encode_iq(df: DataFrame, time: str, center: str, rate: str, keep: tuple[str, ...] = ("frame_id",), short: bool = False) -> DataFrame:
    """``keep`` and the binary message of each row's samples (i, q)."""
    def kernel(t, c, r, i, q):
        return (iq_message(t, c, r, i + 1j * q, short),)

    cast = df.select(*keep, *(F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate((time, center, rate))), "i", "q")
    return per_row(cast, kernel, ("__0", "__1", "__2", "i", "q"), "message binary", keep).drop("error")


def decode_iq(df: DataFrame, message: str = "message", keep: tuple[str, ...] = ("frame_id",), short: bool = False) -> DataFrame:
    """``keep``, time, center_freq_hz, sample_rate_hz, i and q of each message; nulls and the reason for one that can't be read."""
    def kernel(data):
        try:
            t, c, r, x = parse_iq(data, short)
        except struct.error as e:
            raise ValueError(str(e)) from e
        return t, c, r, x.real.tolist(), x.imag.tolist()

    return per_row(df, kernel, (message,), "time double, center_freq_hz double, sample_rate_hz double, i array<double>, q array<double>", keep)


def burst(version: int, sequence: int, time_ns: int, kind: int, center: int, rate: int, flags: int, times: np.ndarray, x: np.ndarray) -> bytes:
    """A burst header and its packed sample frames; ``kind`` 0 is 16-bit integers, anything else 32-bit floats."""
    frames = np.empty(len(x), FRAME_SHORT if kind == 0 else FRAME_FLOAT)
    scale = 32768.0 if kind == 0 else 1.0
    frames["t"], frames["i"], frames["q"] = times, x.real * scale, x.imag * scale
    return struct.pack(BURST, BURST_MAGIC, version, sequence, time_ns, len(x), kind, center, rate, flags, b"") + frames.tobytes()


def parse_burst(data: bytes) -> tuple[int, int, int, int, int, int, int, np.ndarray, np.ndarray]:
    """Version, sequence, time, kind, centre, rate, flags, times in ns and samples of a burst."""
    if len(data) < struct.calcsize(BURST):
        raise ValueError("short burst")
    magic, version, sequence, time_ns, n, kind, center, rate, flags, _ = struct.unpack_from(BURST, data)
    if magic != BURST_MAGIC:
        raise ValueError(f"magic 0x{magic:08X}, 0x{BURST_MAGIC:08X} is wanted")
    layout = FRAME_SHORT if kind == 0 else FRAME_FLOAT
    if len(data) < struct.calcsize(BURST) + n * layout.itemsize:
        raise ValueError("burst is cut off")
    frames = np.frombuffer(data, layout, n, struct.calcsize(BURST))
    scale = 1 / 32768.0 if kind == 0 else 1.0
    return version, sequence, time_ns, kind, center, rate, flags, frames["t"], (frames["i"].astype(float) + 1j * frames["q"].astype(float)) * scale


def unpack_bursts(df: DataFrame, data: str = "data", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``keep``, the header's fields, t_ns, i and q of each burst; nulls and the reason for one that can't be read."""
    def kernel(raw):
        version, sequence, time_ns, kind, center, rate, flags, times, x = parse_burst(raw)
        return version, sequence, time_ns, kind, center, rate, flags, times.astype(np.int64).tolist(), x.real.tolist(), x.imag.tolist()

    outputs = "version long, sequence long, time_ns long, kind long, center_freq_hz long, sample_rate_hz long, flags long, t_ns array<bigint>, i array<double>, q array<double>"
    return per_row(df, kernel, (data,), outputs, keep)


# -- JSON ------------------------------------------------------------------------------------------
def detection_json(time: Column) -> Column:
    """A detection event: Hz truncated, dB to two places, confidence to four, others to three; null keys are left out."""
    data = F.struct(
        F.col("detection_id"),
        *(F.col(c).cast("long").alias(c) for c in ("center_freq_hz", "bandwidth_hz", "bandwidth_3db_hz", "bandwidth_6db_hz")),
        *(F.round(c, 2).alias(c) for c in ("peak_power_db", "snr_db")),
        F.col("modulation_type"),
        F.round("modulation_confidence", 4).alias("modulation_confidence"),
        F.col("track_id"),
        F.round("duty_cycle", 3).alias("duty_cycle"),
        F.col("frames_seen"),
        F.col("cluster_id"),
    )
    return F.to_json(F.struct(F.lit("detection").alias("type"), time.alias("timestamp"), data.alias("data")))


def spectrum_json(time: Column, center: Column, rate: Column, db: Column) -> Column:
    """A spectrum with the frequency of each bin."""
    n = F.size(db)
    bins = F.transform(F.sequence(F.lit(0), n - 1), lambda k: center - rate / 2 + k * (rate / n))
    return F.to_json(F.struct(F.lit("spectrum").alias("type"), time.alias("timestamp"), center.cast("long").alias("centerFreqHz"), rate.cast("long").alias("sampleRateHz"), n.alias("fftSize"), db.alias("magnitudeDb"), bins.alias("frequencyBins")))


def packet_json(time: Column, channel: Column, mhz: Column, address: Column, pdu: Column, payload: Column, crc_valid: Column) -> Column:
    """A low-energy packet event; the address in hexadecimal, the payload as hexadecimal digits."""
    data = F.struct(channel.alias("channel"), (mhz.cast("long") * 1_000_000).alias("centerFreqHz"), F.concat(F.lit("0x"), F.lpad(F.hex(address), 8, "0")).alias("accessAddress"), pdu.alias("pduType"), F.lower(F.hex(payload)).alias("payloadHex"), crc_valid.alias("crcValid"))
    return F.to_json(F.struct(F.lit("ble_packet").alias("type"), time.alias("timestamp"), data.alias("data")))


def chirp_json(time: Column, center: Column, sf: int, bandwidth: float, symbols: Column, snr: Column) -> Column:
    """A chirp frame event; symbols as hexadecimal bytes."""
    payload = F.array_join(F.transform(symbols, lambda s: F.lpad(F.lower(F.hex(s)), 2, "0")), "")
    data = F.struct(center.cast("long").alias("centerFreqHz"), F.lit(sf).alias("spreadingFactor"), F.lit(int(bandwidth)).alias("bandwidthHz"), F.lit("4/5").alias("codingRate"), payload.alias("payloadHex"), F.round(snr, 2).alias("snrDb"))
    return F.to_json(F.struct(F.lit("lora_frame").alias("type"), time.alias("timestamp"), data.alias("data")))


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines in camelCase, one file a partition."""
    camel_case(df).write.mode("overwrite").json(path)


def stats_json(processed: Column, dropped: Column) -> Column:
    """Counters with their drop rate."""
    rate = F.when(processed + dropped > 0, F.round(dropped / (processed + dropped), 6)).otherwise(F.lit(0.0))
    return F.to_json(F.struct(processed.alias("samplesProcessed"), dropped.alias("samplesDropped"), rate.alias("dropRate")))


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def camel_case(df: DataFrame) -> DataFrame:
    """Columns and nested fields renamed from snake_case to camelCase."""
    from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

    def renamed(t: DataType) -> DataType:
        if isinstance(t, StructType):
            return StructType([StructField(camel(f.name), renamed(f.dataType), f.nullable) for f in t.fields])
        if isinstance(t, ArrayType):
            return ArrayType(renamed(t.elementType), t.containsNull)
        if isinstance(t, MapType):
            return MapType(t.keyType, renamed(t.valueType), t.valueContainsNull)
        return t

    return df.select(*(F.col(f"`{f.name}`").cast(renamed(f.dataType)).alias(camel(f.name)) for f in df.schema.fields))


def safe_file_name(name: Column) -> Column:
    """Letters, digits, dots, hyphens and underscores stay, anything else becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")
