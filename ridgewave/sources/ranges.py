"""Captures by byte ranges: a Python data source for batches and streams, and the same reading for tables of ranges.

A capture file of any size is planned as ranges of whole blocks, and a task reads its own range piece by piece; no task
holds a file.  Paths are local ones of a folder that all workers share, or URIs that Arrow's file systems know; for other
stores :func:`readable` says no, and callers read whole files with Spark's binary reader.

    register(spark)
    spark.read.format("iq").option("format", "ci16").option("block", 65536).load("captures/*.iq")
    spark.readStream.format("iq").option("format", "cf32").load("landing/")

Columns: path, seq (block of its file), sample_start, i, q.  Bytes after the last whole sample are left out, as when a file is
decoded whole.
"""

from __future__ import annotations

import fnmatch
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .captures import DECODERS, FORMATS

#: Bytes of a sample of one channel.
PAIR_BYTES = {"cf32": 8, "cf64": 16, "ci32": 8, "ci16": 4, "u16": 4, "ci8": 2, "u8": 2, "wav": 4}
#: Bytes of a task's range and of a piece of it, about.
RANGE_BYTES, PIECE_BYTES = 128 << 20, 8 << 20
SCHEMA = "path string, seq long, sample_start long, i array<double>, q array<double>"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def readable(path: str) -> bool:
    """Whether Arrow knows the store of ``path``."""
    try:
        store_of(path)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's files, or of those that a pattern in the last part names; hidden ones are left out."""
    store, inner = store_of(path)
    path, inner = path.rstrip("/"), inner.rstrip("/")
    scheme = path[: -len(inner)] if path.endswith(inner) and path != inner else "file:"
    parent, _, last = inner.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(parent or "/")) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(info.path))
    return sorted((f"{scheme}{f.path}", f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


@dataclass(frozen=True)
class Layout:
    """How a file's samples lie in it."""

    decoder: str
    options: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, name: str, options: dict) -> Layout:
        """Of a declared format or a decoder, with the decoder's options."""
        decoder, own = FORMATS.get(name, (name, {}))
        if decoder not in DECODERS:
            raise ValueError(f"no decoder for {name}; there are {', '.join(sorted(DECODERS))}")
        if decoder not in PAIR_BYTES:
            raise ValueError(f"{name} can't be read in parts")
        given = {k: str(v) for k, v in {**own, **options}.items() if k in ("endian", "layout", "channels", "channel", "scale", "offset", "rate") and v is not None}
        return cls(decoder, tuple(sorted(given.items())))

    @property
    def frame(self) -> int:
        """Bytes of one sample of all channels."""
        return PAIR_BYTES[self.decoder] * int(dict(self.options).get("channels", 1))

    def data(self, path: str, size: int) -> tuple[int, int]:
        """First byte and whole samples of a file's data."""
        if self.decoder != "wav":
            return 0, size // self.frame
        store, inner = store_of(path)
        with store.open_input_file(inner) as f:
            return _wav_data(f, size, dict(self.options).get("rate"))

    def read(self, f: pa.NativeFile, start: int, total: int, first: int, count: int) -> np.ndarray:
        """Samples ``first`` to ``first + count`` of a file whose data has ``total`` samples from byte ``start``."""
        options = dict(self.options)
        if self.decoder == "wav":
            return DECODERS["ci16"](f.read_at(4 * count, start + 4 * first), {"scale": 32768.0})
        if options.get("layout") == "IIQQ":
            half = self.frame // 2
            parts = [f.read_at(half * count, start + half * (first + at)) for at in (0, total)]
            return DECODERS[self.decoder](b"".join(parts), options)
        return DECODERS[self.decoder](f.read_at(self.frame * count, start + self.frame * first), options)


def _wav_data(f: pa.NativeFile, size: int, rate: str | None) -> tuple[int, int]:
    head = f.read_at(12, 0)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, shape = 12, None
    while at + 8 <= size:
        kind, length = struct.unpack("<4sI", f.read_at(8, at))
        if kind == b"fmt ":
            _, channels, own_rate, _, _, bits = struct.unpack("<HHIIHH", f.read_at(16, at + 8))
            shape = (channels, bits)
            if rate and int(float(rate)) != own_rate:
                raise ValueError("the header's rate isn't the capture's")
        if kind == b"data":
            if shape != (2, 16):
                raise ValueError("two channels of 16 bits are wanted")
            return at + 8, min(length, size - at - 8) // 4
        at += 8 + length + length % 2
    raise ValueError("a WAV file without data")


@dataclass
class Range(InputPartition):
    """Samples ``first`` to ``last`` of a file."""

    path: str
    start: int
    total: int
    first: int
    last: int

    def __post_init__(self):
        self.value = (self.path, self.first, self.last)


def blocks_of(layout: Layout, part: Range, block: int, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first sample, blocks) of a range, piece by piece."""
    store, inner = store_of(part.path)
    step = block * max(1, piece_bytes // (layout.frame * block))
    with store.open_input_file(inner) as f:
        for at in range(part.first, part.last, step):
            x = layout.read(f, part.start, part.total, at, min(step, part.last - at))
            yield at, [x[k : k + block] for k in range(0, len(x), block)]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(np.concatenate(parts))))


def _batches(layout: Layout, part: Range, block: int) -> Iterator[pa.RecordBatch]:
    for at, parts in blocks_of(layout, part, block):
        starts = at + block * np.arange(len(parts), dtype=np.int64)
        columns = [pa.array([part.path] * len(parts)), pa.array(starts // block), pa.array(starts), _lists([p.real for p in parts]), _lists([p.imag for p in parts])]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "seq", "sample_start", "i", "q"])


def cut(path: str, start: int, total: int, first: int, last: int, per: int) -> list[Range]:
    """Ranges of about ``per`` samples, cut at multiples of it."""
    edges = [first, *range((first // per + 1) * per, last, per), last]
    return [Range(path, start, total, a, b) for a, b in zip(edges, edges[1:]) if b > a]


class IqSource(DataSource):
    """``iq``: options format, block, range_bytes, sample_start, sample_count, partial, and the decoder's own."""

    @classmethod
    def name(cls) -> str:
        return "iq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> IqReader:
        return IqReader(dict(self.options))

    def streamReader(self, schema: StructType) -> IqStreamReader:
        return IqStreamReader(dict(self.options))


class _Planned:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.layout = Layout.of(options.get("format", "cf32"), options)
        self.block = int(options.get("block", 65_536))
        if self.block < 1:
            raise ValueError("a block has one sample at least")
        self.per = self.block * max(1, int(options.get("range_bytes", RANGE_BYTES)) // (self.layout.frame * self.block))
        self.options = options

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _batches(self.layout, partition, self.block)  # None where there are no samples


class IqReader(_Planned, DataSourceReader):
    """All samples, or ``sample_count`` from ``sample_start`` on, of each file; a part of a file starts a block at its first sample's block."""

    def partitions(self) -> list[Range]:
        first = int(self.options.get("sample_start", 0)) // self.block * self.block
        out = []
        for path, size in files(self.path):
            start, total = self.layout.data(path, size)
            last = min(total, int(self.options.get("sample_start", 0)) + int(self.options["sample_count"])) if "sample_count" in self.options else total
            out += cut(path, start, total, first, last, self.per)
        return out


class IqStreamReader(_Planned, DataSourceStreamReader):
    """Samples as files of a folder grow.

    The offset is the number of samples read of each file, so a query that is started again goes on where its checkpoint says.  Blocks
    come when they are whole; with ``partial`` what there is comes at once, in shorter blocks whose ``sample_start`` tells their place.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        if self.layout.decoder == "wav" or dict(self.layout.options).get("layout") == "IIQQ":
            raise ValueError("a file that is still written has no fixed places for WAV data or halves")
        self.unit = 1 if str(options.get("partial", "false")).lower() == "true" else self.block

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: n for path, size in files(self.path) if (n := size // self.layout.frame // self.unit * self.unit)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path, n in sorted(end.items()) for r in cut(path, 0, n, start.get(path, 0), n, self.per)]


def register(spark: SparkSession) -> None:
    """Make ``iq`` a format of this session."""
    spark.dataSource.register(IqSource)


def read_files(spark: SparkSession, path: str, format: str, block: int = 65_536, **options) -> DataFrame:
    """Blocks of the files under ``path``."""
    register(spark)
    reader = spark.read.format("iq").option("format", format).option("block", block)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load(path)


def read_ranges(known: DataFrame, kinds: dict[str, tuple[str, dict]], block: int = 65_536, keep: tuple[str, ...] = (), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``keep``, seq, sample_start, i and q of files listed in a table (path, length, datatype, first_sample).

    Files become ranges by arithmetic on their lengths and are dealt over the tasks, so many files need no planning on
    the driver.  ``first_sample`` is where a file's samples lie in their recording.  Rows of an unknown type are left out.
    """
    layouts = {k: Layout.of(name, options) for k, (name, options) in kinds.items()}
    frame = F.create_map(*(F.lit(v) for k, x in layouts.items() for v in (k, x.frame)))[F.col("datatype")]
    sized = known.where(F.col("datatype").isin(list(layouts))).withColumn("__total", F.floor(F.col("length") / frame)).withColumn("__per", block * F.greatest(F.lit(1), F.floor(F.lit(range_bytes) / (frame * block))))
    n = max(1, int(sized.agg(F.sum(F.ceil(F.col("__total") / F.col("__per")))).first()[0] or 0))
    spread = sized.select(*keep, "path", "datatype", "first_sample", "__total", "__per", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("__total") / F.col("__per")) - 1))).alias("__k")).where("__total > 0")
    dealt = spread.repartition(min(n, 100_000), "path", "__k")
    schema = StructType([*(known.schema[c] for c in keep), *StructType.fromDDL("seq long, sample_start long, i array<double>, q array<double>").fields])

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                path, kind, offset, total, per, k = (b.column(len(keep) + c)[r].as_py() for c in range(6))
                for part in _batches(layouts[kind], Range(path, 0, total, k * per, min(total, (k + 1) * per)), block):
                    starts = pa.array(part.column("sample_start").to_numpy() + offset)
                    fixed = [pa.array([b.column(c)[r].as_py()] * part.num_rows, b.schema.field(c).type) for c in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(starts.to_numpy() // block), starts, part.column("i"), part.column("q")], names=schema.names)

    return dealt.select(*keep, "path", "datatype", "first_sample", "__total", "__per", "__k").mapInArrow(run, schema)
