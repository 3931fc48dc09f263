"""Recordings as a data-source writer: parts by tasks, commit messages, and a commit by the driver that makes them visible.

    register(spark)
    blocks.repartitionByRange(200, "name", "seq").sortWithinPartitions("name", "seq").write.format("sigmf").mode("append").save("recordings/")

Blocks (name, seq, sample_rate, center_freq_hz, i, q) of any number and order go in.  A task streams them into part files
under ``_parts/<job>``, one for each run of ascending blocks of a recording, so it holds one batch of blocks, and its message
lists its parts.  When all tasks are done, the driver knows each recording's parts from the messages (not their samples) and
their order by block number:

* a recording in one part becomes ``name.sigmf-data`` and ``name.sigmf-meta``;
* a recording in several parts becomes segments ``name-000000``, ``name-000001``, ..., each a recording of its own whose meta file
  tells its ``core:offset``, and ``name.sigmf-collection`` that lists them, as the format has it for split recordings.

Data files get their names first, then meta files are written, the collection last.  Readers go by meta files, so neither a
killed task nor a failed job leaves half a recording in sight; a failed job's parts are removed.  Blocks that two parts have
both (a repeated block number) fail the commit, and so does a name that is there already unless the mode is overwrite.
:func:`joined` makes one file of a recording's segments, piece by piece, in tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .captures import sigmf_catalogue, sigmf_meta
from .ranges import store_of

NEEDED = ("name", "seq", "sample_rate", "center_freq_hz", "i", "q")
PIECE = 4 << 20


@dataclass
class Part:
    """A file with blocks ``first`` to ``last`` of a recording."""

    file: str
    name: str
    rate: float | None
    center: float | None
    first: int
    last: int
    samples: int


@dataclass
class Parts(WriterCommitMessage):
    parts: list[Part] = field(default_factory=list)


def write_atomically(store: fs.FileSystem, path: str, data: bytes) -> None:
    """A file that is there whole or not at all."""
    folder, _, name = path.rpartition("/")
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as f:
        f.write(data)
    store.move(temporary, path)


def _exists(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


class SigmfSink(DataSource):
    """``sigmf``: options path, description, and job, the name of the list of what was written (``_jobs/<job>.json``)."""

    @classmethod
    def name(cls) -> str:
        return "sigmf"

    def writer(self, schema: StructType, overwrite: bool) -> SigmfWriter:
        if lost := [c for c in NEEDED if c not in schema.names]:
            raise ValueError(f"missing columns: {', '.join(lost)}")
        return SigmfWriter(self.options["path"], self.options.get("description", ""), overwrite, self.options.get("job"))


class SigmfWriter(DataSourceArrowWriter):
    def __init__(self, path: str, description: str, overwrite: bool, job: str | None = None):
        self.path, self.description, self.overwrite, self.job = path.rstrip("/"), description, overwrite, job or uuid.uuid4().hex

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        store, root = store_of(self.path)
        return store, root, f"{root}/_parts/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, _, folder = self._place()
        store.create_dir(folder, recursive=True)
        attempt, out, part = uuid.uuid4().hex, Parts(), None
        stream = None
        try:
            for b in iterator:
                cols = [b.column(c) for c in NEEDED]
                for k in range(b.num_rows):
                    name, seq, rate, center = (c[k].as_py() for c in cols[:4])
                    if name is None or seq is None or not (cols[4][k].is_valid and cols[5][k].is_valid):
                        raise ValueError("a block has a name, a number and samples")
                    if part is None or name != part.name or seq <= part.last:
                        if stream:
                            stream.close()
                        part = Part(f"{attempt}-{len(out.parts)}", name, rate, center, seq, seq, 0)
                        out.parts.append(part)
                        stream = store.open_output_stream(f"{folder}/{part.file}")
                    i, q = (c[k].values.to_numpy(zero_copy_only=False) for c in cols[4:])
                    if len(i) != len(q):
                        raise ValueError(f"block {seq} of {name}: i and q differ in length")
                    stream.write(np.stack([i.astype("<f4"), q.astype("<f4")], axis=1).tobytes())
                    part.last, part.samples = seq, part.samples + len(i)
        finally:
            if stream:
                stream.close()
        return out

    def commit(self, messages: list[Parts | None]) -> None:
        store, root, folder = self._place()
        by: dict[str, list[Part]] = {}
        for p in (p for m in messages if m for p in m.parts):
            by.setdefault(p.name, []).append(p)
        try:
            for name, parts in by.items():
                parts.sort(key=lambda p: (p.first, p.last))
                if any(b.first <= a.last for a, b in zip(parts, parts[1:])):
                    raise ValueError(f"{name}: parts share block numbers; deal the blocks out by ranges of name and seq")
                if "/" in name or name.startswith((".", "_")) or not name:
                    raise ValueError(f"{name!r} can't be a file's name")
                if not self.overwrite and any(_exists(store, f"{root}/{name}.sigmf-{kind}") for kind in ("meta", "collection")):
                    raise ValueError(f"{name} is there already")
            for name, parts in by.items():
                self._publish(store, root, folder, name, parts)
            store.create_dir(f"{root}/_jobs", recursive=True)
            write_atomically(store, f"{root}/_jobs/{self.job}.json", "".join(json.dumps({"name": name, "parts": len(parts)}) + "\n" for name, parts in by.items()).encode())
        finally:
            self._clear(store, folder)

    def _publish(self, store: fs.FileSystem, root: str, folder: str, name: str, parts: list[Part]) -> None:
        for old in old_files(store, root, name):
            store.delete_file(old)
        names = [name] if len(parts) == 1 else [f"{name}-{k:06d}" for k in range(len(parts))]
        for stem, p in zip(names, parts):
            store.move(f"{folder}/{p.file}", f"{root}/{stem}.sigmf-data")
        at = 0
        for stem, p in zip(names, parts):
            more = {} if len(parts) == 1 else {"offset": at, "collection": name}
            write_atomically(store, f"{root}/{stem}.sigmf-meta", sigmf_meta(p.rate, p.center, self.description, **more))
            at += p.samples
        if len(parts) > 1:
            listed = {"collection": {"core:version": "1.0.0", "core:description": self.description, "core:streams": [{"name": stem} for stem in names]}}
            write_atomically(store, f"{root}/{name}.sigmf-collection", json.dumps(listed, indent=2).encode())

    def abort(self, messages: list[Parts | None]) -> None:
        store, _, folder = self._place()
        self._clear(store, folder)

    @staticmethod
    def _clear(store: fs.FileSystem, folder: str) -> None:
        if _exists(store, folder):
            store.delete_dir(folder)


def old_files(store: fs.FileSystem, root: str, name: str) -> list[str]:
    """The files of a recording, meta files first, so that it's out of sight before its data goes."""
    stems = [name]
    collection = f"{root}/{name}.sigmf-collection"
    if _exists(store, collection):
        with store.open_input_stream(collection) as f:
            stems += [s["name"] for s in json.loads(f.read())["collection"]["core:streams"]]
    return [f for f in [collection, *(f"{root}/{s}.sigmf-meta" for s in stems), *(f"{root}/{s}.sigmf-data" for s in stems)] if _exists(store, f)]


def register(spark: SparkSession) -> None:
    """Make ``sigmf`` a format of this session."""
    spark.dataSource.register(SigmfSink)


def write_recordings(blocks: DataFrame, path: str, description: str = "", parts: int | None = None, overwrite: bool = False) -> DataFrame:
    """Write blocks as recordings; a long recording is spread over tasks by ranges of its blocks.  name and parts of each."""
    register(blocks.sparkSession)
    job = uuid.uuid4().hex
    n = parts or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select(*NEEDED).repartitionByRange(n, "name", "seq").sortWithinPartitions("name", "seq")
    dealt.write.format("sigmf").mode("overwrite" if overwrite else "append").option("description", description).option("job", job).save(path)
    return blocks.sparkSession.read.schema("name string, parts int").json(f"{path.rstrip('/')}/_jobs/{job}.json")


def finished(spark: SparkSession, path: str, annotations: DataFrame | None = None, description: str = "", names: DataFrame | None = None) -> DataFrame:
    """name and n_samples of the recordings under ``path`` (of ``names`` only, if given), each made one data file with its annotations in its meta file.

    A task makes one recording: it copies the segments through in pieces, gives the whole its name, then replaces
    the meta file, and removes the segments last.  Where a task is run again it finds what is left to do.
    """
    known = sigmf_catalogue(spark, path)
    if names is not None:
        known = known.join(names.select("name").distinct(), "name", "left_semi")
    segments = known.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("first_sample", "n_samples", "path"))).alias("parts"), F.first("sample_rate").alias("rate"), F.first("center_freq_hz").alias("center"))
    if annotations is None:
        rows = segments.withColumn("notes", F.array().cast("array<struct<sample_start: bigint>>"))
    else:
        notes = annotations.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("sample_start", "sample_count", "freq_lower_hz", "freq_upper_hz", "label", "comment"))).alias("notes"))
        rows = segments.join(notes, "name", "left")

    def run(batches):
        store, root = store_of(path.rstrip("/"))
        for b in batches:
            counts = []
            for k in range(b.num_rows):
                name, parts, rate, center, noted = (b.column(c)[k].as_py() for c in range(5))
                data = f"{root}/{name}.sigmf-data"
                whole = store.get_file_info(data)
                if len(parts) > 1 and whole.size != 8 * sum(p["n_samples"] for p in parts):
                    made = f"{root}/.{name}.{uuid.uuid4().hex}"
                    with store.open_output_stream(made) as out:
                        for p in parts:
                            with store.open_input_stream(store_of(p["path"])[1]) as source:
                                while piece := source.read(PIECE):
                                    out.write(piece)
                    store.move(made, data)
                write_atomically(store, f"{root}/{name}.sigmf-meta", sigmf_meta(rate, center, description, noted))
                if len(parts) > 1:  # the catalogue leaves segments out as soon as the whole has its meta file
                    stems = [store_of(p["path"])[1].removesuffix(".sigmf-data") for p in parts]
                    for old in [*(f"{x}.sigmf-meta" for x in stems), *(f"{x}.sigmf-data" for x in stems), f"{root}/{name}.sigmf-collection"]:
                        if _exists(store, old):
                            store.delete_file(old)
                counts.append(sum(p["n_samples"] for p in parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["name", "n_samples"])

    spread = rows.select("name", "parts", "rate", "center", "notes").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return spread.mapInArrow(run, "name string, n_samples long")
