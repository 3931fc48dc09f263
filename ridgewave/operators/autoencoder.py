"""Anomaly scores of a non-linear autoencoder that learns in Spark: in batch over a table, and online over a stream.

The network is a few thousand numbers, so it is sent to the tasks; data stays where it is.  A step is one pass over its rows: tasks add
up their gradients, a shuffle of one row for each weight adds up the tasks, and the driver moves the weights by Adam.  What a stream
has learnt is a table of versions: each micro-batch is scored by the version before it, and its clearly normal rows, together
with those that earlier batches left over, give the next one as soon as there are enough of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slope of leaky units below 0, the allowance of normalisation, and Adam's decays.
LEAK, EPS, DECAY = 0.2, 1e-5, (0.9, 0.999)
#: Rows that go through the network at once, few enough for a core's cache.
SLICE = 512


@dataclass(frozen=True)
class Shape:
    """Widths from the input to the innermost layer; the way back mirrors them."""

    inner: tuple[int, ...] = (12, 32, 16, 4)

    @property
    def widths(self) -> tuple[int, ...]:
        return self.inner + self.inner[-2::-1]

    def bent(self, k: int) -> bool:
        """Whether layer ``k`` is normalised and bent: all but the innermost and the last."""
        return k not in (len(self.inner) - 2, len(self.widths) - 2)

    @cache
    def slices(self) -> list[dict[str, tuple[slice, tuple[int, ...]]]]:
        """Where each layer's weights, offsets, and norms lie in the flat vector."""
        out, at = [], 0
        for k, (a, b) in enumerate(zip(self.widths, self.widths[1:])):
            own = {}
            for name, shape in (("w", (a, b)), ("b", (b,)), *((("gain", (b,)), ("shift", (b,))) if self.bent(k) else ())):
                own[name] = (slice(at, at + int(np.prod(shape))), shape)
                at += int(np.prod(shape))
            out.append(own)
        return out

    @property
    def size(self) -> int:
        return self.slices()[-1]["b"][0].stop

    def fresh(self, seed: int = 7) -> np.ndarray:
        """Weights uniform within sqrt(6 / (in + out)), norms 1, offsets 0."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        for own in self.slices():
            at, (a, b) = own["w"]
            reach = np.sqrt(6 / (a + b))
            flat[at] = rng.uniform(-reach, reach, a * b)
            if "gain" in own:
                flat[own["gain"][0]] = 1.0
        return flat


def _layers(shape: Shape, flat: np.ndarray) -> list[dict[str, np.ndarray]]:
    return [{name: flat[at].reshape(s) for name, (at, s) in own.items()} for own in shape.slices()]


def _rebuilt(shape: Shape, flat: np.ndarray, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """The network's output for columns ``x``, one for each row of a table, as sums over a layer then run along memory; ``trace`` gets what :func:`gradient` needs of each layer."""
    for layer in _layers(shape, flat):
        given, z = x, layer["w"].T @ x
        z += layer["b"][:, None]
        unit = spread = None
        if "gain" in layer:
            z -= z.mean(axis=0)
            spread = np.sqrt(np.einsum("ij,ij->j", z, z) / len(z) + EPS)
            z /= spread
            unit = z
            z = unit * layer["gain"][:, None]
            z += layer["shift"][:, None]
            x = np.maximum(z, LEAK * z)
        else:
            x = z
        if trace is not None:
            trace.append((given, unit, spread, z))
    return x


def rebuilt(shape: Shape, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The network's output for rows ``x``."""
    return _rebuilt(shape, flat, np.ascontiguousarray(x.T)).T


def errors(shape: Shape, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Mean squared error of each row."""
    out = np.empty(len(x))
    for at in range(0, len(x), SLICE):
        columns = np.ascontiguousarray(x[at : at + SLICE].T)
        off = _rebuilt(shape, flat, columns) - columns
        out[at : at + SLICE] = np.einsum("ij,ij->j", off, off) / len(off)
    return out


def gradient(shape: Shape, flat: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the sum of the rows' errors, and that sum."""
    trace: list = []
    x = np.ascontiguousarray(x.T)
    off = _rebuilt(shape, flat, x, trace) - x
    out, back = np.zeros_like(flat), 2 * off / len(x)
    for own, layer, (given, unit, spread, z) in zip(shape.slices()[::-1], _layers(shape, flat)[::-1], trace[::-1]):
        if "gain" in layer:
            back *= np.where(z > 0, 1.0, LEAK)
            out[own["gain"][0]], out[own["shift"][0]] = np.einsum("ij,ij->i", back, unit), back.sum(axis=1)
            back *= layer["gain"][:, None]
            along = np.einsum("ij,ij->j", back, unit) / len(back)
            back -= back.mean(axis=0)
            back -= unit * along
            back /= spread
        out[own["w"][0]], out[own["b"][0]] = (given @ back.T).ravel(), back.sum(axis=1)
        back = layer["w"] @ back
    return out, float(np.einsum("ij,ij->", off, off) / len(x))


@dataclass(frozen=True)
class Learner:
    """A version of the network with its optimiser's averages."""

    shape: Shape = field(default_factory=Shape)
    rate: float = 1e-3
    version: int = 0
    flat: np.ndarray | None = None
    first: np.ndarray | None = None
    second: np.ndarray | None = None

    @classmethod
    def fresh(cls, shape: Shape | None = None, rate: float = 1e-3, seed: int = 7) -> Learner:
        shape = shape or Shape()
        return cls(shape, rate, 0, shape.fresh(seed), np.zeros(shape.size), np.zeros(shape.size))

    def moved(self, mean_gradient: np.ndarray) -> Learner:
        """The next version, one step of Adam away."""
        n = self.version + 1
        first = DECAY[0] * self.first + (1 - DECAY[0]) * mean_gradient
        second = DECAY[1] * self.second + (1 - DECAY[1]) * mean_gradient**2
        step = (first / (1 - DECAY[0] ** n)) / (np.sqrt(second / (1 - DECAY[1] ** n)) + 1e-8)
        return replace(self, version=n, flat=self.flat - self.rate * step, first=first, second=second)


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the vectors that are there, ``width`` long, and without a null or NaN."""
    lengths = np.diff(column.offsets.to_numpy())
    fit = np.flatnonzero((lengths == width) & column.is_valid().to_numpy(zero_copy_only=False))
    if len(fit) < len(column):
        column = column.take(pa.array(fit))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(fit), width)
    bad = np.isnan(x).any(axis=1)
    return (fit[~bad], x[~bad]) if bad.any() else (fit, x)


def scored(df: DataFrame, learner: Learner, x: str = "x", center: float = 0.1, slope: float = 10.0) -> DataFrame:
    """``df`` with ``anomaly_score``, sigmoid(slope (error - center)); null for rows whose ``x`` is null, too short or not a number.

    For detections' features the centre is 0.1 and the slope 10; for blocks of samples they are 0.05 and 20.
    """
    shape, flat, names = learner.shape, learner.flat, df.columns
    at, width = names.index(x), shape.inner[0]

    def run(batches):
        for b in batches:
            score = np.full(b.num_rows, np.nan)
            rows, given = _rows(b.column(at), width)
            if len(rows):
                mse = errors(shape, flat, given)
                score[rows] = 1 / (1 + np.exp(-np.clip(slope * (mse - center), -60, 60)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, mask=np.isnan(score))], names=[*names, "anomaly_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("anomaly_score", DoubleType())]))


def mean_gradient(df: DataFrame, learner: Learner, x: str = "x") -> tuple[np.ndarray, float, int]:
    """Mean gradient and mean error of the rows, and their number; one row for each weight comes to the driver."""
    shape, flat = learner.shape, learner.flat

    def sums(batches):
        total = None
        for b in batches:
            given = _rows(b.column(0), shape.inner[0])[1]
            for at in range(0, len(given), SLICE):
                v = given[at : at + SLICE]
                g, loss = gradient(shape, flat, v)
                part = np.concatenate([[float(len(v)), loss], g])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["k", "v"])

    out = np.zeros(shape.size + 2)
    for r in df.select(x).mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    n = int(out[0])
    return (out[2:] / n, float(out[1]) / n, n) if n else (out[2:], 0.0, 0)


def train(df: DataFrame, learner: Learner, steps: int, x: str = "x", tie: str = "id", parts: int = 1) -> tuple[Learner, list[float]]:
    """``steps`` passes of Adam, each over one of ``parts`` shares of the rows by a digest of ``tie``; and the errors before each step."""
    losses = []
    for k in range(steps):
        rows = df if parts == 1 else df.where(F.pmod(F.xxhash64(tie), F.lit(parts)) == k % parts)
        g, loss, n = mean_gradient(rows, learner, x)
        if n:
            learner = learner.moved(g)
            losses.append(loss)
    return learner, losses


# -- online ----------------------------------------------------------------------------------------
_STATE = "batch long, version long, rows long, low long, loss double, flat array<double>, first array<double>, second array<double>"


class Online:
    """Learning over micro-batches; state lies in a folder that all workers share, one version of it for each batch.

    ``learn`` is for ``foreachBatch``: what a batch leaves follows from its rows and the batch before it, so one that is run again
    leaves the same.  ``interval`` bounds the normal rows that wait for a step.
    """

    def __init__(self, folder: str, start: Learner, interval: int = 100, normal: float = 0.3, center: float = 0.1, slope: float = 10.0):
        self.folder, self.start, self.interval, self.normal, self.center, self.slope = folder.rstrip("/"), start, interval, normal, center, slope

    def _there(self, spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def version(self, spark: SparkSession, batch: int) -> Learner:
        """The network after a batch (-1: before the first)."""
        path = f"{self.folder}/state/{batch}"
        if batch < 0 or not self._there(spark, path):
            return self.start
        r = spark.read.schema(_STATE).parquet(path).first()
        return replace(self.start, version=r["version"], flat=np.array(r["flat"]), first=np.array(r["first"]), second=np.array(r["second"]))

    def learn(self, batch: DataFrame, number: int) -> None:
        """Score a batch, keep its scores, and take a step if enough normal rows have come together."""
        spark, learner = batch.sparkSession, self.version(batch.sparkSession, number - 1)
        scored(batch, learner, center=self.center, slope=self.slope).withColumn("version", F.lit(learner.version)).write.mode("overwrite").parquet(f"{self.folder}/scores/{number}")
        scores = spark.read.parquet(f"{self.folder}/scores/{number}")
        low = scores.where(F.col("anomaly_score") < self.normal).select("x")
        waiting = f"{self.folder}/waiting/{number - 1}"
        if number and self._there(spark, waiting):
            low = low.unionByName(spark.read.schema("x array<double>").parquet(waiting))
        g, loss, n = mean_gradient(low, learner)
        step = n >= self.interval
        low.where(F.lit(not step)).write.mode("overwrite").parquet(f"{self.folder}/waiting/{number}")  # fewer than ``interval`` rows
        after = learner.moved(g) if step else learner
        row = (number, after.version, scores.count(), n, loss, after.flat.tolist(), after.first.tolist(), after.second.tolist())
        spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/{number}")

    def stream(self, rows: DataFrame, checkpoint: str):
        """A streaming query that learns from rows with an array column x."""
        return rows.writeStream.foreachBatch(self.learn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def scores(self, spark: SparkSession) -> DataFrame:
        """All batches' rows with the score and version that they were given."""
        return spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/scores")

    def versions(self, spark: SparkSession) -> DataFrame:
        """batch, version, rows, low (normal rows at hand) and loss (their mean error before the step), a row for each batch."""
        return spark.read.schema(_STATE).option("recursiveFileLookup", True).parquet(f"{self.folder}/state").select("batch", "version", "rows", "low", "loss")


def temporary_folder(spark: SparkSession) -> str:
    """A folder of one's own in the shared folder."""
    from .order import shared_folder

    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"
