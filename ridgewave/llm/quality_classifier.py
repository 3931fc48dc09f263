"""Operator 8, quality classifier: a byte-level convolutional network in numpy.

The network reads bytes.  Filters of ``width`` bytes (learned, one weight for each byte value at each
place) slide over overlapping chunks that cover the whole document; their rectified outputs are
max-pooled in each chunk.  The mean and the maximum over the chunks of each pooled filter feed one
logistic unit.  Chunks overlap by ``width - 1`` bytes, so every window of the document is seen once.

Training uses a bounded sample of labelled rows (``max_rows``, those of the smallest digests), whole texts in the
same chunks as in scoring; nothing else reaches the driver.  Scoring covers every byte of every row, one document at
a time, on the executors.

Defined cases: null text counts as empty and is scored as one chunk of padding; null ids pass through and
are not held out; rows without a label are not trained on; without any labelled row the score is 0.5; an
empty table gives an empty result; further columns (labels, lang, source and the id among them) are no
inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import require, table, text_of

WIDTH, FILTERS, CHUNK = 6, 16, 4096
#: Labelled rows that training sees at most, and the places of a batch that are convolved at once.
MAX_ROWS, PLACES = 3000, 1 << 18
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.02, 7
THRESHOLD = 0.7


def chunks_of(data: np.ndarray, width: int = WIDTH, chunk: int = CHUNK) -> list[np.ndarray]:
    """Overlapping chunks that cover all windows of a document; one shorter than a window is padded with zeros."""
    if len(data) < width:
        data = np.concatenate([data, np.zeros(width - len(data), np.uint8)])
    return [data[a : a + chunk + width - 1] for a in range(0, len(data) - width + 1, chunk)]


@dataclass
class Network:
    """Weights: filters[place, byte, filter], their biases, and the logistic unit over mean and maximum."""

    filters: np.ndarray
    bias: np.ndarray
    unit: np.ndarray
    offset: float

    @classmethod
    def fresh(cls, rng: np.random.Generator, width: int = WIDTH, filters: int = FILTERS) -> Network:
        return cls(rng.normal(0, 0.15, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters).astype(np.float32), 0.0)

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs at each place along the last axis of bytes."""
        n = x.shape[-1] - len(self.filters) + 1
        out = self.filters[0][x[..., :n]]
        for j in range(1, len(self.filters)):
            out += self.filters[j][x[..., j : j + n]]
        return out

    def pooled(self, data: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """(chunks, filters): the largest rectified output in each chunk of one document's bytes."""
        rows = [self.convolve(c).max(axis=0) for c in chunks_of(data, len(self.filters), chunk)]
        return np.maximum(np.stack(rows) + self.bias, 0)

    def score(self, data: bytes) -> float:
        """Probability of label 1."""
        p = self.pooled(np.frombuffer(data, np.uint8))
        z = float(np.concatenate([p.mean(axis=0), p.max(axis=0)]) @ self.unit) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class _Adam:
    def __init__(self, like: list[np.ndarray], rate: float):
        self.m, self.v, self.t, self.rate = [np.zeros_like(x) for x in like], [np.zeros_like(x) for x in like], 0, rate

    def step(self, values: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(values, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _tops(net: Network, chunks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, filters): largest filter output without bias and its place, in runs of chunks of similar length."""
    width, n_filters = net.filters.shape[0], net.filters.shape[2]
    top, place = np.empty((len(chunks), n_filters), np.float32), np.empty((len(chunks), n_filters), np.int64)
    order = sorted(range(len(chunks)), key=lambda k: len(chunks[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(chunks[order[end]]) <= PLACES and len(chunks[order[end]]) <= 1.25 * len(chunks[order[at]]):
            end += 1
        run = order[at:end]
        x = np.zeros((len(run), len(chunks[run[-1]])), np.uint8)
        for r, k in enumerate(run):
            x[r, : len(chunks[k])] = chunks[k]
        conv = net.convolve(x)  # chunks, places, filters
        for r, k in enumerate(run):
            conv[r, len(chunks[k]) - width + 1 :] = -np.inf
        best = conv.argmax(axis=1)
        place[run], top[run] = best, np.take_along_axis(conv, best[:, None, :], 1)[:, 0, :]
        at = end
    return top, place


def train(samples: list[tuple[int, bytes]], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network | None:
    """Fit (label, whole text) by Adam on the log loss; gradients flow through the pooled places only.  None without samples."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    width, n_filters = net.filters.shape[0], net.filters.shape[2]
    docs = [np.frombuffer(text, np.uint8) for _, text in samples]
    y = np.array([label for label, _ in samples], np.float32)
    share = np.clip(y.mean(), 0.01, 0.99)
    offset = np.array([np.log(share / (1 - share))], np.float32)
    values = [net.filters, net.bias, net.unit, offset]
    adam = _Adam(values, rate)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            cut = [chunks_of(docs[i], width) for i in rows]
            chunks, count = [c for cs in cut for c in cs], np.array([len(cs) for cs in cut])
            first, owner, n = np.cumsum(count) - count, np.repeat(np.arange(len(rows)), count), len(rows)
            top, place = _tops(net, chunks)
            act = np.maximum(top + net.bias, 0)
            mean, peak = np.add.reduceat(act, first) / count[:, None], np.maximum.reduceat(act, first)
            z = np.concatenate([mean, peak], axis=1) @ net.unit + offset[0]
            err = ((1 / (1 + np.exp(-z)) - y[rows]) / n).astype(np.float32)
            g_unit = np.concatenate([mean, peak], axis=1).T @ err + 1e-4 * net.unit
            g_act = (err / count)[owner, None] * net.unit[:n_filters] + (act == peak[owner]) * err[owner, None] * net.unit[n_filters:]
            g_act = np.where(act > 0, g_act, 0).astype(np.float32)
            g_filters = np.zeros_like(net.filters)
            c, f = np.nonzero(g_act)
            start = np.cumsum([0, *map(len, chunks[:-1])])[c] + place[c, f]
            data = np.concatenate(chunks)
            for j in range(width):
                np.add.at(g_filters[j], (data[start + j], f), g_act[c, f])
            adam.step(values, [g_filters, g_act.sum(axis=0), g_unit.astype(np.float32), np.array([err.sum()], np.float32)])
    net.offset = float(offset[0])
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never trained on: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> list[tuple[int, bytes]]:
    """At most ``max_rows`` labelled rows that aren't held out: label and whole text.

    Null ids and null labels aren't trained on; repeated labels count once, contradicting ones as a row each; of rows
    that share an id all texts are taken, up to ``max_rows`` rows in all.
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__rw_id"), F.col(label_col).cast("int").alias("__rw_label")).distinct()
    digest = F.md5(F.col("__rw_id").cast("string").cast("binary"))
    # no more than max_rows rows: a bounded side
    chosen = F.broadcast(chosen.orderBy(digest, "__rw_label").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("__rw_id"), text_of(text_col).cast("binary").alias("__rw_text")).join(chosen, "__rw_id")
    got = rows.orderBy(digest, "__rw_label", F.xxhash64("__rw_text")).limit(max_rows).select("__rw_label", "__rw_text").collect()
    return [(r["__rw_label"], bytes(r["__rw_text"])) for r in got]


def score(df: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    require(df, id_col, text_col)

    def scored(batches):
        for b in batches:
            texts = b.column(1)
            s = [0.5 if net is None else net.score(texts[k].as_py().encode("utf-8")) for k in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[id_col, "score"])

    return df.select(id_col, text_of(text_col).alias("__rw_text")).mapInArrow(scored, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(sample(docs, table(spark, sf_dir, "labels")))
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
