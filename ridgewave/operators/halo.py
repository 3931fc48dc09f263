"""Filters, filter banks and spectra of captures that are cut into blocks, as if they were whole.

Blocks are rows (key, seq, sample_start, i, q).  Each sends its first and last samples, as many as a filter reaches, to its neighbours, so a block
is computed with what lies before and behind it and gives the samples that are its own (overlap-save).  Blocks are shuffled once, by key and number,
so one long capture is spread over all tasks.  A gap in a capture is an end on both sides, where filters see zeros, as at the ends of a whole one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .spectral import Welch, channelized, filtered, lowpass_taps

Kernel = Callable[[np.ndarray, int, int, int, int], tuple]


def with_neighbours(blocks: DataFrame, kernel: Kernel, outputs: str, before: int, after: int, key: str = "key", reach: int = 2) -> DataFrame:
    """key, seq and ``outputs`` of ``kernel(x, start, own_start, own_end, lead)`` for each block.

    ``x`` are the block's samples with up to ``before`` samples that precede and ``after`` that follow it; ``start`` is the capture's place of
    x[0], and x[own_start:own_end] the block's own.  ``lead`` is what of ``before`` is missing because the capture begins.  A halo takes
    samples of up to ``reach`` blocks on either side; more than that is an error.
    """
    if before < 0 or after < 0 or reach < 1:
        raise ValueError("a halo has no negative length, and reach is at least 1")
    n = F.size("i")
    place = F.col("sample_start").alias("at"), n.alias("n")
    last = lambda c: F.slice(c, F.greatest(n - before + 1, F.lit(1)), before).alias(c) if before else F.array().cast("array<double>").alias(c)
    first = lambda c: F.slice(c, 1, after).alias(c) if after else F.array().cast("array<double>").alias(c)
    # one row for each block and neighbour
    far = F.explode(F.sequence(F.lit(1), F.lit(reach + 1))).alias("far")
    held = lambda c: F.when(F.col("far") <= reach, F.col(c)).otherwise(F.array().cast("array<double>")).alias(c)  # noqa: E731  the farthest one only tells that it's there
    ends = [blocks.select(key, "seq", *place, *(side(c) for c in "iq"), far).select(F.col(key).alias("__key"), (F.col("seq") + sign * F.col("far")).alias("__to"), F.struct((-sign * F.col("far")).alias("far"), "at", "n", held("i"), held("q")).alias("end")) for side, sign in ((last, 1), (first, -1))]
    sent = ends[0].unionByName(ends[1]).groupBy("__key", "__to").agg(F.collect_list("end").alias("ends"))  # a bounded number of ends
    met = blocks.join(sent, F.col(key).eqNullSafe(F.col("__key")) & (F.col("seq") == F.col("__to")), "left").select(key, "seq", "sample_start", "i", "q", "ends")
    made = StructType.fromDDL(outputs)
    schema = StructType([blocks.schema[key], blocks.schema["seq"], *made.fields])

    def gathered(x: np.ndarray, at: int, ends: list[dict]) -> tuple[np.ndarray, int, int]:
        """Samples with their halo, the place of the first one, and the samples before the block."""
        lead, tail, start, end = [], [], at, at + len(x)
        by = {e["far"]: e for e in ends}
        for k in range(1, reach + 1):
            e = by.get(-k)
            if e is None or e["at"] + e["n"] != start or at - start >= before:
                break
            piece = (np.array(e["i"]) + 1j * np.array(e["q"]))[-(before - (at - start)) :]
            lead.insert(0, piece)
            start -= len(piece)
            if len(piece) < e["n"]:
                break
        else:
            e = by.get(-reach - 1)
            if at - start < before and e is not None and e["at"] + e["n"] == start:
                raise ValueError(f"blocks before {at} are shorter than the halo of {before} samples; take a larger reach")
        for k in range(1, reach + 1):
            e = by.get(k)
            if e is None or e["at"] != end or end - at - len(x) >= after:
                break
            piece = (np.array(e["i"]) + 1j * np.array(e["q"]))[: after - (end - at - len(x))]
            tail.append(piece)
            end += len(piece)
            if len(piece) < e["n"]:
                break
        else:
            e = by.get(reach + 1)
            if end - at - len(x) < after and e is not None and e["at"] == end:
                raise ValueError(f"blocks behind {at} are shorter than the halo of {after} samples; take a larger reach")
        return np.concatenate([*lead, x, *tail]), start, at - start

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                i, q = (b.column(c)[k].values.to_numpy(zero_copy_only=False).astype(float) for c in (3, 4))
                own = i + 1j * q
                x, start, lead = gathered(own, b.column(2)[k].as_py(), b.column(5)[k].as_py() or [])
                rows.append(kernel(x, start, lead, lead + len(own), before - lead))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([v.tolist() if isinstance(v, np.ndarray) else v for v in c], t) for c, t in zip(columns, kinds))], names=schema.names)

    return met.mapInArrow(run, schema)


_SAMPLES = "sample_start long, i array<double>, q array<double>"


def filtered_capture(blocks: DataFrame, taps: np.ndarray, key: str = "key", every: int = 1) -> DataFrame:
    """key, seq, sample_start, i, q behind an FIR filter without its delay, and of these samples every ``every``-th of the capture.

    ``sample_start`` counts the samples that are kept.
    """
    k = len(taps)

    def kernel(x, start, own, end, lead):
        first = own + -(start + own) % every
        y = filtered(x[None], taps)[0][first:end:every]
        return (start + first) // every, y.real, y.imag

    return with_neighbours(blocks, kernel, _SAMPLES, k - 1 - k // 2, k // 2, key)


def decimated_capture(blocks: DataFrame, factor: int, rate: float, order: int = 64, key: str = "key") -> DataFrame:
    """Every ``factor``-th sample of captures behind a low-pass at 0.8 of the new Nyquist rate."""
    return filtered_capture(blocks, lowpass_taps(order, 0.8 * rate / factor / 2, rate), key, factor)


def channelized_capture(blocks: DataFrame, channels: int, taps_each: int = 8, key: str = "key") -> DataFrame:
    """key, seq, frame_start, i and q (a row of samples for each channel) of a filter bank over captures; blocks hold whole frames of ``channels`` samples."""

    def kernel(x, start, own, end, lead):
        if (start + own) % channels or start % channels or (end - own) % channels:
            raise ValueError(f"blocks don't hold whole frames of {channels} samples")
        y = channelized(x[None], channels, taps_each)[0][:, own // channels : end // channels]
        return (start + own) // channels, y.real, y.imag

    half = taps_each // 2
    return with_neighbours(blocks, kernel, "frame_start long, i array<array<double>>, q array<array<double>>", (taps_each - 1 - half) * channels, half * channels, key)


def welch_capture(blocks: DataFrame, spec: Welch, key: str = "key") -> DataFrame:
    """key, n_segments and psd of whole captures: segments lie at multiples of the hop, across blocks; captures shorter than a segment have no row."""
    size, hop = spec.fft_size, spec.hop

    def kernel(x, start, own, end, lead):
        total, n = np.zeros(size), 0
        first = own + -(start + own) % hop
        at = np.arange(first, min(end, len(x) - size + 1), hop)
        for run in np.array_split(at, max(1, len(at) // 256)):
            if len(run):
                total += spec.powers(np.stack([x[k : k + size] for k in run]))[:, 0].sum(axis=0)
                n += len(run)
        return n, total

    each = with_neighbours(blocks, kernel, "n long, total array<double>", 0, size - 1, key).where("n > 0")
    bins = each.select(key, "n", F.posexplode("total").alias("bin", "p")).groupBy(key, "bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rows = bins.groupBy(key).agg(F.first("n").alias("n_segments"), F.array_sort(F.collect_list(F.struct("bin", "p"))).alias("s"))  # the bins of a spectrum
    return rows.select(key, "n_segments", F.transform("s", lambda s: s["p"] / F.col("n_segments")).alias("psd"))
