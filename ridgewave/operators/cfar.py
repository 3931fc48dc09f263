"""Adaptive thresholds (CFAR) over spectra: one family of kernels, applied frame by frame without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import map_frames
from .order import numbered


@dataclass(frozen=True)
class Cfar:
    """``reference`` and ``guard`` cells on each side of the cell under test.

    variant: CA (mean), GO and SO (larger, smaller of both sides' means), OS (median, or the ``rank``-th smallest).
    edge: how frames continue beyond their ends: "edge" (last cell again), "zero", "wrap".
    domain: "linear" multiplies the noise by alpha; "db" adds 10 log10(alpha), and the SNR is a difference.
    """

    reference: int = 32
    guard: int = 4
    pfa: float = 1e-6
    variant: str = "CA"
    edge: str = "edge"
    domain: str = "linear"
    rank: int | None = None

    def __post_init__(self):
        if self.variant not in ("CA", "GO", "SO", "OS") or self.edge not in ("edge", "zero", "wrap") or self.domain not in ("linear", "db"):
            raise ValueError("unknown variant, edge or domain")
        if not (4 <= self.reference <= 256 and 1 <= self.guard <= 32 and 0 < self.pfa < 1):
            raise ValueError("reference, guard or pfa out of range")

    @property
    def alpha(self) -> float:
        """Threshold factor for N = 2 * reference cells."""
        n = 2 * self.reference
        return n * (self.pfa ** (-1 / n) - 1)

    @staticmethod
    def alpha_of(reference: Column, pfa: Column) -> Column:
        """The threshold factor as a column, for settings that come from a table."""
        return 2 * reference * (F.pow(pfa, -1 / (2 * reference)) - 1)

    def noise(self, psd: np.ndarray) -> np.ndarray:
        """Noise estimate of every cell of (frames, bins)."""
        r, g, n = self.reference, self.guard, psd.shape[1]
        mode = {"edge": "edge", "zero": "constant", "wrap": "wrap"}[self.edge]
        padded = np.pad(psd, ((0, 0), (r + g, r + g)), mode=mode)
        cells = np.lib.stride_tricks.sliding_window_view(padded, r, axis=1)
        left, right = cells[:, :n], cells[:, r + 2 * g + 1 : r + 2 * g + 1 + n]
        if self.variant == "OS":
            both = np.concatenate([left, right], axis=2)
            est = np.median(both, axis=2) if self.rank is None else np.partition(both, self.rank, axis=2)[:, :, self.rank]
        else:
            a, b = left.mean(axis=2), right.mean(axis=2)
            est = {"CA": lambda: (a + b) / 2, "GO": lambda: np.maximum(a, b), "SO": lambda: np.minimum(a, b)}[self.variant]()
        bad = np.isnan(est)
        if bad.any():  # the frame's median of good estimates, or a tiny level
            for row in np.flatnonzero(bad.any(axis=1)):
                good = est[row][~bad[row]]
                est[row, bad[row]] = np.median(good) if len(good) else 1e-12
        return est

    def __call__(self, psd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """noise, threshold, snr, detected."""
        est = self.noise(psd)
        if self.domain == "db":
            threshold = est + 10 * np.log10(self.alpha)
            return est, threshold, psd - est, psd > threshold
        threshold = self.alpha * est
        return est, threshold, psd / np.maximum(est, 1e-12), psd > threshold


def detect_bins(df: DataFrame, cfar: Cfar, psd_col: str = "psd", keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """``keep`` and the arrays noise, threshold, snr and detected of each frame."""
    return map_frames(df, cfar, [psd_col], "noise array<double>, threshold array<double>, snr array<double>, detected array<boolean>", keep)


def plane_noise(spec: np.ndarray, reference: int, guard: int, mode: str = "standard") -> np.ndarray:
    """Two-dimensional CFAR noise: mean of the square ring around each cell, by a summed-area table.

    ``mode="reference"`` centres the ring ``reference + guard`` rows and bins before the cell.
    """
    w = reference + guard
    shift = w if mode == "reference" else 0
    padded = np.pad(spec, ((w + shift, w), (w + shift, w)), mode="edge")
    area = np.pad(padded, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)

    def square(half: int) -> np.ndarray:
        t, f = np.arange(spec.shape[0])[:, None] + w, np.arange(spec.shape[1])[None, :] + w
        return area[t + half + 1, f + half + 1] - area[t - half, f + half + 1] - area[t + half + 1, f - half] + area[t - half, f - half]

    count = (2 * w + 1) ** 2 - (2 * guard + 1) ** 2
    return (square(w) - square(guard)) / count


#: Frames of a tile in time.
TILE = 1024


def plane_frames(df: DataFrame, key: str, order: str, psd: str, reference: int, guard: int, mode: str = "standard", tile: int = TILE) -> DataFrame:
    """key, order and the noise array of each frame of the spectrogram that a key's frames make in order.

    Time is cut into tiles, each with as many frames of its neighbours as the ring reaches, so a spectrogram of
    any length is spread over tasks.  Frames of a key have equal length.
    """
    halo = 2 * (reference + guard)
    if tile <= halo:
        raise ValueError(f"a tile has more than {halo} frames")
    at, place = F.floor(F.col("place") / tile), F.col("place") % tile
    tiles = F.array_compact(F.array(at, F.when((at > 0) & (place < halo), at - 1), F.when(place >= tile - halo, at + 1)))
    rows = numbered(df.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(psd).alias("psd")), "key", "order")
    dealt = rows.select("key", "order", "place", "psd", F.explode(tiles).alias("tile"))

    def noise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        own = (pdf["place"] // tile == pdf["tile"]).to_numpy()
        pdf = pdf.assign(noise=list(plane_noise(np.stack(pdf["psd"].to_list()), reference, guard, mode)))
        return pdf.loc[own, ["key", "order", "noise"]]

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}
    out = dealt.groupBy("key", "tile").applyInPandas(noise, f"key {kinds[key]}, order {kinds[order]}, noise array<double>")
    return out.select(F.col("key").alias(key), F.col("order").alias(order), "noise")
