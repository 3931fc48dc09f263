"""From detected bins to detections: regions, merging, characterisation; all within a frame, without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import map_frames
from .cfar import Cfar

DETECTION = "start_bin: int, end_bin: int, peak_bin: int, peak_power_db: double, snr_db: double, noise_floor_db: double, center_freq_hz: double, bandwidth_hz: double, bandwidth_3db_hz: double, bandwidth_6db_hz: double"


def decibels(x: np.ndarray) -> np.ndarray:
    return 10 * np.log10(x + 1e-12)


def regions(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of True, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def merge(found: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Regions joined where the next one starts at most ``gap`` bins after the last one ends."""
    out: list[list[int]] = []
    for start, end in found:
        if out and start - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def drop_width(level: np.ndarray, peak: int, drop: float, axis: np.ndarray) -> float:
    """Width between the nearest bins on both sides that are ``drop`` dB below the peak, or the frame's ends."""
    below = np.flatnonzero(level <= level[peak] - drop)
    left, right = below[below <= peak], below[below >= peak]
    return float(abs(axis[right[0] if len(right) else len(level) - 1] - axis[left[-1] if len(left) else 0]))


@dataclass(frozen=True)
class Peaks:
    """Regions to detections: widths in bins, SNR in dB, distances to merge in Hz."""

    sample_rate: float
    merge_hz: float = 0.0
    min_bins: int = 1
    min_snr_db: float = 3.0

    def __call__(self, psd: np.ndarray, mask: np.ndarray) -> list[tuple]:
        n = len(psd)
        step = self.sample_rate / n
        axis = (np.arange(n) - n // 2) * step
        level = decibels(psd)
        quiet = level[~mask]
        floor = float(np.median(quiet)) if len(quiet) else float(level.min())
        out = []
        for start, end in merge(regions(mask), int(self.merge_hz / step)):
            if end - start < self.min_bins:
                continue
            peak = start + int(level[start:end].argmax())
            snr = float(level[peak]) - floor
            if snr < self.min_snr_db:
                continue
            power = 10 ** (level[start:end] / 10)
            out.append((start, end, peak, float(level[peak]), snr, floor, float((axis[start:end] * power).sum() / power.sum()), float(abs(axis[end - 1] - axis[start])), drop_width(level, peak, 3, axis), drop_width(level, peak, 6, axis)))
        return out


def detect(df: DataFrame, cfar: Cfar, peaks: Peaks, psd_col: str = "psd", keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Spectra to detections in one pass: threshold, regions, merging and characterisation of each frame.

    One row a detection; ``detection_id`` counts from 0 in each frame, by frequency.
    """

    def kernel(psd: np.ndarray):
        mask = cfar(psd)[3]
        return [[peaks(row, m) for row, m in zip(psd, mask)]]

    found = map_frames(df, kernel, [psd_col], f"found array<struct<{DETECTION}>>", keep)
    return found.select(*keep, F.posexplode("found").alias("detection_id", "d")).select(*keep, "detection_id", "d.*")


def local_peaks(psd_db: np.ndarray, mask: np.ndarray, snr: np.ndarray, min_snr: float, most: int = 128) -> list[int]:
    """Detected bins of enough SNR that are no lower than both neighbours, the first ``most`` by bin."""
    left = np.concatenate([[-np.inf], psd_db[:-1]])
    right = np.concatenate([psd_db[1:], [-np.inf]])
    return np.flatnonzero(mask & (snr >= min_snr) & (psd_db >= left) & (psd_db >= right))[:most].tolist()
