"""Spectra from samples, and arithmetic on blocks of samples.  All kernels take matrices (frames, samples)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import map_frames
from ..functions.windows import window
from .scan import Average, PeakHold, Persistence, Recurrence, scan


@dataclass(frozen=True)
class Welch:
    """Segments, window and scale of a spectrum.

    ``native`` is the other convention in use: periodic Hann window, zero padding of a short last segment, and
    scale 1 / (N sum w^2) with a floor of 1e-20.
    """

    sample_rate: float
    fft_size: int = 1024
    overlap: float = 0.5
    window: str = "hann"
    scaling: str = "density"
    detrend: bool = True
    native: bool = False

    def __post_init__(self):
        if self.fft_size < 2 or self.fft_size & (self.fft_size - 1):
            raise ValueError("fft_size is a power of two")
        if not 0 <= self.overlap <= 0.9 or self.scaling not in ("density", "spectrum"):
            raise ValueError("overlap is 0 to 0.9, scaling density or spectrum")

    @property
    def hop(self) -> int:
        return max(1, int(self.fft_size * (1 - self.overlap)))

    def axis(self) -> np.ndarray:
        """Frequencies of the bins, ascending."""
        return (np.arange(self.fft_size) - self.fft_size // 2) * self.sample_rate / self.fft_size

    def segments(self, x: np.ndarray) -> np.ndarray:
        """(frames, segments, fft_size); samples beyond the end repeat the last one, or are zero if ``native``."""
        n, size = x.shape[1], self.fft_size
        count = max(1, (n - size) // self.hop + 1)
        at = np.arange(count)[:, None] * self.hop + np.arange(size)
        out = x[:, np.minimum(at, n - 1)]
        return np.where(at < n, out, 0) if self.native else out

    def powers(self, x: np.ndarray) -> np.ndarray:
        """(frames, segments, bins): scaled squared magnitudes, bins in ascending frequency."""
        s = self.segments(x)
        if self.detrend and not self.native:
            s = s - s.mean(axis=2, keepdims=True)
        w = window("hann", self.fft_size, periodic=True) if self.native else window(self.window, self.fft_size)
        power = np.abs(np.fft.fftshift(np.fft.fft(s * w, axis=2), axes=2)) ** 2
        if self.native:
            return power / (self.fft_size * (w**2).sum())
        return power / (self.sample_rate * (w**2).sum()) if self.scaling == "density" else power / w.sum() ** 2

    def psd(self, x: np.ndarray) -> np.ndarray:
        mean = self.powers(x).mean(axis=1)
        return np.maximum(mean, 1e-20) if self.native else mean


def to_db(x: np.ndarray, reference: float = 1.0, native: bool = False) -> np.ndarray:
    """Decibels; ``native`` is bounded below by -200."""
    return np.maximum(10 * np.log10(x), -200.0) if native else 10 * np.log10(x / reference + 1e-12)


def welch(df: DataFrame, spec: Welch, keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """``keep``, psd and psd_db arrays of blocks with columns i and q."""

    def kernel(i, q):
        p = spec.psd(i + 1j * q)
        return p, to_db(p, native=spec.native)

    return map_frames(df, kernel, ["i", "q"], "psd array<double>, psd_db array<double>", keep)


def spectrogram(df: DataFrame, spec: Welch, keep: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """One row for each segment: its number, time in seconds and psd array."""
    out = map_frames(df, lambda i, q: (spec.powers(i + 1j * q),), ["i", "q"], "rows array<array<double>>", keep)
    return out.select(*keep, F.posexplode("rows").alias("segment", "psd")).withColumn("time_s", F.col("segment") * spec.hop / spec.sample_rate)


# -- samples ---------------------------------------------------------------------------------------
def shifted(x: np.ndarray, offset_hz: float, rate: float) -> np.ndarray:
    """x times exp(2 pi j offset n / rate)."""
    return x * np.exp(2j * np.pi * offset_hz / rate * np.arange(x.shape[1]))


def lowpass_taps(order: int, cutoff: float, rate: float) -> np.ndarray:
    """Hamming-windowed sinc of order + 1 taps with unit gain at zero."""
    m = np.arange(order + 1) - order / 2
    taps = 2 * cutoff / rate * np.sinc(2 * cutoff / rate * m) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(order + 1) / order))
    return taps / taps.sum()


def filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """FIR filter of the same length, without the filter's delay."""
    n, k = x.shape[1], len(taps)
    size = 1 << (n + k - 2).bit_length()
    full = np.fft.ifft(np.fft.fft(x, size, axis=1) * np.fft.fft(taps, size), axis=1)
    return full[:, k // 2 : k // 2 + n]


def decimated(x: np.ndarray, factor: int, rate: float, order: int = 64) -> np.ndarray:
    """Every ``factor``-th sample behind a low-pass at 0.8 of the new Nyquist rate."""
    return filtered(x, lowpass_taps(order, 0.8 * rate / factor / 2, rate))[:, ::factor]


def analytic(x: np.ndarray) -> np.ndarray:
    """Hilbert's analytic signal of a real one."""
    n = x.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)


def instantaneous_frequency(x: np.ndarray, rate: float) -> np.ndarray:
    """Phase steps wrapped once, in Hz; the last value is repeated."""
    d = np.diff(np.angle(x), axis=1)
    d = np.where(d > np.pi, d - 2 * np.pi, np.where(d < -np.pi, d + 2 * np.pi, d))
    hz = d * rate / (2 * np.pi)
    return np.concatenate([hz, hz[:, -1:]], axis=1) if hz.shape[1] else np.zeros((len(x), x.shape[1]))


def brick_lowpass(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    """Low-pass in the frequency domain with skirts of half a Hann window, a tenth of the cutoff wide."""
    f = np.abs(np.fft.fftfreq(x.shape[1], 1 / rate))
    skirt = 0.1 * cutoff
    gain = np.where(f <= cutoff, 1.0, np.where(f < cutoff + skirt, 0.5 * (1 + np.cos(np.pi * (f - cutoff) / skirt)), 0.0))
    return np.fft.ifft(np.fft.fft(x, axis=1) * gain, axis=1)


def prototype(channels: int, taps_each: int) -> np.ndarray:
    """A Kaiser-windowed sinc of one channel's width, its sum 1."""
    n = channels * taps_each
    taps = np.sinc((np.arange(n) - (n - 1) / 2) / channels) * np.kaiser(n, 8.0)
    return taps / taps.sum()


def channelized(x: np.ndarray, channels: int, taps_each: int = 8) -> np.ndarray:
    """(frames, channels, samples / channels): a polyphase filter bank over :func:`prototype`."""
    length = -(-x.shape[1] // channels)
    padded = np.pad(x, ((0, 0), (0, length * channels - x.shape[1])))
    phases = padded.reshape(len(x), length, channels)
    arms = prototype(channels, taps_each).reshape(taps_each, channels)
    out = np.zeros((len(x), length, channels), complex)
    for k in range(taps_each):
        at = k - taps_each // 2
        out[:, max(0, at) : length + min(0, at)] += arms[k] * phases[:, max(0, -at) : length - max(0, at)]
    return np.fft.fft(out, axis=2).transpose(0, 2, 1)


# -- recurrences over frames in order --------------------------------------------------------------
def held_peaks(df: DataFrame, key: str, order: str, column: str, decay: float = 0.0) -> DataFrame:
    """key, order, bin and value: the larger of each new value and the held one less ``decay`` a frame."""
    held = fold_frames(df, key, order, column, PeakHold(decay))
    return held.select(key, order, F.posexplode("state").alias("bin", "value"))


def fold_frames(df: DataFrame, key: str, order: str, column: str, step: Recurrence, keep_all: bool = True) -> DataFrame:
    """key, order and state: a running state over the frames of each key in order; each key's last one only without ``keep_all``.

    Frames of a key are spread over tasks (:func:`.scan.scan`).
    """
    rows = df.select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.col(column).cast("array<double>").alias("__frame"))
    out = scan(rows, "__key", ("__order",), ("__frame",), step, "state array<double>", last_only=not keep_all)
    return out.select(F.col("__key").alias(key), F.col("__order").alias(order), "state")


def ema(alpha: float) -> Recurrence:
    """alpha * new + (1 - alpha) * old, from the first frame on."""
    return Average(alpha)


def running_average(most: int) -> Recurrence:
    """An average whose weight is 1 / min(n, most)."""
    return Average(None, most)


def peak_hold(decay: float = 0.0) -> Recurrence:
    """The larger of the new value and the held one less ``decay``."""
    return PeakHold(decay)


def persistence(levels: int, low: float, high: float, decay: float = 0.02, gain: float = 0.3) -> Recurrence:
    """bins x levels: every cell fades by ``decay`` a frame, and the cells of the frame's levels gain."""
    return Persistence(levels, low, high, decay, gain)
