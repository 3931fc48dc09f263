"""Statistics of modulated signals: cumulants, kurtosis, symbol rates, timing errors, spectral correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import map_frames

#: Theoretical c40 and c42 of modulations.  Fixed values.
CUMULANTS = {"BPSK": (-2.0, -2.0), "QPSK": (1.0, -1.0), "8PSK": (0.0, 0.0), "16QAM": (-0.68, -0.68), "64QAM": (-0.619, -0.619), "256QAM": (-0.605, -0.605), "OOK": (0.5, 0.5), "FSK": (0.0, 0.0)}
#: Theoretical kurtosis.  Fixed values.
KURTOSIS = {"BPSK": 1.0, "QPSK": 1.0, "8PSK": 1.0, "16QAM": 1.32, "64QAM": 1.38, "Gaussian": 2.0}


def cumulants(x: np.ndarray, mode: str = "reference", normalize: bool = True) -> dict[str, np.ndarray]:
    """c20, c21, c40, c41, c42 of each row.

    A moment M_pq is E[x^p conj(x)^q] in mode "reference", E[x^(p-q) conj(x)^q] in mode "standard".
    """
    if normalize:
        x = x - x.mean(axis=1, keepdims=True)
        energy = np.sqrt((np.abs(x) ** 2).mean(axis=1, keepdims=True))
        x = np.divide(x, energy, out=x.copy(), where=energy > 0)

    def moment(p: int, q: int) -> np.ndarray:
        return (x ** (p if mode == "reference" else p - q) * x.conj() ** q).mean(axis=1)

    m20, m21, m40, m41, m42 = (moment(*pq) for pq in ((2, 0), (2, 1), (4, 0), (4, 1), (4, 2)))
    return {"c20": m20, "c21": m21, "c40": m40 - 3 * m20**2, "c41": m41 - 3 * m20 * m21, "c42": m42 - np.abs(m20) ** 2 - 2 * m21**2}


def kurtosis(x: np.ndarray) -> np.ndarray:
    """E|x|^4 / (E|x|^2)^2."""
    p = np.abs(x) ** 2
    return (p**2).mean(axis=1) / (p.mean(axis=1) ** 2 + 1e-30)


def confidence(distance: np.ndarray, snr_db: float | None = None) -> np.ndarray:
    """1 / (1 + d), 1 below 0.001; lowered in proportion to an SNR below 10 dB, and kept within 0.1 and 1."""
    c = np.where(distance < 1e-3, 1.0, 1 / (1 + distance))
    return np.clip(c * snr_db / 10, 0.1, 1.0) if snr_db is not None and snr_db < 10 else c


def rate_peak(spectrum: np.ndarray, freqs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequency, confidence, snr dB) of the largest allowed line over the median of allowed ones; NaN without any."""
    if not allowed.any():
        nan = np.full(len(spectrum), np.nan)
        return nan, nan, nan
    level = np.where(allowed, spectrum, 0)
    at = level.argmax(axis=1)
    snr = 10 * np.log10(spectrum[np.arange(len(spectrum)), at] / (np.median(spectrum[:, allowed], axis=1) + 1e-12))
    return np.abs(freqs[at]), np.clip((snr - 3) / 20, 0, 1), snr


def symbol_rate(x: np.ndarray, rate: float, power: int = 2, fft_size: int = 4096, low: float = 1e3, high: float = 1e7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol rate by the spectrum of |x|^2 (power 2) or of x^4, whose lines stand at four times the rate (power 4)."""
    y = np.abs(x) ** 2 if power == 2 else x**4
    if power == 2:
        y = y - y.mean(axis=1, keepdims=True)
    n = max(fft_size, y.shape[1])
    freqs = np.fft.fftfreq(n, 1 / rate)
    if power == 2:
        return rate_peak(np.abs(np.fft.fft(y, n, axis=1)), freqs, (freqs >= low) & (freqs <= high))
    f, c, s = rate_peak(np.abs(np.fft.fft(y, n, axis=1)), freqs, (np.abs(freqs) >= 4 * low) & (np.abs(freqs) <= 4 * high))
    return f / 4, c, s


def combined_rate(rates: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean of positive rates, and the mean weight scaled by how well the rates agree."""
    used = np.where(rates > 0, weights, 0)
    total = used.sum(axis=1)
    mean = np.divide((rates * used).sum(axis=1), total, out=np.zeros(len(rates)), where=total > 0)
    count = (rates > 0).sum(axis=1)
    positive = np.divide(np.where(rates > 0, rates, 0).sum(axis=1), count, out=np.zeros(len(rates)), where=count > 0)
    spread = np.divide(rates.var(axis=1), positive**2, out=np.ones(len(rates)), where=positive > 0)
    return mean, np.where(total > 0, weights.mean(axis=1) * (1 - np.minimum(1, spread)), 0)


def gardner_error(x: np.ndarray, sps: int) -> np.ndarray:
    """Mean of Re{(y_n - y_(n-1)) conj(y_(n-1/2))} over symbols."""
    n = np.arange(1, max(1, x.shape[1] // sps))
    if not len(n):
        return np.zeros(len(x))
    return ((x[:, n * sps] - x[:, (n - 1) * sps]) * x[:, n * sps - sps // 2].conj()).real.mean(axis=1)


def mueller_error(x: np.ndarray, decisions: np.ndarray, sps: int) -> np.ndarray:
    """Mean of Re{conj(d_n) y_(n-1) - conj(d_(n-1)) y_n} over symbols."""
    n = np.arange(1, min(x.shape[1] // sps, decisions.shape[1]))
    if not len(n):
        return np.zeros(len(x))
    return (decisions[:, n].conj() * x[:, (n - 1) * sps] - decisions[:, n - 1].conj() * x[:, n * sps]).real.mean(axis=1)


def spectral_correlation(x: np.ndarray, fft_size: int, hop: int, alphas: np.ndarray, rate: float, window: np.ndarray) -> np.ndarray:
    """(frames, alphas, bins): mean over blocks of X(t, f) conj(X(t, f - alpha)), alpha in whole bins.

    Rows of cyclic frequencies of half the band or more are zero.
    """
    count = max(0, (x.shape[1] - fft_size) // hop + 1)
    at = np.arange(count)[:, None] * hop + np.arange(fft_size)
    blocks = np.fft.fftshift(np.fft.fft(x[:, at] * window, axis=2), axes=2)
    out = np.zeros((len(x), len(alphas), fft_size), complex)
    for k, alpha in enumerate(alphas):
        bins = int(alpha / (rate / fft_size))
        if abs(bins) < fft_size // 2:
            out[:, k] = (blocks * np.roll(blocks, bins, axis=2).conj()).mean(axis=1)
    return out


def cyclic_slice(x: np.ndarray, fft_size: int, alpha: float, rate: float) -> np.ndarray:
    """(frames, bins): mean over segments of X(f) conj(Y(f)), where y is x shifted by half the cyclic frequency."""
    y = x * np.exp(-1j * np.pi * alpha * np.arange(x.shape[1]) / rate)
    n = max(1, x.shape[1] // fft_size)
    a, b = (np.fft.fft(z[:, : n * fft_size].reshape(len(x), n, -1), axis=2) for z in (x, y))
    return np.fft.fftshift((a * b.conj()).mean(axis=1), axes=1)


def constellation_stats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Power in dB, spread around the mean in percent of the power's root, and an SNR of 0 to 60 dB."""
    power = (np.abs(x) ** 2).mean(axis=1)
    spread = (np.abs(x - x.mean(axis=1, keepdims=True)) ** 2).mean(axis=1)
    safe = np.where(power > 0, power, 1)
    return 10 * np.log10(power + 1e-10), np.where(power > 0, 100 * np.sqrt(spread / safe), 0), np.where(power > 0, np.clip(10 * np.log10(safe / (spread + 1e-10)), 0, 60), 0)


def features(x: np.ndarray, rate: float, fft_size: int = 32, mode: str = "reference") -> np.ndarray:
    """(frames, 12): flatness, centroid, spread, duration ms, duty, repetition, c40 and c42 (re, im), symbol rate, kurtosis."""
    psd = np.abs(np.fft.fft(x, axis=1)) ** 2 / x.shape[1]
    total = psd.sum(axis=1) + 1e-12
    axis = np.arange(psd.shape[1]) / psd.shape[1]
    flat = np.exp(np.log(psd + 1e-12).mean(axis=1)) / (psd.mean(axis=1) + 1e-12)
    centre = (psd * axis).sum(axis=1) / total
    spread = np.sqrt((psd * (axis - centre[:, None]) ** 2).sum(axis=1) / total)
    energy = np.abs(x) ** 2
    duty = (energy > 0.5 * energy.mean(axis=1, keepdims=True)).mean(axis=1)
    c = cumulants(x, mode)
    n = len(x)
    return np.stack([flat, centre, spread, np.full(n, x.shape[1] / rate * 1000), duty, np.zeros(n), c["c40"].real, c["c40"].imag, c["c42"].real, c["c42"].imag, symbol_rate(x, rate, 2, fft_size)[0] / rate, kurtosis(x)], axis=1)


#: Names of the features of :func:`feature_vectors`, in order.
FEATURES = ("center_freq_normalized", "bandwidth_normalized", "peak_power_db", "snr_db", "spectral_flatness", "spectral_centroid", "spectral_spread", "burst_duration_ms", "duty_cycle", "repetition_rate_hz", "c40_real", "c40_imag", "c42_real", "c42_imag", "symbol_rate_normalized", "kurtosis")


def feature_vectors(df: DataFrame, rate: float, fft_size: int = 32, keep: tuple[str, ...] = ("frame_id",), mode: str = "reference") -> DataFrame:
    """``keep`` and x, the FEATURES of each row's samples (i, q) and detection."""
    given = df.select(*keep, "i", "q", F.array(*(F.col(c).cast("double") / s for c, s in (("center_freq_hz", rate), ("bandwidth_hz", rate), ("peak_power_db", 1.0), ("snr_db", 1.0)))).alias("d"))
    return map_frames(given, lambda i, q, d: (np.concatenate([d, features(i + 1j * q, rate, fft_size, mode)], axis=1),), ["i", "q", "d"], "x array<double>", keep)


def local_maxima(z: np.ndarray, half: int) -> np.ndarray:
    """Cells of a plane that no cell within ``half`` rows and columns exceeds."""
    padded = np.pad(z, half, constant_values=-np.inf)
    view = np.lib.stride_tricks.sliding_window_view(padded, (2 * half + 1, 2 * half + 1))
    return z >= view.max(axis=(2, 3))


def cyclic_features(scd: np.ndarray, alphas: np.ndarray, freqs: np.ndarray, resolution: float, threshold_db: float = 10.0, exclude_dc: bool = True, half: int = 2) -> list[tuple[float, float, float, float, float]]:
    """(cyclic Hz, spectral Hz, magnitude, phase, snr dB) of local maxima above the plane's median, strongest first."""
    level = 20 * np.log10(np.abs(scd) + 1e-12)
    floor = np.median(level)
    ok = (level > floor + threshold_db) & local_maxima(level, half)
    if exclude_dc:
        ok &= (np.abs(alphas) >= 2 * resolution)[:, None]
    found = [(float(alphas[a]), float(freqs[f]), float(abs(scd[a, f])), float(np.angle(scd[a, f])), float(level[a, f] - floor)) for a, f in np.argwhere(ok)]
    return sorted(found, key=lambda x: (-round(x[2], 9), x[0], x[1]))
