"""Window functions and their correction factors."""

from __future__ import annotations

import numpy as np

#: Cosine-sum coefficients; term k has sign (-1) ** k.  Fixed values.
COSINES = {
    "rectangular": (1.0,),
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}

#: name: coherent gain, noise bandwidth, ENBW, processing gain dB, largest side lobe dB.  Fixed values.
CORRECTIONS = {
    "rectangular": (1.0, 1.0, 1.0, 0.0, -13.3),
    "hann": (0.5, 1.5, 1.5, -1.76, -31.5),
    "hamming": (0.54, 1.36, 1.36, -1.34, -42.7),
    "blackman": (0.42, 1.73, 1.73, -2.38, -58.1),
    "blackman_harris": (0.36, 2.0, 2.0, -3.01, -92.0),
    "flattop": (0.22, 3.77, 3.77, -5.77, -93.0),
}


def window(name: str, n: int, periodic: bool = False, beta: float = 6.0) -> np.ndarray:
    """The window of ``n`` points; symmetric unless ``periodic``."""
    if name == "kaiser":
        return np.kaiser(n + 1, beta)[:-1] if periodic else np.kaiser(n, beta)
    if name not in COSINES:
        raise ValueError(f"unknown window {name}")
    phase = 2 * np.pi * np.arange(n) / max(1, n if periodic else n - 1)
    return sum((-1) ** k * a * np.cos(k * phase) for k, a in enumerate(COSINES[name]))


def corrections(name: str, n: int = 1024, beta: float = 6.0) -> tuple[float, float, float, float, float]:
    """Coherent gain, noise bandwidth, ENBW, processing gain and largest side lobe: known or measured."""
    if name in CORRECTIONS:
        return CORRECTIONS[name]
    w = window(name, n, beta=beta)
    gain, enbw = w.mean(), n * (w**2).sum() / w.sum() ** 2
    spectrum = np.abs(np.fft.fft(w, 8 * n))[: 4 * n]
    rising = np.flatnonzero(np.diff(spectrum) > 0)
    side = spectrum[rising[0] :].max() / spectrum[0] if len(rising) else 0.0
    return float(gain), float(enbw), float(enbw), float(-10 * np.log10(enbw)), float(20 * np.log10(side + 1e-12))
