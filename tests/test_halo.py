"""Captures cut into blocks against the same captures whole."""

from __future__ import annotations

import numpy as np
import pytest

from ridgewave.operators import halo, spectral

BLOCKS = "key string, seq long, sample_start long, i array<double>, q array<double>"


def cut(spark, captures: dict, sizes) -> tuple:
    """Blocks of captures, in sizes taken by turns; nothing else tells where they were cut."""
    rows = []
    for key, x in captures.items():
        at, k = 0, 0
        while at < len(x):
            n = sizes[k % len(sizes)]
            rows.append((key, k, at, x[at : at + n].real.tolist(), x[at : at + n].imag.tolist()))
            at, k = at + n, k + 1
    return spark.createDataFrame(rows, BLOCKS).repartition(5)


def signals(n: int = 1000) -> dict:
    rng = np.random.default_rng(1)
    return {key: rng.normal(0, 1, m) + 1j * rng.normal(0, 1, m) for key, m in (("a", n), ("b", n - 37), ("c", 5), (None, 200))}


def whole(rows, key) -> np.ndarray:
    own = sorted((r for r in rows if r["key"] == key), key=lambda r: r["seq"])
    starts = [r["sample_start"] for r in own if r["i"]]
    assert starts == np.cumsum([0, *(len(r["i"]) for r in own if r["i"])])[:-1].tolist()
    return np.concatenate([np.array(r["i"]) + 1j * np.array(r["q"]) for r in own])


@pytest.mark.parametrize("sizes", [(64,), (100, 33, 71), (1000,), (40, 41)])
@pytest.mark.parametrize("order, every", [(16, 1), (31, 1), (64, 4), (20, 7)])
def test_filters(spark, sizes, order, every):
    x = signals()
    taps = spectral.lowpass_taps(order, 900.0, 8000.0)
    rows = halo.filtered_capture(cut(spark, x, sizes), taps, every=every).collect()
    for key, z in x.items():
        assert np.allclose(whole(rows, key), spectral.filtered(z[None], taps)[0][::every], atol=1e-12)


def test_decimation_and_gaps(spark):
    x = signals(640)["a"][:640]
    got = whole(halo.decimated_capture(cut(spark, {"a": x}, (64,)), 4, 8000.0).collect(), "a")
    assert np.allclose(got, spectral.decimated(x[None], 4, 8000.0)[0], atol=1e-12)
    # without one block there are two captures
    taps = spectral.lowpass_taps(20, 900.0, 8000.0)
    rows = halo.filtered_capture(cut(spark, {"a": x}, (64,)).where("seq <> 4"), taps).collect()
    own = {r["seq"]: np.array(r["i"]) + 1j * np.array(r["q"]) for r in rows}
    assert np.allclose(np.concatenate([own[k] for k in range(4)]), spectral.filtered(x[None, :256], taps)[0], atol=1e-12)
    assert np.allclose(np.concatenate([own[k] for k in range(5, 10)]), spectral.filtered(x[None, 320:], taps)[0], atol=1e-12)


def test_blocks_shorter_than_the_halo(spark):
    x = signals()["a"]
    taps = spectral.lowpass_taps(60, 900.0, 8000.0)
    with pytest.raises(Exception, match="larger reach"):
        halo.filtered_capture(cut(spark, {"a": x}, (10,)), taps).collect()
    own = lambda x, start, a, b, lead: (start + a, *(f(spectral.filtered(x[None], taps)[0][a:b]) for f in (np.real, np.imag)))
    rows = halo.with_neighbours(cut(spark, {"a": x}, (10,)), own, "sample_start long, i array<double>, q array<double>", 30, 30, reach=4).collect()
    assert np.allclose(whole(rows, "a"), spectral.filtered(x[None], taps)[0], atol=1e-12)
    with pytest.raises(ValueError):
        halo.with_neighbours(cut(spark, {"a": x}, (10,)), own, "n long", -1, 0)


@pytest.mark.parametrize("channels, taps_each, size", [(8, 8, 64), (4, 6, 40), (16, 5, 160)])
def test_channels(spark, channels, taps_each, size):
    x = signals(960)["a"][:960]
    rows = sorted(halo.channelized_capture(cut(spark, {"a": x}, (size,)), channels, taps_each).collect(), key=lambda r: r["frame_start"])
    got = np.concatenate([np.array(r["i"]) + 1j * np.array(r["q"]) for r in rows], axis=1)
    assert np.allclose(got, spectral.channelized(x[None], channels, taps_each)[0], atol=1e-12)
    with pytest.raises(Exception, match="whole frames"):
        halo.channelized_capture(cut(spark, {"a": x}, (size + 1,)), channels, taps_each).collect()


@pytest.mark.parametrize("sizes", [(64,), (100, 33, 71), (1000,)])
@pytest.mark.parametrize("spec", [spectral.Welch(8000.0, 32, 0.5), spectral.Welch(8000.0, 64, 0.75, detrend=False), spectral.Welch(8000.0, 32, 0.5, native=True)])
def test_spectra(spark, sizes, spec):
    x = signals()
    rows = {r["key"]: r for r in halo.welch_capture(cut(spark, x, sizes), spec).collect()}
    assert set(rows) == {"a", "b", None}  # the third is shorter than a segment
    for key, r in rows.items():
        n = (len(x[key]) - spec.fft_size) // spec.hop + 1
        assert r["n_segments"] == n and np.allclose(r["psd"], spec.psd(x[key][None])[0], atol=1e-12)
