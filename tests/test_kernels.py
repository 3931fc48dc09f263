"""Closed forms, invariants and known signals."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgewave.functions import messages as msg
from ridgewave.functions.windows import corrections, window
from ridgewave.operators import demod, forensics, spectral
from ridgewave.operators.cfar import Cfar, plane_noise
from ridgewave.operators.peaks import Peaks, merge, regions


@pytest.mark.parametrize(("reference", "pfa", "alpha"), [(32, 1e-6, 15.420017), (16, 1e-4, 10.672686), (32, 1e-4, 9.906047), (64, 1e-7, 17.176884)])
def test_alpha(reference, pfa, alpha):
    assert Cfar(reference, 4, pfa).alpha == pytest.approx(alpha, abs=1e-6)


@pytest.mark.parametrize("variant", ["CA", "GO", "SO", "OS"])
def test_single_target(variant):
    psd = np.full((1, 512), 1e-3)
    psd[0, 256] = 1.0
    _, _, snr, mask = Cfar(16, 2, 1e-4, variant)(psd)
    assert mask[0].nonzero()[0].tolist() == [256] and snr[0, 256] > 10


def test_false_alarms():
    psd = np.random.default_rng(42).exponential(1.0, (1, 1024))
    assert Cfar(32, 4, 1e-6)(psd)[3].mean() < 0.01


def test_scale_and_nan():
    psd = np.random.default_rng(1).exponential(1.0, (3, 200))
    c = Cfar(8, 2, 1e-2)
    assert (c(psd)[3] == c(psd * 1e6)[3]).all()
    psd[1, 50] = np.nan
    assert np.isfinite(c(psd)[0]).all()
    assert c(np.ones((1, 3)))[3].sum() == 0  # shorter than the window


@given(st.lists(st.booleans(), max_size=60), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_regions(mask, gap):
    mask = np.array(mask, bool)
    found = regions(mask)
    again = np.zeros(len(mask), bool)
    for a, b in found:
        again[a:b] = True
    assert (again == mask).all()
    merged = merge(found, gap)
    assert merge(merged, gap) == merged
    assert all(b[0] - a[1] > gap for a, b in zip(merged, merged[1:]))


def test_one_tone_one_detection():
    rate, size = 1e6, 1024
    rng = np.random.default_rng(0)
    n = np.arange(65536)
    x = np.exp(2j * np.pi * 100e3 / rate * n) + 0.01 * (rng.normal(size=len(n)) + 1j * rng.normal(size=len(n)))
    w = spectral.Welch(rate, size)
    psd = w.psd(x[None, :])
    found = Peaks(rate, merge_hz=20e3, min_snr_db=20.0)(psd[0], Cfar(32, 8, 1e-6)(psd)[3][0])
    assert len(found) == 1 and abs(found[0][6] - 100e3) < 2 * rate / size


def test_parseval():
    x = np.random.default_rng(3).normal(size=(1, 64)) + 0j
    w = spectral.Welch(1.0, 64, 0.0, window="rectangular", detrend=False)
    assert w.powers(x).sum() / 64 == pytest.approx((np.abs(x) ** 2).mean())


def test_plane_modes():
    f = np.random.default_rng(5).exponential(1.0, (40, 50))
    a, b = plane_noise(f, 4, 1), plane_noise(f, 4, 1, "reference")
    assert np.allclose(a[10:30, 10:30], b[15:35, 15:35])


def test_windows():
    assert window("hann", 64)[0] == 0 and window("hann", 64)[-1] == pytest.approx(0)
    assert corrections("hann")[1] == 1.5 and 1 < corrections("kaiser")[1] < 3
    with pytest.raises(ValueError):
        window("nope", 8)


def test_moments_of_known_modulations():
    bpsk = np.tile([1.0, -1.0, -1.0, 1.0], 64)[None, :] + 0j
    assert forensics.cumulants(bpsk, "standard")["c42"][0].real == pytest.approx(-2)
    assert forensics.cumulants(bpsk, "reference")["c42"][0].real == pytest.approx(0, abs=1e-9)
    assert forensics.kurtosis(bpsk)[0] == pytest.approx(1)
    qpsk = np.tile(demod.constellation("QPSK"), 64)[None, :]
    assert forensics.cumulants(qpsk, "standard")["c40"][0].real == pytest.approx(-1)


def test_symbol_rate_line():
    rate, sps = 1e6, 10
    s = np.repeat(np.random.default_rng(2).choice([-1.0, 1.0], 800), sps)
    pulse = np.hanning(sps + 2)[1:-1]
    x = (s.reshape(-1, sps) * pulse).reshape(1, -1) + 0j
    f, c, _ = forensics.symbol_rate(x, rate, 2, 8192)
    assert f[0] == pytest.approx(100e3, rel=0.01) and c[0] > 0.5
    assert np.isnan(forensics.symbol_rate(x, 1000.0, 4)[0][0])  # four times the lowest rate is out of band


def test_cyclic_features_sorted():
    x = np.random.default_rng(4).normal(size=(1, 512)) + 0j
    alphas = np.arange(-4, 5) * 1.0
    scd = forensics.spectral_correlation(x, 16, 8, alphas, 16.0, np.ones(16))
    found = forensics.cyclic_features(scd[0], alphas, np.arange(16.0), 1.0, 3.0)
    assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
    assert all(abs(f[0]) >= 2 for f in found)


@pytest.mark.parametrize("name", ["BPSK", "QPSK", "8PSK", "16QAM", "64QAM", "256QAM"])
def test_constellations(name):
    p = demod.constellation(name)
    assert (np.abs(p) ** 2).mean() == pytest.approx(1)
    assert demod.decide(p, p).tolist() == list(range(len(p)))


def test_crc_anchor():
    assert demod.crc24(bytes.fromhex("4006020106" + "0303aa")) == 0x90DCE1


def test_packet_round_trip():
    body = bytes([0x40, 3, 1, 2, 3])
    crc = demod.crc24(body)
    data = (0x8E89BED6).to_bytes(4, "little") + body + crc.to_bytes(3, "little")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    p = demod.packet(bits)
    assert p["crc_valid"] and p["payload"] == b"\x01\x02\x03" and p["access_address"] == 0x8E89BED6
    assert demod.find_address(np.concatenate([np.zeros(9, np.uint8), bits])) [0:1] == [9]
    assert demod.packet(bits[:60]) is None


def test_costas_locks():
    rng = np.random.default_rng(0)
    s = demod.constellation("QPSK")[rng.integers(0, 4, 4000)]
    y, _ = demod.costas(s * np.exp(1j * (0.4 + 0.001 * np.arange(4000))))
    assert demod.evm_percent(y[None, 2000:], demod.constellation("QPSK"))[0] < 10


def test_chirps():
    sf = 7
    up = demod.chirp(sf)
    x = np.stack([np.roll(up, -k) for k in (0, 5, 99)])
    assert demod.dechirped(x, sf).argmax(axis=1).tolist() == [0, 5, 99]
    block = np.concatenate([np.zeros(40), np.tile(up, 3), np.zeros(50)]) + 0j
    assert demod.preambles(block, sf) == [40, 168, 296]
    with pytest.raises(ValueError):
        demod.chirp(3)


def test_decimator_and_channelizer():
    n = np.arange(2048)
    low, high = np.exp(2j * np.pi * 0.01 * n)[None, :], np.exp(2j * np.pi * 0.4 * n)[None, :]
    assert np.abs(spectral.decimated(low, 4, 1.0)[0, 50:-50]).mean() > 0.9
    assert np.abs(spectral.decimated(high, 4, 1.0)[0, 50:-50]).mean() < 0.01
    level = np.abs(spectral.channelized(np.exp(2j * np.pi * 0.25 * n)[None, :], 4))[0, :, 50:-50].mean(axis=1)
    assert level.argmax() in (1, 3) and level.max() > 5 * np.sort(level)[-2]


@given(st.lists(st.floats(-200, 50), min_size=1, max_size=40))
@settings(max_examples=40, deadline=None)
def test_messages(db):
    db = np.array(db)
    for version in (1, 2):
        t, c, s, level = msg.parse_spectrum(msg.spectrum_message(1.5, 2437000000.0, 2e7, db, version), version)
        assert (level == msg.quantize(db)).all() and t == 1.5
        if version == 2:
            assert c == 2437000000.0
    x = np.exp(1j * db)
    for short, tol in ((False, 1e-6), (True, 1e-4)):
        assert np.allclose(msg.parse_iq(msg.iq_message(0.0, 1e6, 1e6, x, short), short)[3], x, atol=tol)
    with pytest.raises(ValueError):
        msg.parse_spectrum(b"xx")
