"""Recursive filters: classical designs as second-order sections, applied to long signals in blocks.

A stable filter's impulse response dies away, so a block with enough samples on either side gives
the same values as the whole channel (to rounding).  The needed length follows from the largest
pole, so nothing has to be tuned.  Inside a block the response is applied by a fast transform.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("butter", "cheby1", "cheby2", "ellip", "bessel")


# ---- analogue low-pass prototypes (zeros, poles, gain) at 1 rad/s -----------------------------


def _descent(k: float) -> list[float]:
    out = []
    while k > 1e-16 and len(out) < 20:
        k = (k / (1 + math.sqrt(1 - k * k))) ** 2
        out.append(k)
    return out


def _cd(u, k: float):
    w = np.cos(np.asarray(u, complex) * np.pi / 2)
    for v in reversed(_descent(k)):
        w = (1 + v) * w / (1 + v * w * w)
    return w


def _sn(u, k: float):
    return _cd(1 - np.asarray(u, complex), k)


def _inverse_sn(w, k: float):
    w = np.asarray(w, complex)
    prev = k
    for v in _descent(k):
        w = w / (1 + np.sqrt(1 - w * w * prev * prev)) * 2 / (1 + v)
        prev = v
    return 1 - 2 / np.pi * np.arccos(w)


def prototype(family: str, n: int, rp: float = 1.0, rs: float = 40.0):
    m = np.arange(-n + 1, n, 2)
    if family == "butter":
        return np.array([]), -np.exp(1j * np.pi * m / (2 * n)), 1.0
    if family == "cheby1":
        eps = math.sqrt(10 ** (rp / 10) - 1)
        p = -np.sinh(math.asinh(1 / eps) / n + 1j * np.pi * m / (2 * n))
        k = np.prod(-p).real
        return np.array([]), p, k / math.sqrt(1 + eps * eps) if n % 2 == 0 else k
    if family == "cheby2":
        mu = math.asinh(math.sqrt(10 ** (rs / 10) - 1)) / n
        z = -np.conjugate(1j / np.sin(m[m != 0] * np.pi / (2 * n)))
        p = -np.exp(1j * np.pi * m / (2 * n))
        p = 1 / (np.sinh(mu) * p.real + 1j * np.cosh(mu) * p.imag)
        return z, p, (np.prod(-p) / np.prod(-z)).real
    if family == "ellip":
        ep, es = math.sqrt(10 ** (rp / 10) - 1), math.sqrt(10 ** (rs / 10) - 1)
        k1 = ep / es
        u = (2 * np.arange(1, n // 2 + 1) - 1) / n
        kc = math.sqrt(1 - k1 * k1)
        kp = kc**n * np.prod(_sn(u, kc)).real ** 4
        k = math.sqrt(1 - kp * kp)
        z = 1j / (k * _cd(u, k))
        v0 = -1j * _inverse_sn(1j / ep, k1) / n
        p = 1j * _cd(u - 1j * v0, k)
        z, p = np.concatenate([z, z.conj()]), np.concatenate([p, p.conj()])
        if n % 2:
            p = np.append(p, (1j * _sn(1j * v0, k)).real)
        gain = (np.prod(-p) / np.prod(-z)).real
        return z, p, gain / math.sqrt(1 + ep * ep) if n % 2 == 0 else gain
    if family == "bessel":  # reverse Bessel polynomial, unit delay
        c = [math.factorial(2 * n - k) / (2 ** (n - k) * math.factorial(k) * math.factorial(n - k)) for k in range(n, -1, -1)]
        return np.array([]), np.roots(c), c[-1]
    raise ValueError(f"unknown family {family!r}")


def design(family: str, kind: str, cutoff: float | tuple[float, float], fs: float, order: int = 4, rp: float = 1.0, rs: float = 40.0) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a digital low-pass, high-pass, band-pass or band-stop filter."""
    z, p, k = prototype(family, order, rp, rs)
    warped = 2 * fs * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, float)) / fs)
    degree = len(p) - len(z)
    if kind in ("lowpass", "highpass"):
        w = warped[0]
        if kind == "lowpass":
            z, p, k = z * w, p * w, k * w**degree
        else:
            k = k * (np.prod(-z) / np.prod(-p)).real
            z, p = np.concatenate([w / z, np.zeros(degree)]) if len(z) else np.zeros(degree), w / p
    elif kind in ("bandpass", "bandstop"):
        bw, w0 = warped[1] - warped[0], math.sqrt(warped[0] * warped[1])
        if kind == "bandpass":
            z, p, k = z * bw / 2, p * bw / 2, k * bw**degree
        else:
            k = k * (np.prod(-z) / np.prod(-p)).real
            z, p = (bw / 2) / z if len(z) else z, (bw / 2) / p
        split = lambda r: np.concatenate([r + np.sqrt(r.astype(complex) ** 2 - w0**2), r - np.sqrt(r.astype(complex) ** 2 - w0**2)])
        more = np.zeros(degree) if kind == "bandpass" else np.concatenate([np.full(degree, 1j * w0), np.full(degree, -1j * w0)])
        z, p = np.concatenate([split(z) if len(z) else z, more]), split(p)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    fs2 = 2 * fs
    k = k * (np.prod(fs2 - z) / np.prod(fs2 - p)).real
    z = np.concatenate([(fs2 + z) / (fs2 - z), -np.ones(len(p) - len(z))])
    return sections(z, (fs2 + p) / (fs2 - p), k)


def _pairs(roots: np.ndarray) -> list[tuple[complex, complex]]:
    """Roots two by two: conjugates together, real ones in order."""
    up = sorted((r for r in roots if r.imag > 1e-10), key=lambda r: -abs(r))
    real = sorted((r.real for r in roots if abs(r.imag) <= 1e-10), key=lambda r: -abs(r))
    out = [(r, r.conjugate()) for r in up] + [(real[i], real[i + 1]) for i in range(0, len(real) - 1, 2)]
    return out + ([(real[-1], None)] if len(real) % 2 else [])


def sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    poles, zeros = sorted(_pairs(np.asarray(p, complex)), key=lambda x: -abs(x[0])), _pairs(np.asarray(z, complex))
    out = []
    for a, b in poles:
        j = min(range(len(zeros)), key=lambda i: (abs(zeros[i][0] - a), (zeros[i][1] is None) != (b is None))) if zeros else None
        if b is None and zeros:
            lone = [i for i, x in enumerate(zeros) if x[1] is None]
            j = lone[0] if lone else j
        c, d = zeros.pop(j) if j is not None else (None, None)
        poly = lambda r, s: np.real(np.poly([x for x in (r, s) if x is not None]))
        out.append(np.concatenate([np.pad(poly(c, d), (0, 2))[:3], np.pad(poly(a, b), (0, 2))[:3]]))
    sos = np.array(out[::-1])
    sos[0, :3] *= k
    return sos


def notch(frequency: float, fs: float, q: float = 30.0, order: int = 4) -> np.ndarray:
    bw = frequency / q
    return design("butter", "bandstop", (frequency - bw / 2, frequency + bw / 2), fs, order)


def response(sos: np.ndarray, freqs: np.ndarray, fs: float) -> np.ndarray:
    zz = np.exp(-2j * np.pi * np.asarray(freqs, float) / fs)
    h = np.ones(len(zz), complex)
    for b0, b1, b2, a0, a1, a2 in sos:
        h *= (b0 + b1 * zz + b2 * zz * zz) / (a0 + a1 * zz + a2 * zz * zz)
    return h


def filter_rows(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Plain recursion from rest, for impulse responses and tests."""
    y = np.asarray(x, float).copy()
    for b0, b1, b2, _, a1, a2 in sos:
        s1 = s2 = 0.0
        for i, v in enumerate(y):
            out = b0 * v + s1
            s1, s2 = b1 * v - a1 * out + s2, b2 * v - a2 * out
            y[i] = out
    return y


def impulse(sos: np.ndarray, tolerance: float = 1e-13, most: int = 1 << 18) -> np.ndarray:
    """The impulse response up to where the slowest pole has died away."""
    r = max(np.abs(np.roots(s[3:])).max() for s in sos)
    n = min(most, max(64, math.ceil(math.log(tolerance) / math.log(min(r, 1 - 1e-9))) + 8 * len(sos)))
    x = np.zeros(n)
    x[0] = 1.0
    return filter_rows(sos, x)


def _once(h: np.ndarray, gain: float, x: np.ndarray) -> np.ndarray:
    """Filtered as if x[0] had stood for ever before it."""
    n = 1 << (len(x) + len(h) - 1).bit_length()
    d = x - x[0]
    return np.fft.irfft(np.fft.rfft(d, n) * np.fft.rfft(h, n), n)[: len(x)] + gain * x[0]


def filtered(x: np.ndarray, h: np.ndarray, gain: float, zero_phase: bool, pad: int) -> np.ndarray:
    """One span: forward, or forward and backward with an odd extension of ``pad`` samples at its ends."""
    if not zero_phase:
        n = 1 << (len(x) + len(h) - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]
    pad = min(pad, len(x) - 1)
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
    y = _once(h, gain, _once(h, gain, e)[::-1])[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def apply(df: DataFrame, sos: np.ndarray, zero_phase: bool = True, block: int = 1 << 16) -> DataFrame:
    """Filter every channel of a long signal; each task holds one block and its halo."""
    h = impulse(sos)
    gain = float(np.prod([s[:3].sum() / s[3:].sum() for s in sos]))
    halo = len(h) * (2 if zero_phase else 1)
    block = max(block, halo)
    pad = 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))
    blk, at = F.floor(F.col("i") / block), F.pmod(F.col("i"), F.lit(block))
    after = F.when(at < halo, blk - 1) if zero_phase else F.lit(None).cast("long")
    rows = df.select("channel", "i", "value").withColumn("_blk", F.explode(F.array_compact(F.array(blk, after, F.when(at >= block - halo, blk + 1)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        mine = (pdf["i"] // block == pdf["_blk"]).to_numpy()
        if not mine.any():  # halo copies beyond the channel's end
            return pdf.loc[[], ["channel", "i", "value"]]
        y = filtered(pdf["value"].to_numpy(float), h, gain, zero_phase, pad)
        out = pdf.loc[mine, ["channel", "i"]].copy()
        out["value"] = y[mine]
        return out

    kind = dict(df.dtypes)["channel"]
    return rows.groupBy("channel", "_blk").applyInPandas(run, f"channel {kind}, i long, value double")


def cascade(df: DataFrame, stages: list[np.ndarray], zero_phase: bool = True) -> DataFrame:
    """Several filters as one: their sections follow each other."""
    return apply(df, np.concatenate(stages), zero_phase)


def smooth_envelope(df: DataFrame, cutoff: float, fs: float, method: str = "abs", order: int = 4) -> DataFrame:
    from oscilla.operators.pointwise import rectify

    return apply(rectify(df, method), design("butter", "lowpass", cutoff, fs, order))


def energy_envelope(df: DataFrame, cutoff: float, fs: float, method: str = "classic", order: int = 4) -> DataFrame:
    from oscilla.operators.neighbourhood import tkeo

    return smooth_envelope(tkeo(df, method), cutoff, fs, "abs", order)
