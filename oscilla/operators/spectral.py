"""Short-time spectra, cepstra and Welch estimates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window(name: str, n: int) -> np.ndarray:
    """Periodic windows."""
    t = 2 * np.pi * np.arange(n) / n
    return {"hann": 0.5 - 0.5 * np.cos(t), "hamming": 0.54 - 0.46 * np.cos(t), "blackman": 0.42 - 0.5 * np.cos(t) + 0.08 * np.cos(2 * t), "rect": np.ones(n)}[name]


def frames(df: DataFrame, size: int, hop: int) -> DataFrame:
    """(channel, frame, x array) of the whole frames: a sample lists the frames it belongs to, so only rows of one frame meet."""
    first = F.greatest(F.floor((F.col("i") - size) / hop) + 1, F.lit(0))
    rows = df.withColumn("frame", F.explode(F.sequence(first, F.floor(F.col("i") / hop))))
    return rows.groupBy("channel", "frame").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("_x")).where(F.size("_x") == size).select("channel", "frame", F.transform("_x", lambda s: s["value"]).alias("x"))


def spectrogram(df: DataFrame, size: int = 400, hop: int | None = None, fs: float = 1.0, shape: str = "hann", power: float = 2.0) -> DataFrame:
    """channel, frame, k, freq, power of each frame, by one vectorised transform per Arrow batch."""
    win = window(shape, size)

    @F.pandas_udf("array<double>")
    def spectrum(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.abs(np.fft.rfft(np.stack(x) * win, axis=1)) ** power))

    out = frames(df, size, hop or size // 2).select("channel", "frame", F.posexplode(spectrum("x")).alias("k", "power"))
    return out.select("channel", "frame", "k", (F.col("k") * fs / size).alias("freq"), "power")


def welch(df: DataFrame, size: int = 256, fs: float = 1.0) -> DataFrame:
    """Mean density over half-overlapping Hann frames whose mean is taken off: channel, k, freq, density."""
    win = window("hann", size)
    scale = 1 / (fs * (win**2).sum())

    @F.pandas_udf("array<double>")
    def density(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        a = np.stack(x)
        p = np.abs(np.fft.rfft((a - a.mean(axis=1, keepdims=True)) * win, axis=1)) ** 2 * scale
        p[:, 1 : -1 if size % 2 == 0 else None] *= 2
        return pd.Series(list(p))

    rows = frames(df, size, size // 2).select("channel", F.posexplode(density("x")).alias("k", "p"))
    return rows.groupBy("channel", "k").agg(F.avg("p").alias("density")).select("channel", "k", (F.col("k") * fs / size).alias("freq"), "density")


def _mel(f):
    return 2595 * np.log10(1 + np.asarray(f) / 700)


def filterbank(n_filters: int, size: int, fs: float, kind: str = "mel", lo: float = 0.0, hi: float | None = None) -> np.ndarray:
    """Triangles over the bins of a spectrum, evenly spaced on a mel or a linear scale."""
    hi = fs / 2 if hi is None else hi
    if kind == "mel":
        edges = 700 * (10 ** (np.linspace(_mel(lo), _mel(hi), n_filters + 2) / 2595) - 1)
    else:
        edges = np.linspace(lo, hi, n_filters + 2)
    freq = np.linspace(0, fs / 2, size // 2 + 1)
    up = (freq[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - freq[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def cosine_basis(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal type-2 cosine transform."""
    k = np.arange(n_out)[:, None]
    m = np.cos(np.pi / n_in * (np.arange(n_in)[None, :] + 0.5) * k) * np.sqrt(2 / n_in)
    m[0] /= np.sqrt(2)
    return m


def cepstrum(df: DataFrame, n_out: int = 13, n_filters: int = 40, size: int = 400, hop: int | None = None, fs: float = 1.0, kind: str = "mel") -> DataFrame:
    """Mel or linear frequency cepstral coefficients: channel, frame, k, value (logarithm of power in decibels, 80 below the frame's peak at least)."""
    win, bank, basis = window("hann", size), filterbank(n_filters, size, fs, kind), cosine_basis(n_out, n_filters)

    @F.pandas_udf("array<double>")
    def coefficients(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        p = np.abs(np.fft.rfft(np.stack(x) * win, axis=1)) ** 2
        db = 10 * np.log10(np.maximum(p @ bank.T, 1e-10))
        db = np.maximum(db, db.max(axis=1, keepdims=True) - 80)
        return pd.Series(list(db @ basis.T))

    return frames(df, size, hop or size // 2).select("channel", "frame", F.posexplode(coefficients("x")).alias("k", "value"))
