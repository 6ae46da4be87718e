"""Removal of a power line's harmonics by wavelet packets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """Band-limited resampling of a whole signal to n samples."""
    spectrum = np.fft.rfft(x)
    return np.fft.irfft(spectrum[: n // 2 + 1], n) * (n / len(x))


def packets(x: np.ndarray, level: int) -> np.ndarray:
    """Haar wavelet packets: one row for each node of the last level (rows 1.. are details)."""
    rows = x[None, :]
    for _ in range(level):
        a, b = rows[:, ::2], rows[:, 1::2]
        rows = np.stack([(a + b), (a - b)], 1).reshape(-1, rows.shape[1] // 2) / np.sqrt(2)
    return rows


def unpack(rows: np.ndarray) -> np.ndarray:
    while len(rows) > 1:
        s, d = rows[::2], rows[1::2]
        out = np.empty((len(s), 2 * rows.shape[1]))
        out[:, ::2], out[:, 1::2] = (s + d) / np.sqrt(2), (s - d) / np.sqrt(2)
        rows = out
    return rows[0]


def _baseline(c: np.ndarray, window: int) -> np.ndarray:
    """Running median, then a Gaussian of a sixth of the window."""
    half = max(1, window // 2)
    med = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(c, ((0, 0), (half, half)), mode="reflect"), 2 * half + 1, axis=1), axis=2)
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / max(1.0, window / 6)) ** 2)
    k /= k.sum()
    return np.stack([np.convolve(np.pad(r, half, mode="reflect"), k, mode="valid") for r in med])


def remove(x: np.ndarray, fs: float, frequency: float = 50.0, level: int = 5, window: int = 11) -> np.ndarray:
    """At 2^level samples for each period, what repeats from period to period is a constant in every detail node; that baseline is taken off."""
    per = 1 << level
    n = round(len(x) * frequency * per / fs)
    whole = -(-n // per) * per
    y = resample(x, n) if n != len(x) else x.copy()
    pad = np.pad(y, (0, whole - n), mode="wrap") if whole > n else y
    nodes = packets(pad, level)
    window = min(window, 2 * (nodes.shape[1] // 2) - 1)
    if window >= 3:
        nodes[1:] -= _baseline(nodes[1:], window)
    out = unpack(nodes)[:n]
    return resample(out, len(x)) if n != len(x) else out


def remove_harmonics(df: DataFrame, fs: float, frequency: float = 50.0, level: int = 5, window: int = 11) -> DataFrame:
    """Per channel (resampling is global, so a channel is one task)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pdf[["channel", "i"]].assign(value=remove(pdf["value"].to_numpy(float), fs, frequency, level, window))

    return df.select("channel", "i", "value").groupBy("channel").applyInPandas(run, f"channel {dict(df.dtypes)['channel']}, i long, value double")
