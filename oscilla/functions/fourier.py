"""Fourier transforms of whole channels in blocks, and convolution by overlapping segments.

A channel of n samples is transformed in steps, each over small groups.  With N = p q, sample q a + b and frequency
c + p d (a, c < p; b, d < q):

1. by b: the samples with one remainder modulo q are transformed over a (p values), and turned by exp(-2 pi i b c / N);
2. by c: the values of all b are transformed over b (q values), which gives the frequencies c + p d; what is to be
   done with frequencies is done here, and the way back begins: transformed over d, and turned back;
3. by b again: transformed over c, which gives samples.

Between steps only tiles of MOST samples at most change tasks, as bytes; a task holds a group of remainders of MOST samples in
all (or p, or q, if that is more).  A channel of MOST samples and fewer is one group, a plain transform.

If n has no split into two factors of at most MOST (a large prime, say), the transform is written as a convolution with a
chirp, exp(i pi j^2 / n), which a transform of N >= 2 n - 1 computes, N a power of two: the same three steps, with a factor for
each sample before, a kernel, and a factor for each sample after.  The analytic signal is a convolution at any n.

Samples are numbered by ``i`` from 0; a missing sample, a null and a NaN count as 0.  Every sample from 0 to the channel's last
gets a row.  Empty input: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oscilla.functions.windows import KEYS

MOST = 1 << 20


def split(n: int, most: int) -> tuple[int, int] | None:
    """(p, q) with p q = n, p <= q <= most and p as great as can be but no greater than needed; None if there is none."""
    if n <= most:
        return 1, n
    for p in range(math.isqrt(n), 0, -1):
        if n % p == 0:
            return (p, n // p) if n // p <= most else None
    return None


def _sizes(n: int, most: int) -> tuple[int, int, bool]:
    """(p, q, direct) for a channel of n samples."""
    found = split(n, most)
    if found:
        return *found, True
    bits = (2 * n - 2).bit_length()
    p = 1 << (bits // 2)
    return p, (1 << bits) // p, False


def _turn(b: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """exp(-2 pi i b c / n) for all pairs, by whole numbers first, so that no accuracy is lost at large b c."""
    return np.exp(-2j * np.pi * ((b[:, None] * c[None, :]) % n) / n)


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    return np.exp(-1j * np.pi * ((j % (2 * n)) * (j % (2 * n)) % (2 * n)) / n)


def _analytic_kernel(t: np.ndarray, n: int) -> np.ndarray:
    """The kernel whose circular convolution with a signal of n samples is its analytic signal."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if n % 2 == 0:
            h = np.where(t % 2 == 1, 2 / np.tan(np.pi * t / n), 0.0)
        else:
            half = np.pi * t / (2 * n)
            h = np.where(t % 2 == 1, 1 / np.tan(half), -np.tan(half))
    return np.where(t == 0, 1.0, 1j * h / n)


def _wrapped(at: np.ndarray, n: int, size: int, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A kernel over -n < t < n laid out on a circle of ``size`` places."""
    t = np.where(at < n, at, at - size)
    return np.where(np.abs(t) < n, kernel(t), 0.0)


def _transformed(df: DataFrame, analytic: bool, keys: tuple[str, ...], most: int) -> DataFrame:
    """``analytic``: the analytic signal of each sample; else the transform at each frequency.  (keys, i, re, im)"""
    key_fields = [df.schema[k] for k in keys]
    schema = lambda *more: T.StructType([*key_fields, *(T.StructField(c, t) for c, t in more)])
    long, floats, raw = T.LongType(), T.DoubleType(), T.BinaryType()
    # part: the group that is addressed, or -1 for results, which are passed on; other: the group that a tile comes from
    tiles = schema(("n", long), ("part", long), ("other", long), ("tile", raw), ("kernel", raw))

    def shape(n: int) -> tuple[int, int, bool, int, int]:
        """p, q, direct, and how many b and c make a group."""
        p, q, direct = _sizes(n, most)
        return p, q, direct, max(1, most // p), max(1, most // q)

    def kernel(t: np.ndarray, n: int) -> np.ndarray:
        return _analytic_kernel(np.mod(t, n), n) if analytic else np.conj(_chirp(t, n))

    def rows_of(key: tuple, n: int, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, n, *r) for r in rows], columns=tiles.names)

    def emit(key: tuple, n: int, own: int, m: np.ndarray, k: np.ndarray | None, step: int) -> pd.DataFrame:
        """The columns of a group's matrix in tiles of ``step`` columns, addressed to the groups of the next step."""
        cut = lambda x, at: None if x is None else np.ascontiguousarray(x[:, at : at + step]).tobytes()
        return rows_of(key, n, [(other, own, cut(m, at), cut(k, at)) for other, at in enumerate(range(0, m.shape[1], step))])

    def result(key: tuple, n: int, own: int, at: np.ndarray, z: np.ndarray) -> pd.DataFrame:
        return rows_of(key, n, [(-1 - own, own, np.ascontiguousarray(z, np.complex128).tobytes(), np.ascontiguousarray(at, np.int64).tobytes())])

    def gathered(pdf: pd.DataFrame, column: str, width: int) -> np.ndarray:
        """Tiles of all groups before, one under another."""
        return np.concatenate([np.frombuffer(x, np.complex128).reshape(-1, width) for x in pdf.sort_values("other")[column]])

    def wanted(f: np.ndarray, n: int) -> np.ndarray:
        """What an analytic signal keeps of each frequency."""
        return np.where((f == 0) | (2 * f == n), 1.0, np.where(2 * f < n, 2.0, 0.0))

    def over_samples(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, own = int(pdf["n"].iloc[0]), int(key[-1])
        p, q, direct, bs, cs = shape(n)
        b = np.arange(own * bs, min((own + 1) * bs, q))
        pdf = pdf[pdf["i"] >= 0]
        at = pdf["i"].to_numpy(np.int64)
        x = np.zeros((len(b), p), np.complex128)
        x[at % q - b[0], at // q] = np.nan_to_num(pdf["value"].to_numpy(float, na_value=0.0), nan=0.0)
        if direct and p == 1:  # one group: nothing to exchange
            m = np.fft.fft(x[:, 0])
            return result(key[:-1], n, own, b, np.fft.ifft(m * wanted(b, n)) if analytic else m)
        place = q * np.arange(p)[None, :] + b[:, None]
        turn, k = _turn(b, np.arange(p), p * q), None
        if not direct:
            if not analytic:
                x *= np.where(place < n, _chirp(place, n), 0)
            k = np.fft.fft(_wrapped(place, n, p * q, lambda t: kernel(t, n)), axis=1) * turn
        return emit(key[:-1], n, own, np.fft.fft(x, axis=1) * turn, k, cs)

    def over_frequencies(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, own = int(pdf["n"].iloc[0]), int(key[-1])
        if own < 0:
            return pdf
        p, q, direct, bs, cs = shape(n)
        c = np.arange(own * cs, min((own + 1) * cs, p))
        m = np.fft.fft(gathered(pdf, "tile", len(c)), axis=0)  # row d, column c: frequency c + p d
        if direct:
            f = c[None, :] + p * np.arange(q)[:, None]
            if not analytic:
                return result(key[:-1], n, own, f.ravel(), m.ravel())
            m = m * wanted(f, n)
        else:
            m = m * np.fft.fft(gathered(pdf, "kernel", len(c)), axis=0)
        back = np.fft.ifft(m, axis=0) * np.conj(_turn(np.arange(q), c, p * q))  # row b, column c
        return emit(key[:-1], n, own, back.T, None, bs)

    def over_samples_again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, own = int(pdf["n"].iloc[0]), int(key[-1])
        if own < 0:
            z, at = np.frombuffer(pdf["tile"].iloc[0], np.complex128), np.frombuffer(pdf["kernel"].iloc[0], np.int64)
        else:
            p, q, direct, bs, _ = shape(n)
            b = np.arange(own * bs, min((own + 1) * bs, q))
            z = np.fft.ifft(gathered(pdf, "tile", len(b)), axis=0).ravel()  # row a, column b
            at = (q * np.arange(p)[:, None] + b[None, :]).ravel()
            z, at = z[at < n], at[at < n]
            if not (direct or analytic):
                z = z * _chirp(at, n)
        out = pd.DataFrame({"i": at, "re": z.real, "im": z.imag})
        for name, v in zip(keys, key, strict=False):
            out[name] = v
        return out[[*keys, "i", "re", "im"]]

    @F.pandas_udf("struct<q long, bs long>")
    def groups(n: pd.Series) -> pd.DataFrame:
        got = [shape(int(x)) for x in n]
        return pd.DataFrame({"q": [s[1] for s in got], "bs": [s[3] for s in got]})

    rows = df.where("i >= 0").select(*keys, "i", F.col("value").cast("double").alias("value"))
    sized = rows.groupBy(*keys).agg((F.max("i") + 1).alias("n")).withColumn("_g", groups("n"))  # a row a channel
    of = sized.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "n", "_g.q", "_g.bs")
    rows = rows.join(of, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    rows = rows.select(*keys, "n", F.floor(F.pmod("i", "q") / F.col("bs")).alias("part"), "i", "value")
    # one row more for every group, so that groups without samples take part
    every = sized.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_g.q") - 1) / F.col("_g.bs")))).alias("part"))
    rows = rows.unionByName(every.withColumn("i", F.lit(-1).cast("long")).withColumn("value", F.lit(0.0)))
    step = rows.groupBy(*keys, "part").applyInPandas(over_samples, tiles)
    step = step.groupBy(*keys, "part").applyInPandas(over_frequencies, tiles)
    return step.groupBy(*keys, "part").applyInPandas(over_samples_again, schema(("i", long), ("re", floats), ("im", floats)))


def analytic_signal(df: DataFrame, keys: tuple[str, ...] = KEYS, most: int = MOST) -> DataFrame:
    """The analytic signal of each channel: keys, i, re (the signal), im (its Hilbert transform)."""
    return _transformed(df, True, keys, most)


def spectrum(df: DataFrame, keys: tuple[str, ...] = KEYS, most: int = MOST) -> DataFrame:
    """The discrete Fourier transform of each channel at all its frequencies: keys, k, re, im."""
    return _transformed(df, False, keys, most).withColumnRenamed("i", "k")


def convolved(df: DataFrame, weights: list[float], before: int, normalize: bool = True, keys: tuple[str, ...] = KEYS, block: int = 1 << 16) -> DataFrame:
    """Sums of x[i - before + k] weights[k] by overlapping segments; normalised by the weights of the samples that there are.

    A block of samples and its neighbourhood becomes segments that overlap by the weights' length less one; all are
    transformed at once, multiplied by the spectrum of the weights, which a task makes once, and cut to what is free of
    wrap-around.  Missing samples, nulls and NaN have no weight.  One row for each row of ``df``.
    """
    w = np.asarray(weights, float)
    n, after = len(w), len(w) - 1 - before
    size = 1 << max(8, (4 * n - 1).bit_length())
    hop = size - n + 1
    block = max(block, n)
    spectra: dict[int, np.ndarray] = {}

    def segments(x: np.ndarray) -> np.ndarray:
        """Correlation of x with the weights: one value for each place that has all its neighbours in x."""
        if size not in spectra:
            spectra[size] = np.conj(np.fft.rfft(w, size))
        count = -(-(len(x) - n + 1) // hop)
        padded = np.concatenate([x, np.zeros(count * hop + n - 1 - len(x))]) if count * hop + n - 1 > len(x) else x
        parts = np.lib.stride_tricks.sliding_window_view(np.concatenate([padded, np.zeros(size)]), size)[: count * hop : hop]
        return np.fft.irfft(np.fft.rfft(parts, axis=1) * spectra[size], size, axis=1)[:, :hop].ravel()[: len(x) - n + 1]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * block
        i, v = pdf["i"].to_numpy(np.int64), pdf["value"].to_numpy(float, na_value=np.nan)
        lo, hi = first - before, min(first + block, int(i.max()) + 1) + after
        x, there = np.zeros(max(hi - lo, n)), np.zeros(max(hi - lo, n))
        good = ~np.isnan(v)
        x[i[good] - lo], there[i[good] - lo] = v[good], 1.0
        own = (i >= first) & (i < first + block)
        at = i[own] - first
        got = segments(x)[at]
        if normalize:
            filled = np.flatnonzero(there)
            if len(filled) and filled[-1] - filled[0] + 1 == len(filled):  # one stretch: sums of neighbouring weights
                sums = np.concatenate([[0.0], np.cumsum(w)])
                under = sums[np.clip(filled[-1] + 1 - at, 0, n)] - sums[np.clip(filled[0] - at, 0, n)]
            else:
                under = segments(there)[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                got = np.where(np.abs(under) > 1e-12 * np.abs(w).sum(), got / under, np.nan)
        return pdf[own].assign(value=pd.Series(got, index=pdf.index[own]).astype("Float64").where(~np.isnan(got)))[columns]

    columns = list(df.columns)
    fields = [T.StructField("value", T.DoubleType()) if f.name == "value" else f for f in df.schema]
    blk, at = F.floor(F.col("i") / block), F.pmod(F.col("i"), F.lit(block))
    copies = F.array_compact(F.array(blk, F.when(at < after, blk - 1), F.when(at >= block - before, blk + 1)))
    rows = df.withColumn("_blk", F.explode(copies))
    return rows.groupBy(*keys, "_blk").applyInPandas(run, T.StructType(fields))
