"""Operators over a finite neighbourhood: energy, moving statistics, comb and FIR filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oscilla.functions import fourier
from oscilla.functions.windows import KEYS, over_neighbours


def tkeo(df: DataFrame, method: str = "classic", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Teager-Kaiser energy, x[i]^2 - x[i-1] x[i+1], or x[i] x[i+1] - x[i-1] x[i+2]; edges repeat the nearest valid value."""
    if method not in ("classic", "modified"):
        raise ValueError(f"unknown energy {method!r}")
    reach = 3 if method == "classic" else 4

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        x = lambda k: F.lead("value", k).over(w) if k > 0 else F.lag("value", -k).over(w) if k < 0 else F.col("value")
        if method == "classic":
            at = lambda k: x(k) * x(k) - x(k - 1) * x(k + 1)
            order = (0, 1, -1)
        else:
            at = lambda k: x(k) * x(k + 1) - x(k - 1) * x(k + 2)
            order = (0, 1, -1, -2)
        return d.withColumn("_e", F.coalesce(*(at(k) for k in order)))

    return over_neighbours(df, reach, reach, add, keys).withColumn("value", F.col("_e")).drop("_e")


def moving(df: DataFrame, window: int, stat: str = "mean", center: bool = True, edge: str = "truncate", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Moving mean, rms, min, max or upper median over [-w//2, w//2] or [-(w-1), 0].

    ``edge="truncate"`` uses the samples there are; ``"zero"`` divides by the window's size, as if
    the signal went on with zeros.
    """
    lo, hi = (window // 2, window // 2) if center else (window - 1, 0)

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        f = w.rowsBetween(-lo, hi)
        x = F.col("value")
        if stat == "median":
            s = F.array_sort(F.collect_list("value").over(f))
            got = F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))
        elif edge == "zero":
            n = F.lit(float(lo + hi + 1))
            got = {"mean": F.sum(x).over(f) / n, "rms": F.sqrt(F.sum(x * x).over(f) / n)}[stat]
        else:
            got = {"mean": F.avg(x).over(f), "rms": F.sqrt(F.avg(x * x).over(f)), "min": F.min(x).over(f), "max": F.max(x).over(f)}[stat]
        return d.withColumn("_m", got)

    return over_neighbours(df, lo, hi, add, keys).withColumn("value", F.col("_m")).drop("_m")


def convolve(df: DataFrame, weights: list[float], center: bool = True, normalize: bool = True, align: str = "sample", keys: tuple[str, ...] = KEYS, method: str = "auto") -> DataFrame:
    """Weighted moving average with ``weights``; truncated windows are renormalised by the weights they use.

    ``method``: "direct" sums, "fft" for overlapping segments, or "auto" for what :func:`fir_method` says.
    ``align="sample"`` gives each weight to its offset from the sample.  ``align="edge"`` slides the
    weights at the borders: the left border uses the last ones, the right border the first.
    """
    n = len(weights)
    lo = n // 2 if center else n - 1
    hi = n - 1 - lo
    if method not in ("auto", "direct", "fft"):
        raise ValueError(f"unknown method {method!r}")
    if align == "sample" and (fir_method(n) if method == "auto" else method) == "fft":
        return fourier.convolved(df, weights, lo, normalize, keys)

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        values = F.collect_list("value").over(w.rowsBetween(-lo, hi))
        have = F.count("value").over(w.rowsBetween(-lo, 0)) - 1  # samples before this one that there are
        size = F.size(values)
        if align == "edge":
            first = F.when(have < lo, n - size).otherwise(0)
        else:
            first = F.lit(lo) - have
        # normalised once in all for full windows; truncated ones by their own weights
        used = F.slice(F.array(*map(F.lit, weights)), (first + 1).cast("int"), size)
        total = F.aggregate(F.zip_with(values, used, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        weight = F.aggregate(used, F.lit(0.0), lambda a, b: a + b)
        return d.withColumn("_c", F.try_divide(total, weight) if normalize else total)

    return over_neighbours(df, lo, hi, add, keys).withColumn("value", F.col("_c")).drop("_c")


def comb(df: DataFrame, frequency: float, fs: float, alpha: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Feed-forward comb y[k] = x[k] + alpha x[k - N], N = round(fs / frequency); the first N samples stay."""
    n = round(fs / frequency)
    if n == 0:
        return df.withColumn("value", F.col("value") * (1 + alpha))
    return over_neighbours(df, n, 0, lambda d, w: d.withColumn("_y", F.col("value") + alpha * F.coalesce(F.lag("value", n).over(w), F.lit(0.0))), keys).withColumn("value", F.col("_y")).drop("_y")


def comb_notch(df: DataFrame, frequency: float, fs: float, strength: float = 1.0) -> DataFrame:
    return comb(df, frequency, fs, -strength)


def comb_enhance(df: DataFrame, frequency: float, fs: float, strength: float = 1.0) -> DataFrame:
    return comb(df, frequency, fs, strength)


def sinc_window(cutoff: float, size: int, shape: str, fs: float) -> list[float]:
    """Windowed-sinc low-pass weights that sum to one.  The "hann" shape spans half a period."""
    fc, out = cutoff / fs, []
    for k in range(size):
        x = k - (size - 1) / 2
        s = 2 * fc if abs(x) < 1e-12 else math.sin(2 * math.pi * fc * x) / (math.pi * x)
        t = k / (size - 1) if size > 1 else 0.5
        shapes = {
            "hann": 0.5 * (1 - math.cos(math.pi * t)),
            "hamming": 0.54 - 0.46 * math.cos(2 * math.pi * t),
            "blackman": 0.42 - 0.5 * math.cos(2 * math.pi * t) + 0.08 * math.cos(4 * math.pi * t),
            "bartlett": 1 - abs(2 * t - 1),
            "rect": 1.0,
        }
        if shape not in shapes:
            raise ValueError(f"unknown window {shape!r}")
        out.append(s * shapes[shape])
    total = sum(out)
    return [x / total for x in out]


def sinc_filter(df: DataFrame, cutoff: float, fs: float, size: int = 31, shape: str = "hamming") -> DataFrame:
    return convolve(df, sinc_window(cutoff, size, shape, fs))


def fir_method(size: int) -> str:
    """Direct sums below 49 weights, overlapping segments and their transforms above."""
    return "fft" if size > 48 else "direct"


def smooth(df: DataFrame, window: int, center: bool = True) -> DataFrame:
    """Savitzky-Golay under the compatible definition: a plain moving mean."""
    return moving(df, window, "mean", center)


def savgol_weights(window: int, order: int, at: int | None = None) -> list[float]:
    """Weights of a least-squares polynomial through ``window`` samples, read at its middle or at sample ``at``."""
    if window < 1 or not 0 <= order < window:
        raise ValueError("the order must be less than the window")
    half = window // 2
    x = (np.arange(window) - half) / max(half, 1)
    to = (half if at is None else at) - half
    powers = x[:, None] ** np.arange(order + 1)
    return (np.linalg.pinv(powers).T @ (to / max(half, 1)) ** np.arange(order + 1)).tolist()


def savitzky_golay(df: DataFrame, window: int, order: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """True Savitzky-Golay: each sample becomes the value of a polynomial fitted to the window around it.

    At the borders the polynomial of the first (last) whole window is read at each of its samples.  Channels shorter than
    the window are fitted whole, by a polynomial of at most that order.  :func:`smooth` keeps the compatible moving mean.
    """
    if window % 2 == 0:
        raise ValueError("the window must be odd")
    half = window // 2
    middle = savgol_weights(window, order)

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        near = F.collect_list("value").over(w.rowsBetween(-half, half))
        fit = F.aggregate(F.zip_with(near, F.array(*map(F.lit, middle)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return d.withColumn("_s", F.when(F.size(near) == window, fit))

    inner = over_neighbours(df, half, half, add, keys)
    if half == 0:
        return inner.withColumn("value", F.col("_s")).drop("_s")
    # the first and last windows of each channel: two short arrays, and a matrix of weights by length and place
    n = df.groupBy(*keys).agg((F.max("i") + 1).alias("_n"))
    ends = df.join(n, list(keys)).where((F.col("i") < window) | (F.col("i") >= F.col("_n") - window))
    listed = lambda condition: F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("i", "value")))), lambda s: s["value"])
    ends = ends.groupBy(*keys, "_n").agg(listed(F.col("i") < window).alias("_first"), listed(F.col("i") >= F.col("_n") - window).alias("_last"))
    table = {m: [savgol_weights(m, min(order, m - 1), k) for k in range(m)] for m in range(1, window + 1)}
    of_size = F.array(*(F.array(*(F.array(*map(F.lit, row)) for row in table[m])) for m in range(1, window + 1)))
    left = F.col("i") < half
    place = F.when(left | (F.col("_n") <= window), F.col("i")).otherwise(F.col("i") - F.col("_n") + window)
    values = F.when(left, F.col("_first")).otherwise(F.col("_last"))
    weights = F.element_at(F.element_at(of_size, F.size(values)), (place + 1).cast("int"))
    edge = F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return inner.join(ends, list(keys)).withColumn("value", F.coalesce("_s", edge)).select(df.columns)


def peak_follower(df: DataFrame, attack: float, release: float, fs: float, keys: tuple[str, ...] = KEYS, block: int = 1 << 16) -> DataFrame:
    """Envelope that rises towards |x| with time constant ``attack`` and falls with ``release`` (seconds): y += (1 - exp(-1 / (fs t))) (|x| - y), from 0.

    What y was is forgotten at least as fast as the slower constant says, so a block that begins that much earlier (where it no
    longer changes a double) gives the values of a scan of the whole channel.  Null and NaN samples leave y as it is.
    """
    if attack < 0 or release < 0:
        raise ValueError("time constants are not negative")
    up, down = (1.0 if t == 0 else 1 - math.exp(-1 / (fs * t)) for t in (attack, release))
    slow = min(up, down)
    halo = 1 if slow >= 1 else math.ceil(40 / -math.log1p(-slow))
    block = max(block, halo)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        out, y = [], 0.0
        for x in np.abs(pdf["value"].to_numpy(float, na_value=np.nan)).tolist():
            if x == x:
                y += (up if x > y else down) * (x - y)
            out.append(y)
        own = (pdf["i"] // block == key[-1]).to_numpy()
        return pdf.assign(value=out)[own][columns]

    columns = list(df.columns)
    blk, at = F.floor(F.col("i") / block), F.pmod(F.col("i"), F.lit(block))
    rows = df.withColumn("_blk", F.explode(F.array_compact(F.array(blk, F.when(at >= block - halo, blk + 1)))))
    fields = [T.StructField("value", T.DoubleType()) if f.name == "value" else f for f in df.schema]
    return rows.groupBy(*keys, "_blk").applyInPandas(run, T.StructType(fields))


def exponential(df: DataFrame, alpha: float, keys: tuple[str, ...] = KEYS, block: int = 512) -> DataFrame:
    """y[0] = x[0], y[i] = alpha x[i] + (1 - alpha) y[i-1], exact over whole channels.

    The recurrence is linear, so blocks are scanned side by side from zero and only their ends are
    chained: a block's true values are its own plus (1 - alpha)^(k+1) times the value before it.
    Blocks so far back that their weight is below 1e-17 do not change a double, so the chain is short.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    from pyspark.sql import Window

    keep = 1 - alpha
    order = Window.partitionBy(*keys, "_blk").orderBy("i")
    rows = df.withColumn("_blk", F.floor(F.col("i") / block)).withColumn("_k", F.row_number().over(order) - 1)
    x: Column = F.when(F.col("i") == 0, F.col("value")).otherwise(F.col("value") * alpha)
    rows = rows.groupBy(*keys, "_blk").agg(F.array_sort(F.collect_list(F.struct("i", x.alias("x")))).alias("_s"))
    scanned = F.aggregate(
        "_s",
        F.struct(F.lit(0.0).alias("y"), F.slice(F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("y"))), 1, 0).alias("out")),
        lambda acc, s: F.struct((acc["y"] * keep + s["x"]).alias("y"), F.concat(acc["out"], F.array(F.struct(s["i"].cast("long").alias("i"), (acc["y"] * keep + s["x"]).alias("y")))).alias("out")),
    )
    held = rows.select(*keys, "_blk", scanned.alias("_r"), F.size("_s").alias("_n")).select(*keys, "_blk", "_n", F.col("_r.y").alias("_end"), F.col("_r.out").alias("_out"))
    # ends of blocks: few rows, chained in order
    reach = math.ceil(40 / (-math.log(keep) * block)) + 1
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(-reach, -1)
    ends = held.select(*keys, "_blk", F.collect_list(F.struct("_end", "_n")).over(w).alias("_before"))
    carry = F.aggregate("_before", F.lit(0.0), lambda acc, s: s["_end"] + acc * F.pow(F.lit(keep), s["_n"]))
    both = held.join(ends.select(*keys, "_blk", carry.alias("_carry")), [*keys, "_blk"])
    out = both.select(*keys, "_carry", F.posexplode("_out").alias("_k", "_v"))
    return out.select(*keys, F.col("_v.i").alias("i"), (F.col("_v.y") + F.col("_carry") * F.pow(F.lit(keep), F.col("_k") + 1)).alias("value"))
