"""Muscle-activity metrics: time-domain features by segment, timing, bursts, rate coding, fatigue trends.

Segments are (channel, segment, k, value) with k the sample within the segment.  All are plain
aggregates; lag and lead windows stay inside a segment.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BY = ("channel", "segment")


def cut(df: DataFrame, size: int) -> DataFrame:
    """A signal in segments of ``size`` samples."""
    return df.select("channel", F.floor(F.col("i") / size).alias("segment"), F.pmod(F.col("i"), F.lit(size)).alias("k"), "value")


def _near(seg: DataFrame, by: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("k")
    return seg.withColumn("_a", F.lag("value").over(w)).withColumn("_b", F.lead("value").over(w))


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def time_features(seg: DataFrame, limit: float = 1e-4, by: tuple[str, ...] = BY) -> DataFrame:
    """MAV, RMS, variance, SSI, IEMG, waveform length, zero crossings and slope sign changes per sample."""
    x, a, b = F.col("value"), F.col("_a"), F.col("_b")
    step = x - a
    cross = (((x > 0) & (a < 0)) | ((x < 0) & (a > 0))) & (F.abs(step) > limit)
    turn = (((x > a) & (x > b)) | ((x < a) & (x < b))) & ((F.abs(x - a) > limit) | (F.abs(x - b) > limit))
    return _near(seg, by).groupBy(*by).agg(
        F.avg(F.abs(x)).alias("mav"), F.sqrt(F.avg(x * x)).alias("rms"), F.var_pop(x).alias("variance"), F.sum(x * x).alias("ssi"), F.sum(F.abs(x)).alias("iemg"),
        F.coalesce(F.sum(F.abs(step)), F.lit(0.0)).alias("waveform_length"), (_count(cross) / F.count("*")).alias("zc_rate"), (_count(turn) / F.count("*")).alias("ssc_rate"),
    )


def histogram_features(seg: DataFrame, bins: int = 20, by: tuple[str, ...] = BY) -> DataFrame:
    """Population skewness and excess kurtosis, entropy (bits) of equal bins over the range, median."""
    x = F.col("value")
    st = seg.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("sd"), F.percentile(x, F.lit(0.5)).alias("median"))
    both = seg.join(st, list(by))
    z = F.try_divide(x - F.col("m"), F.col("sd"))
    shape = both.groupBy(*by).agg(F.coalesce(F.avg(z * z * z), F.lit(0.0)).alias("skewness"), F.coalesce(F.avg(z * z * z * z) - 3, F.lit(0.0)).alias("kurtosis"))
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)))
    p = both.groupBy(*by, "n", bin_.alias("_b")).agg((F.count("*") / F.col("n")).alias("_p"))
    entropy = p.groupBy(*by).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))
    return st.select(*by, "median").join(shape, list(by)).join(entropy, list(by))


def time_indices(seg: DataFrame, wilson: float = 0.1, myopulse: float = 0.5, by: tuple[str, ...] = BY) -> DataFrame:
    """Fatigue indices of the time domain; thresholds follow the segment's greatest magnitude and mean."""
    x, a, b, t = F.col("value"), F.col("_a"), F.col("_b"), F.col("_t")
    st = seg.groupBy(*by).agg(F.max(F.abs(x)).alias("_peak"), F.avg(F.abs(x)).alias("_mav"), F.count("*").alias("_n"))
    rows = _near(seg, by).join(st, list(by)).withColumn("_t", 1e-4 * F.col("_peak"))
    step = F.abs(x - a)
    edge = (F.col("k") < 0.25 * F.col("_n")) | (F.col("k") > 0.75 * F.col("_n"))
    weight = F.when(edge, 0.5).otherwise(1.0)
    turn = (((x > a) & (x > b)) | ((x < a) & (x < b))) & ((step >= t) | (F.abs(x - b) >= t))
    cross = (((x > 0) & (a < 0)) | ((x < 0) & (a > 0))) & (step >= t)
    n = F.max("_n")
    return rows.groupBy(*by).agg(
        F.avg(F.abs(x)).alias("mav"), F.sqrt(F.avg(x * x)).alias("rms"), F.sum(F.abs(x)).alias("iemg"), (F.sum(weight * F.abs(x)) / F.sum(weight)).alias("mmav"),
        F.sum(step).alias("waveform_length"), (_count(turn) / F.greatest(n - 2, F.lit(1))).alias("ssc"), (_count(cross) / F.greatest(n - 1, F.lit(1))).alias("zc"),
        F.avg(step).alias("mean_step"), (_count(step > wilson * F.col("_peak")) / F.greatest(n - 1, F.lit(1))).alias("wilson"), (_count(F.abs(x) > myopulse * F.col("_mav")) / n).alias("myopulse"),
    )


def fatigue_ratios(seg: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Zero-crossing rate, rms and peak over the mean magnitude, 1 - zero-crossing rate, and its variation; 0 with three samples or fewer."""
    x = F.col("value")
    g = _near(seg, by).groupBy(*by).agg(
        F.avg(F.abs(x)).alias("_m"), F.sqrt(F.avg(x * x)).alias("_r"), F.max(F.abs(x)).alias("_p"), F.stddev_pop(F.abs(x)).alias("_s"), _count(x * F.col("_a") < 0).alias("_z"), F.count("*").alias("_n")
    )
    zc = F.try_divide(F.col("_z"), F.col("_n") - 1)
    over = lambda c: F.when((F.col("_n") > 3) & (F.col("_m") > 0), c / F.col("_m")).otherwise(0.0)
    return g.select(
        *by, over(zc).alias("zc_mav"), over(F.col("_r")).alias("rms_mav"), over(F.col("_p")).alias("peak_mav"), F.when(F.col("_n") > 3, 1 - zc).otherwise(0.0).alias("one_less_zc"), over(F.col("_s")).alias("variation")
    )


def trend(metrics: DataFrame, value: str, window: int = 10, by: tuple[str, ...] = ("channel",), at: str = "segment") -> DataFrame:
    """Slope of the moving mean (of full windows) of a metric over x in [0, 1], divided by its mean."""
    w = Window.partitionBy(*by).orderBy(at)
    f = w.rowsBetween(0, window - 1)
    rows = metrics.withColumn("_v", F.avg(value).over(f)).withColumn("_c", F.count("*").over(f)).where(F.col("_c") == window)
    rows = rows.withColumn("_j", F.row_number().over(w) - 1)
    last = rows.groupBy(*by).agg(F.max("_j").alias("_last"))
    rows = rows.join(last, list(by)).withColumn("_x", F.col("_j") / F.greatest(F.col("_last"), F.lit(1)))
    return rows.groupBy(*by).agg(F.regr_slope("_v", "_x").alias("_s"), F.avg("_v").alias("_m")).select(*by, F.when(F.col("_m") != 0, F.col("_s") / F.col("_m")).alias("trend"))


def _inversions(rank: np.ndarray) -> int:
    """Pairs i < j with rank[i] > rank[j], of ranks 0 .. n - 1, a bit at a time: each level is a stable partition of every group."""
    n, total, a = len(rank), 0, rank
    for bit in range(max(n - 1, 1).bit_length() - 1, -1, -1):
        group = a >> (bit + 1)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        start = np.repeat(begin, np.diff(np.append(begin, n)))
        one = (a >> bit) & 1
        ones = np.cumsum(one) - one
        ones -= ones[start]
        zeros = np.arange(n) - start - ones
        total += int(ones[one == 0].sum())
        zeros_of = np.add.reduceat(1 - one, begin) if n else begin
        to = start + np.where(one == 1, np.repeat(zeros_of, np.diff(np.append(begin, n))) + ones, zeros)
        out = np.empty_like(a)
        out[to] = a
        a = out
    return total


def median_slope(x: np.ndarray, y: np.ndarray, pairs: int = 1 << 17) -> float:
    """The median of the slopes of all pairs with different x (NaN if there is none), without making the pairs.

    How many slopes are at most s is a count of inversions: a pair's slope is at most s if y - s x does not rise along it.  So the
    median is found by halving an interval of slopes, to the last digits; up to ``pairs`` pairs are made outright.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)
    same = np.unique(x, return_counts=True)[1]
    total = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
    if not total:
        return float("nan")
    if n * (n - 1) // 2 <= pairs:
        i, j = np.triu_indices(n, 1)
        apart = x[j] > x[i]
        return float(np.median((y[j] - y[i])[apart] / (x[j] - x[i])[apart]))

    def at_most(s: float) -> int:
        z = y - s * x
        # among equal x ascending, so that they are no inversions; equal z of different x are
        line = np.lexsort((z, x))
        zs, xs = z[line], x[line]
        by_z = np.lexsort((-np.arange(n), zs))
        rank = np.empty(n, np.int64)
        rank[by_z] = np.arange(n)
        twins = np.diff(np.append(np.flatnonzero(np.concatenate([[True], (xs[1:] != xs[:-1]) | (zs[1:] != zs[:-1])])), n))
        return _inversions(rank) - int((twins * (twins - 1) // 2).sum())

    rng = np.random.default_rng(1)
    i, j = rng.integers(0, n, (2, 4096))
    some = x[i] != x[j]
    guess = np.sort((y[i] - y[j])[some] / (x[i] - x[j])[some]) if some.any() else np.zeros(1)
    reach = float((y.max() - y.min()) / np.diff(np.unique(x)).min())  # no slope is steeper

    def smallest(k: int) -> float:
        """The least s that k slopes do not exceed."""
        lo, hi = -reach, reach
        for q in (0.5 - 0.04, 0.5 + 0.04):
            s = float(guess[min(int(len(guess) * q), len(guess) - 1)])
            if lo < s < hi:
                lo, hi = (lo, s) if at_most(s) >= k else (s, hi)
        while hi - lo > 1e-13 * max(abs(lo), abs(hi), 1e-300):
            s = 0.5 * (lo + hi)
            if s in (lo, hi):
                break
            lo, hi = (lo, s) if at_most(s) >= k else (s, hi)
        return hi

    first = smallest((total + 1) // 2)
    if total % 2 or at_most(first * (1 + 1e-12) if first else 1e-300) >= total // 2 + 1:
        return first
    return 0.5 * (first + smallest(total // 2 + 1))


def robust_slope(metrics: DataFrame, value: str, by: tuple[str, ...] = ("channel",), at: str = "segment") -> DataFrame:
    """Theil-Sen: the median of the slopes of all pairs of a series of segments, by counting; rows without a place or value are left out.

    A task holds the series of one channel, two numbers a segment.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        slope = median_slope(pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float))
        return pd.DataFrame([(*key, None if slope != slope else slope)], columns=[*by, "slope"])

    rows = metrics.select(*by, F.col(at).cast("double").alias("_x"), F.col(value).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL AND NOT isnan(_y)")
    out = rows.groupBy(*by).applyInPandas(run, T.StructType([*(metrics.schema[k] for k in by), T.StructField("slope", T.DoubleType())]))
    return out.where("slope IS NOT NULL")


def activation_timing(events: DataFrame, fs: float, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Durations of events, and intervals between successive onsets."""
    dur = (F.col("offset_idx") - F.col("onset_idx")) / fs
    rows = events.withColumn("_d", dur).withColumn("_g", (F.col("onset_idx") - F.lag("onset_idx").over(Window.partitionBy(*by).orderBy("onset_idx"))) / fs)
    four = lambda c, name: [F.avg(c).alias(f"mean_{name}"), F.stddev_pop(c).alias(f"std_{name}"), F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}")]
    return rows.groupBy(*by).agg(F.count("*").alias("n_events"), *four("_d", "duration"), *four("_g", "interval"))


def burst_metrics(df: DataFrame, events: DataFrame, fs: float, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Mean, peak, area and rms of the magnitude inside each event."""
    rows = events.withColumn("i", F.explode(F.sequence(F.col("onset_idx"), F.col("offset_idx") - 1))).join(df, [*keys, "i"])
    x = F.abs("value")
    return rows.groupBy("event_id", *keys).agg(F.avg(x).alias("mean_amplitude"), F.max(x).alias("peak_amplitude"), (F.sum(x) / fs).alias("area"), F.sqrt(F.avg(x * x)).alias("rms"))


def rate_coding(events: DataFrame, window: int, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Onsets in tumbling windows that begin at the first onset; the rest beyond the last whole window is left out."""
    st = events.groupBy(*by).agg(F.min("onset_idx").alias("_a"), F.floor((F.max("onset_idx") - F.min("onset_idx")) / window).cast("int").alias("_n"))
    counts = events.join(st, list(by)).groupBy(*by, F.floor((F.col("onset_idx") - F.col("_a")) / window).cast("int").alias("bin")).agg(F.count("*").alias("_c"))
    full = st.where("_n > 0").select(*by, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("bin"))
    return full.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("_c", F.lit(0)).cast("long").alias("count"))


def coactivation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of the samples covered by two channels' valid events: intersection, union, index."""
    listed = lambda e, name: e.where("offset_idx > onset_idx").select(F.explode(F.sequence(F.col("onset_idx"), F.col("offset_idx") - 1)).alias("i")).distinct().withColumn(name, F.lit(1))
    both = listed(a, "_a").join(listed(b, "_b"), "i", "full")
    return both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("intersection"), F.count("*").alias("union_size")).withColumn(
        "coactivation", F.when(F.col("union_size") > 0, F.col("intersection") / F.col("union_size")).otherwise(0.0)
    )


# ---- spectra given as rows (channel, frame, freq, power) --------------------------------------


def spectral_indices(spectrum: DataFrame, by: tuple[str, ...] = ("channel", "frame"), low: tuple[float, float] = (20, 45), high: tuple[float, float] = (80, 150)) -> DataFrame:
    """Mean, median (linear inside its bin), central second moment, band ratio and entropy of each frame; null without power."""
    f, p = F.col("freq"), F.col("power")
    w = Window.partitionBy(*by).orderBy("freq")
    rows = spectrum.withColumn("_c", F.sum(p).over(w)).withColumn("_t", F.sum(p).over(Window.partitionBy(*by))).withColumn("_pf", F.lag("freq").over(w)).withColumn("_pc", F.lag("_c").over(w))
    rows = rows.withColumn("_mu", F.try_divide(F.sum(f * p).over(Window.partitionBy(*by)), F.col("_t")))
    half = F.col("_t") / 2
    crossing = (F.col("_c") >= half) & (F.coalesce("_pc", F.lit(0.0)) < half)
    at = F.when(F.col("_pf").isNull(), f).otherwise(F.col("_pf") + F.try_divide(half - F.col("_pc"), F.col("_c") - F.col("_pc")) * (f - F.col("_pf")))
    q = F.try_divide(p, F.col("_t"))
    inside = lambda b: F.sum(F.when(f.between(*b), p).otherwise(0.0))
    ok = lambda c: F.when(F.max("_t") > 0, c)
    return rows.groupBy(*by).agg(
        ok(F.max("_mu")).alias("mean_frequency"), ok(F.min(F.when(crossing, at))).alias("median_frequency"), ok(F.try_divide(F.sum((f - F.col("_mu")) * (f - F.col("_mu")) * p), F.max("_t"))).alias("variance"),
        F.try_divide(inside(low), inside(high)).alias("band_ratio"), ok(F.try_divide(-F.sum(F.when(q > 0, q * F.log(q)).otherwise(0.0)), F.log(F.count("*")))).alias("entropy"), F.sum(p).alias("total_power"),
    )


def fatigue_summary(indices: DataFrame, value: str = "median_frequency", edge: int = 10, by: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Slope over frames, percent change against the first frames' mean, and the fatigue index of first against last frames."""
    w = Window.partitionBy(*by)
    rows = indices.withColumn("_j", F.row_number().over(w.orderBy("frame")) - 1).withColumn("_n", F.count("*").over(w))
    v = F.col(value)
    g = rows.groupBy(*by).agg(F.regr_slope(v, F.col("_j")).alias("slope"), F.avg(F.when(F.col("_j") < edge, v)).alias("_a"), F.avg(F.when(F.col("_j") >= F.col("_n") - edge, v)).alias("_b"))
    return g.select(*by, "slope", (F.try_divide(F.col("slope"), F.col("_a")) * 100).alias("percent_change"), (F.try_divide(F.col("_a") - F.col("_b"), F.col("_a")) * 100).alias("fatigue_index"))
