"""Per-channel kernels that the built-in functions cannot express: Arrow batches to numpy and back."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oscilla.functions import fourier


def _kind(df: DataFrame) -> str:
    return dict(df.dtypes)["channel"]


def hilbert_envelope(df: DataFrame, most: int = fourier.MOST) -> DataFrame:
    """Magnitude of the analytic signal over the whole channel, whose transform runs in groups of ``most`` samples."""
    z = fourier.analytic_signal(df.select("channel", "i", "value"), most=most)
    return z.select("channel", "i", F.hypot("re", "im").alias("value"))


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2, normalize: bool = True) -> float:
    """-ln(A / B) over pairs of templates within r (Chebyshev), self matches left out; infinite if A or B is 0."""
    x = np.asarray(x, float)
    tol = r * (x.std() or 1.0) if normalize else r

    def matches(k: int) -> int:
        t = np.lib.stride_tricks.sliding_window_view(x, k)[: len(x) - m]
        return sum(int((np.abs(t[i + 1 :] - t[i]).max(axis=1) <= tol).sum()) for i in range(len(t) - 1))

    if len(x) < m + 2:
        return math.inf
    b, a = matches(m), matches(m + 1)
    return -math.log(a / b) if a and b else math.inf


def sample_entropies(x: np.ndarray, m: int = 2, r: float = 0.2) -> np.ndarray:
    """:func:`sample_entropy` of each row of ``x``, all pairs of a row's samples at once."""
    rows, size = x.shape
    if size < m + 2:
        return np.full(rows, np.inf)
    out, step = np.full(rows, np.inf), max(1, (1 << 20) // (size * size))
    for at in range(0, rows, step):
        v = x[at : at + step]
        tol = r * v.std(axis=1)
        tol = np.where(tol == 0, r, tol)[:, None, None]
        close, n = np.abs(v[:, :, None] - v[:, None, :]) <= tol, size - m
        same = np.tri(n, k=-1, dtype=bool) & close[:, :n, :n]
        for k in range(1, m):
            same &= close[:, k : k + n, k : k + n]
        b = same.sum(axis=(1, 2))
        a = (same & close[:, m : m + n, m : m + n]).sum(axis=(1, 2))
        some = (a > 0) & (b > 0)
        out[at : at + step][some] = -np.log(a[some] / b[some])
    return out


def windowed_entropy(df: DataFrame, size: int, step: int, m: int = 2, r: float = 0.2) -> DataFrame:
    """Sample entropy of windows: channel, frame, value (null where infinite)."""
    from oscilla.operators.spectral import frames

    @F.pandas_udf("double")
    def entropy(x: pd.Series) -> pd.Series:
        got = pd.Series(sample_entropies(np.stack(x.to_list()).astype(float), m, r) if len(x) else [], dtype=float)
        return got.where(np.isfinite(got))

    return frames(df, size, step).select("channel", "frame", entropy("x").alias("value"))


def entropy_onsets(df: DataFrame, size: int, step: int, fs: float, k: float = 1.0, least: int = 5) -> DataFrame:
    """Runs of windows whose entropy is below mean - k std: onset_idx, offset_idx, amplitude, duration, entropy_drop."""
    from oscilla.functions.windows import runs

    e = windowed_entropy(df, size, step).withColumnRenamed("frame", "i")
    stat = e.groupBy("channel").agg((F.avg("value") - k * F.stddev_pop("value")).alias("_t"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    found = runs(e.join(stat, "channel"), F.col("value") < F.col("_t"))
    spans = found.withColumn("i", F.explode(F.sequence(F.col("first") - 3, F.col("last")))).join(e, ["channel", "i"])  # a run lists its windows and the three before
    drop = spans.groupBy("channel", "first", "last").agg(
        F.avg(F.when((F.col("i") > F.col("first") - 4) & (F.col("i") <= F.col("first")), F.col("value"))).alias("_b"), F.avg(F.when(F.col("i").between(F.col("first"), F.col("last")), F.col("value"))).alias("_e")
    )
    events = drop.select("channel", (F.col("first") * step).alias("onset_idx"), (F.col("last") * step + size).alias("offset_idx"), (F.col("_b") - F.col("_e")).alias("entropy_drop"))
    inside = events.withColumn("i", F.explode(F.sequence("onset_idx", F.col("offset_idx") - 1))).join(df, ["channel", "i"])
    peak = inside.groupBy("channel", "onset_idx", "offset_idx", "entropy_drop").agg(F.max(F.abs("value")).alias("amplitude"))
    return peak.withColumn("duration", (F.col("offset_idx") - F.col("onset_idx")) / fs)


def template_correlation(df: DataFrame, template: list[float], normalized: bool = True, block: int = 1 << 16) -> DataFrame:
    """Correlation of each centre-aligned window with the z-scored template, block by block with a halo."""
    t = np.asarray(template, float)
    t = (t - t.mean()) / (t.std() or 1.0)
    w = len(t)
    lo, hi = w // 2, w - 1 - w // 2
    blk, at = F.floor(F.col("i") / block), F.pmod(F.col("i"), F.lit(block))
    rows = df.select("channel", "i", "value").withColumn("_blk", F.explode(F.array_compact(F.array(blk, F.when(at < hi, blk - 1), F.when(at >= block - lo, blk + 1)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, i = pdf["value"].to_numpy(float), pdf["i"].to_numpy()
        got = np.full(len(x), np.nan)
        if len(x) >= w:
            v = np.lib.stride_tricks.sliding_window_view(x, w)
            sd = v.std(axis=1)
            got[lo : len(x) - hi] = (v @ t / w) / np.where(sd > 0, sd, 1) if normalized else v @ t / w
        keep = (i // block == pdf["_blk"].to_numpy()) & ~np.isnan(got)
        return pd.DataFrame({"channel": pdf["channel"].to_numpy()[keep], "i": i[keep], "value": got[keep]})

    return rows.groupBy("channel", "_blk").applyInPandas(run, f"channel {_kind(df)}, i long, value double")


def template_matches(df: DataFrame, template: list[float], threshold: float = 0.6, distance: int = 1) -> DataFrame:
    """Local maxima of the correlation beyond the threshold; within the distance the higher one replaces the lower."""
    from oscilla.functions.windows import highest_within, over_neighbours

    c = template_correlation(df, template)
    near = over_neighbours(c, 1, 1, lambda d, w: d.withColumn("_a", F.lag("value").over(w)).withColumn("_b", F.lead("value").over(w)))
    found = near.where((F.col("value") > threshold) & (F.col("value") >= F.coalesce("_a", F.lit(-2.0))) & (F.col("value") > F.coalesce("_b", F.lit(-2.0))))
    return highest_within(found.select("channel", "i", "value"), distance, "value").select("channel", F.col("i").alias("index"), F.col("value").alias("correlation"))


def changepoint_probability(x: np.ndarray, hazard: float = 0.01, variance: bool = True, longest: int | None = None) -> np.ndarray:
    """P(run length = 0) by the forward recursion over segment starts; normal segments with fitted mean (and variance, 1e-8 at least).

    ``longest`` bounds the segments that are considered, so that work grows with the samples and not with their square.
    """
    n = len(x)
    x = x - (x.mean() if n else 0.0)
    c1, c2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    log = np.full(n + 1, -np.inf)
    log[0] = 0.0
    out = np.zeros(n)
    for t in range(1, n + 1):
        s = np.arange(max(0, t - longest) if longest else 0, t)
        k = t - s
        mean = (c1[t] - c1[s]) / k
        ss = np.maximum(c2[t] - c2[s] - k * mean * mean, 0)
        var = np.maximum(ss / k, 1e-8) if variance else np.ones(len(k))
        like = -0.5 * (k * np.log(2 * np.pi * var) + ss / var)
        score = log[s] + like + (k - 1) * math.log(1 - hazard) + math.log(hazard)
        log[t] = np.logaddexp.reduce(score)
        out[t - 1] = math.exp(min(0.0, score[-1] - log[t]))
    return out


def changepoints(
    df: DataFrame, hazard: float = 0.01, threshold: float = 0.3, distance: int = 10, variance: bool = True, fs: float = 1.0, min_samples: int = 0, longest: int | None = None
) -> DataFrame:
    """Local maxima of the changepoint probability, thinned by ``distance`` and paired in turn as onset and offset: onset_idx, offset_idx, probability (at the onset), duration.

    Events shorter than ``min_samples`` are dropped.  The recursion runs over a whole channel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        p, i = changepoint_probability(pdf["value"].to_numpy(float), hazard, variance, longest), pdf["i"].to_numpy()
        at: list[int] = []
        for k in np.flatnonzero((p[1:-1] > threshold) & (p[1:-1] > p[:-2]) & (p[1:-1] >= p[2:])) + 1 if len(p) > 2 else ():
            if not at or k - at[-1] >= distance:
                at.append(int(k))
        pairs = [(pdf["channel"].iloc[0], int(i[a]), int(i[b]), float(p[a]), (b - a) / fs) for a, b in zip(at[::2], at[1::2], strict=False) if b - a >= min_samples]
        return pd.DataFrame(pairs, columns=["channel", "onset_idx", "offset_idx", "probability", "duration"])

    return df.select("channel", "i", "value").groupBy("channel").applyInPandas(run, f"channel {_kind(df)}, onset_idx long, offset_idx long, probability double, duration double")


# ---- template subtraction ---------------------------------------------------------------------


def subtract(x: np.ndarray, at: np.ndarray, template: np.ndarray, reach: int = 0) -> np.ndarray:
    """Subtract the least-squares scaled template at each index in turn, at the best lag within ``reach``; overlaps interact."""
    y, w, half = x.astype(float).copy(), len(template), len(template) // 2
    power = float(template @ template)
    for k in np.sort(at):
        best = None
        for lag in range(-reach, reach + 1):
            lo = int(k) - half + lag
            if lo < 0 or lo + w > len(y):
                continue
            c = float(y[lo : lo + w] @ template)
            if best is None or abs(c) > abs(best[1]):
                best = (lo, c)
        if best and power > 0:
            y[best[0] : best[0] + w] -= best[1] / power * template
    return y


def dtw_path(a: np.ndarray, b: np.ndarray, band: int | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Least total squared difference under monotone warping inside a band, and the warping path."""
    n, m = len(a), len(b)
    band = max(band if band is not None else max(n, m), abs(n - m))
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - band), min(m, i + band) + 1):
            d[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(d[i - 1, j - 1], d[i - 1, j], d[i, j - 1])
    path, i, j = [], n, m
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: d[p])
    return float(d[n, m]), path[::-1]


def warp(template: np.ndarray, segment: np.ndarray, band: int | None = None) -> np.ndarray:
    """The template warped onto the segment: averages of what the path maps to each sample."""
    _, path = dtw_path(segment, template, band)
    total, count = np.zeros(len(segment)), np.zeros(len(segment))
    for i, j in path:
        total[i] += template[j]
        count[i] += 1
    return total / np.maximum(count, 1)


def warped_templates(segments: np.ndarray, template: np.ndarray, band: int | None = None) -> np.ndarray:
    """:func:`warp` of the template onto each row of ``segments``: the table of totals, cell by cell, for all rows at once."""
    rows, n = segments.shape
    m = len(template)
    band = max(band if band is not None else max(n, m), abs(n - m))
    cells = [(i, j) for i in range(1, n + 1) for j in range(max(1, i - band), min(m, i + band) + 1)]
    out, step = np.zeros((rows, n)), max(1, (1 << 21) // ((n + 1) * (m + 1)))
    for at in range(0, rows, step):
        x = segments[at : at + step]
        d = np.full((n + 1, m + 1, len(x)), np.inf)
        d[0, 0] = 0
        for i, j in cells:
            d[i, j] = (x[:, i - 1] - template[j - 1]) ** 2 + np.minimum(np.minimum(d[i - 1, j - 1], d[i - 1, j]), d[i, j - 1])
        on = np.zeros(d.shape, bool)
        on[n, m] = True
        for i, j in reversed(cells):  # the path backwards: the first least of the three cells before
            a, b, c, here = d[i - 1, j - 1], d[i - 1, j], d[i, j - 1], on[i, j]
            first = (a <= b) & (a <= c)
            second = ~first & (b <= c)
            on[i - 1, j - 1] |= here & first
            on[i - 1, j] |= here & second
            on[i, j - 1] |= here & ~first & ~second
        total, count = np.zeros((n, len(x))), on[1:, 1:].sum(axis=1)
        for j in range(m):
            total += on[1:, j + 1] * template[j]
        out[at : at + step] = (total / np.maximum(count, 1)).T
    return out


def subtract_warped(x: np.ndarray, at: np.ndarray, template: np.ndarray, band: int | None = 10, within: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """As :func:`subtract` with warped templates; each reads the signal as it was, so overlaps do not interact.

    ``within`` gives for each index the first and last place its window may reach (else the signal's ends).
    """
    y, w = x.astype(float).copy(), len(template)
    lo = np.asarray(at, np.int64) - w // 2
    first, last = within if within is not None else (np.zeros(len(lo), np.int64), np.full(len(lo), len(x) - 1))
    lo = lo[(lo >= first) & (lo + w - 1 <= last)]
    if not len(lo):
        return y
    places = lo[:, None] + np.arange(w)
    segments = y[places]
    t = warped_templates(segments, template, band)
    power = (t * t).sum(axis=1)
    scale = np.divide((segments * t).sum(axis=1), power, out=np.zeros(len(t)), where=power > 0)
    np.subtract.at(y, places, scale[:, None] * t)
    return y


def subtract_templates(df: DataFrame, events: DataFrame, template: list[float], method: str = "correlation", reach: int = 0, band: int = 10, block: int = 1 << 16) -> DataFrame:
    """Template subtraction; events whose windows may touch are one ordered scan, and only the samples they reach go to Python.

    Stretches of such events are dealt by the block of their first one; an event that repeats counts once.  Samples outside every window pass as they are.
    """
    from oscilla.functions.windows import stretches

    t = np.asarray(template, float)
    half, size = len(t) // 2, len(t)
    marks = stretches(events.select("channel", "i").distinct(), size + 2 * reach + 1)
    reached = marks.select("channel", "_run", F.col("i").alias("at"), F.explode(F.sequence(F.col("i") - half - reach, F.col("i") - half + size - 1 + reach)).alias("i"))
    wanted = reached.groupBy("channel", "i", "_run").agg(F.max(F.col("at") == F.col("i")).alias("mark"))
    rows = df.select("channel", "i", "value").join(wanted, ["channel", "i"]).withColumn("_blk", F.floor(F.col("_run") / block))

    def warped(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.sort_values(["_run", "i"])  # runs do not touch, so this is the order of samples
        i, begin = part["i"].to_numpy(), np.flatnonzero(np.diff(part["_run"].to_numpy(), prepend=np.iinfo(np.int64).min))
        size_of = np.diff(np.append(begin, len(i)))
        first, last = np.repeat(i[begin], size_of) - i[0], np.repeat(i[begin + size_of - 1], size_of) - i[0]
        whole = np.zeros(int(i[-1] - i[0]) + 1)
        whole[i - i[0]] = part["value"].to_numpy(float)
        at = np.flatnonzero(part["mark"].to_numpy())
        y = subtract_warped(whole, i[at] - i[0], t, band, (first[at], last[at]))
        return part[["channel", "i"]].assign(new=y[i - i[0]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.sort_values(["_run", "i"]).groupby("_run"):
            i, x = part["i"].to_numpy(), part["value"].to_numpy(float)
            at = np.flatnonzero(part["mark"].to_numpy())
            # samples before a recording's begin or after its end are missing: places by sample number
            first = int(i[0])
            whole = np.zeros(int(i[-1]) - first + 1)
            whole[i - first] = x
            y = subtract(whole, i[at] - first, t, reach)
            out.append(part[["channel", "i"]].assign(new=y[i - first]))
        return pd.concat(out)

    new = rows.groupBy("channel", "_blk").applyInPandas(run if method == "correlation" else warped, f"channel {_kind(df)}, i long, new double")
    return df.select("channel", "i", "value").join(new, ["channel", "i"], "left").select("channel", "i", F.coalesce("new", "value").alias("value"))
