"""Operators that split whole channels into blocks, against plain versions of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oscilla.functions import fourier
from oscilla.operators import emg, kernels, learn, neighbourhood


def channels(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    x = {f"c{n}": rng.normal(size=n) * 10 for n in sizes}
    return spark.createDataFrame([(c, i, float(v)) for c, xs in x.items() for i, v in enumerate(xs)], "channel string, i long, value double").repartition(3), x


def gathered(df, x, at="i"):
    got = {c: np.zeros(len(v), complex) for c, v in x.items()}
    rows = df.collect()
    for r in rows:
        got[r.channel][r[at]] = complex(r.re, r.im)
    assert len(rows) == sum(map(len, x.values()))
    return got


SIZES = [1, 2, 3, 60, 64, 97, 100, 101, 221, 256, 997, 1000]  # primes, products of large primes, powers, composites


@pytest.mark.parametrize("most", [16, 40, 1 << 20])
def test_transforms_in_blocks(spark, most):
    df, x = channels(spark, SIZES)
    for c, z in gathered(fourier.spectrum(df, most=most), x, "k").items():
        assert np.allclose(z, np.fft.fft(x[c]), atol=1e-8), c
    for c, z in gathered(fourier.analytic_signal(df, most=most), x).items():
        n = len(x[c])
        keep = np.array([1.0 if k == 0 or 2 * k == n else 2.0 if 2 * k < n else 0.0 for k in range(n)])
        assert np.allclose(z, np.fft.ifft(np.fft.fft(x[c]) * keep), atol=1e-8), c


def test_groups_stay_small():
    """No group is larger than ``most`` samples, or a factor of n; what has no split goes by a power of two."""
    for n in (10**9, 2**31 - 1, 6_000_000, 999_983, 1_048_577):
        p, q, direct = fourier._sizes(n, 1 << 20)
        assert p * q == n if direct else p * q >= 2 * n - 1 and p * q & (p * q - 1) == 0
        assert max(p, q) <= 1 << 20
    assert fourier._sizes(999_983, 1000)[2] is False and fourier._sizes(2**31 - 1, 1 << 20)[2] is False


def test_transform_of_awkward_channels(spark):
    rows = [("a", 0, 1.0), ("a", 3, None), ("a", 4, float("nan")), ("a", 5, 2.0), (None, 2, 3.0), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "channel string, i long, value double").withColumn("k", F.lit("clash"))
    for most in (2, 1 << 20):
        got = {(r.channel, r.k): complex(r.re, r.im) for r in fourier.spectrum(df, most=most).collect()}
        assert np.allclose([got["a", k] for k in range(6)], np.fft.fft([1, 0, 0, 0, 0, 2])) and np.allclose([got[None, k] for k in range(3)], np.fft.fft([0, 0, 3]))
        assert len(got) == 9
    assert fourier.spectrum(df.where("false")).count() == 0
    assert kernels.hilbert_envelope(df.where("false")).columns == ["channel", "i", "value"]


def test_long_channel_in_blocks(spark):
    """A tone of 600,000 samples has an envelope of one, in groups of 4,096 samples."""
    n = 600_000
    df = spark.range(n, numPartitions=4).select(F.lit(1).alias("channel"), F.col("id").alias("i"), F.cos(2 * np.pi * 5000 * F.col("id") / n).alias("value"))
    got = kernels.hilbert_envelope(df, most=4096).agg(F.count("*"), F.min("value"), F.max("value")).first()
    assert got[0] == n and abs(got[1] - 1) < 1e-8 and abs(got[2] - 1) < 1e-8


@pytest.mark.parametrize("size", [1, 2, 49, 101, 1001])
@pytest.mark.parametrize("center", [True, False])
def test_overlapping_segments_equal_direct_sums(spark, size, center):
    df, x = channels(spark, [1, 5, 300, 2500])
    w = np.random.default_rng(size).normal(size=size) + 0.5
    lo = size // 2 if center else size - 1
    for block, normalize in ((1 << 16, True), (700, False), (700, True)):
        got = fourier.convolved(df, list(w), lo, normalize, block=block).collect()
        assert len(got) == 2806
        for c, xs in x.items():
            mine = {r.i: r.value for r in got if r.channel == c}
            for i in [*range(0, len(xs), 97), len(xs) - 1]:
                k = [j for j in range(size) if 0 <= i - lo + j < len(xs)]
                total, under = sum(w[j] * xs[i - lo + j] for j in k), sum(w[j] for j in k)
                want = total / under if normalize else total
                assert abs(mine[i] - want) < 1e-7 * max(1, abs(want)) + (1e-6 if abs(under) < 1e-3 else 0)


def test_chooser_is_used(spark):
    df, _ = channels(spark, [400])
    w = [1.0 + k % 3 for k in range(60)]
    plans = {m: neighbourhood.convolve(df, w, method=m) for m in ("auto", "direct", "fft")}
    asked = {m: "FlatMapGroupsInPandas" in d._jdf.queryExecution().toString() for m, d in plans.items()}
    assert asked == {"auto": True, "direct": False, "fft": True}
    rows = {m: [r.value for r in d.orderBy("i").collect()] for m, d in plans.items()}
    assert np.allclose(rows["direct"], rows["fft"])
    assert "FlatMapGroupsInPandas" not in neighbourhood.convolve(df, w[:48])._jdf.queryExecution().toString()


def test_segments_with_gaps_and_nulls(spark):
    rows = [("a", i, None if i == 7 else float("nan") if i == 9 else float(i), "x") for i in range(40) if i not in (20, 21)] + [("b", 3, None, "y")]
    df = spark.createDataFrame(rows, "channel string, i long, value double, note string")
    w = [1.0, 2.0, 3.0]
    got = {(r.channel, r.i): r.value for r in fourier.convolved(df, w, 1).collect()}
    have = {i: float(i) for i in range(40) if i not in (7, 9, 20, 21)}
    assert len(got) == 39 and got["b", 3] is None
    for i in (0, 6, 7, 8, 19, 22, 39):
        k = [j for j in range(3) if i - 1 + j in have]
        assert abs(got["a", i] - sum(w[j] * have[i - 1 + j] for j in k) / sum(w[j] for j in k)) < 1e-9
    assert fourier.convolved(df.where("false"), w, 1).schema.names == df.columns


@pytest.mark.parametrize("window,order", [(1, 0), (5, 2), (9, 3), (31, 4)])
def test_savitzky_golay(spark, window, order):
    df, x = channels(spark, [1, 4, 31, 700])
    got = {(r.channel, r.i): r.value for r in neighbourhood.savitzky_golay(df, window, order).collect()}
    assert len(got) == 736
    for c, xs in x.items():
        n = len(xs)
        for i in range(n):
            lo = min(max(i - window // 2, 0), max(n - window, 0))
            part = xs[lo : lo + window]
            fit = np.polynomial.Polynomial.fit(np.arange(len(part)), part, min(order, len(part) - 1))
            assert abs(got[c, i] - fit(i - lo)) < 1e-6
    line = df.withColumn("value", 3.0 * F.col("i") - 2 + F.col("i") * F.col("i") * 0.5)
    if order >= 2:  # polynomials up to the order stay as they are, at the borders too
        assert neighbourhood.savitzky_golay(line, window, order).join(line.withColumnRenamed("value", "v"), ["channel", "i"]).agg(F.max(F.abs(F.col("value") - F.col("v")))).first()[0] < 1e-6


def test_peak_follower(spark):
    df, x = channels(spark, [1, 3, 4000])
    df = df.withColumn("value", F.when(F.col("i") == 2, None).otherwise(F.col("value"))).withColumn("note", F.lit("n"))
    for attack, release in ((0.0, 0.0), (0.001, 0.02), (0.05, 0.002)):
        up, down = (1.0 if t == 0 else 1 - np.exp(-1 / (1000 * t)) for t in (attack, release))
        got = neighbourhood.peak_follower(df, attack, release, 1000.0, block=64).collect()
        mine = {(r.channel, r.i): r.value for r in got}
        assert len(mine) == len(got) == 4004
        for c, xs in x.items():
            y = 0.0
            for i, v in enumerate(np.abs(xs).tolist()):
                y += 0.0 if i == 2 else (up if v > y else down) * (v - y)
                assert abs(mine[c, i] - y) < 1e-12
    with pytest.raises(ValueError):
        neighbourhood.peak_follower(df, -1, 0, 1.0)


def test_factor_analysis(spark):
    """Likelihood never falls, loadings and noise are found again, and scores are those of the plain formula."""
    rng = np.random.default_rng(7)
    w = np.array([[2, 0.0], [1.5, 0], [1, 0.3], [0, 1], [0, -0.8], [0.2, 0.5]])
    noise = np.array([0.5, 0.2, 0.4, 0.3, 0.6, 0.1])
    x = rng.normal(size=(20_000, 2)) @ w.T + rng.normal(size=(20_000, 6)) * np.sqrt(noise) + 5
    df = spark.createDataFrame([(i, i // 100, v.tolist()) for i, v in enumerate(x)], "t long, trial long, x array<double>")
    fit = learn.factors(df, 2)
    assert all(b >= a - 1e-6 for a, b in zip(fit.likelihood, fit.likelihood[1:])) and len(fit.likelihood) > 3
    assert np.allclose(fit.loadings @ fit.loadings.T, w @ w.T, atol=0.1) and np.allclose(fit.noise, noise, atol=0.06)
    under = fit.loadings.T @ np.diag(1 / fit.noise)
    inner = under @ fit.loadings
    assert abs(inner[0, 1]) < 1e-6 * inner[0, 0] and inner[0, 0] > inner[1, 1]
    got = np.array([r.components for r in fit.transform(df).orderBy("t").limit(50).collect()])
    cov = fit.loadings @ fit.loadings.T + np.diag(fit.noise)
    assert np.allclose(got, (x[:50] - x.mean(axis=0)) @ np.linalg.inv(cov) @ fit.loadings, atol=1e-8)
    other = learn.Factors(*learn.vector_covariance(df), 2, start=rng.normal(size=(6, 2)) * 0.3, tolerance=1e-12, iterations=5000)
    same = learn.Factors(*learn.vector_covariance(df), 2, tolerance=1e-12, iterations=5000)
    assert np.allclose(other.loadings, same.loadings, atol=1e-3)
    model, rows, metrics, _ = learn.trajectories(df, "fa", 2)
    assert isinstance(model, learn.Factors) and metrics.count() == 200 and len(rows.first()["components"]) == 2
    constant = spark.createDataFrame([([1.0, 2.0, 3.0],)] * 4, "x array<double>")
    assert np.allclose([r.components for r in learn.factors(constant, 1).transform(constant).collect()], 0)
    with pytest.raises(ValueError):
        learn.factors(df, 7)
    with pytest.raises(ValueError, match="unknown trajectories"):
        learn.trajectories(df, "xyz")


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 200):
        r = rng.permutation(n)
        assert emg._inversions(r) == sum(int((r[:j] > r[j]).sum()) for j in range(n))


@pytest.mark.parametrize("pairs", [0, 1 << 17])
def test_median_of_slopes(pairs):
    rng = np.random.default_rng(2)
    series = [rng.normal(size=(2, n)) for n in (2, 3, 4, 5, 40, 41, 90)]
    series += [rng.integers(0, 4, (2, n)).astype(float) for n in (5, 12, 60)]  # ties in both
    series += [np.stack([np.arange(50.0), 3 * np.arange(50.0) + 1]), np.stack([np.arange(30.0), np.zeros(30)]), np.stack([np.arange(30.0), -1e9 * np.arange(30.0) ** 3]), np.stack([np.ones(6), np.arange(6.0)])]
    for x, y in series:
        slopes = [(y[j] - y[i]) / (x[j] - x[i]) for i in range(len(x)) for j in range(len(x)) if x[j] > x[i]]
        got = emg.median_slope(x, y, pairs)
        assert (np.isnan(got) and not slopes) or abs(got - np.median(slopes)) <= 1e-9 * max(1.0, abs(np.median(slopes)))


def test_slope_of_a_long_series(spark):
    """300,000 segments, 45 thousand million pairs."""
    df = spark.range(300_000).select(F.lit("a").alias("channel"), F.col("id").alias("segment"), (F.col("id") * 0.25 + F.sin(F.col("id")) * 40 + F.when(F.col("id") % 10 == 0, 1e6).otherwise(0)).alias("v"))
    df = df.unionByName(spark.createDataFrame([("b", 1, 2.0), ("b", None, 1.0), ("b", 3, None), ("c", 1, 1.0), ("c", 3, 5.0), (None, 0, 0.0), (None, 2, 1.0)], "channel string, segment long, v double"))
    got = {r.channel: r.slope for r in emg.robust_slope(df, "v").collect()}
    assert set(got) == {"a", "c", None} and abs(got["a"] - 0.25) < 1e-4 and got["c"] == 2.0 and got[None] == 0.5
    assert emg.robust_slope(df.where("false"), "v").count() == 0
