"""Signal operators: block independence, filters, kernels, pipelines, sources and streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oscilla.functions import windows
from oscilla.model import SignalMeta, long_to_wide, wide_to_long
from oscilla.operators import detect, emg, extract, filters, kernels, learn, neighbourhood, pointwise, spectral, spikes, view
from oscilla.plans.pipeline import Op, Pipeline, ProcessingNode, standard_pipeline
from oscilla.sources import datasets


def frame(spark, **channels):
    rows = [(c, i, float(v)) for c, x in channels.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "channel string, i long, value double").repartition(3)


def values(df, channel="a", col="value"):
    return np.array([r[col] for r in df.where(F.col("channel") == channel).orderBy("i").collect()])


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(2)
    return frame(spark, a=rng.normal(size=300), b=rng.normal(size=111))


@pytest.mark.parametrize("block", [4, 7, 64, 1 << 16])
def test_blocks_do_not_change_results(noise, block, monkeypatch):
    whole = {k: f(noise) for k, f in FORMS.items()}
    want = {k: values(v, "b") for k, v in whole.items()}
    monkeypatch.setattr(windows.over_neighbours, "__defaults__", (("channel",), block))
    for k, f in FORMS.items():
        assert np.allclose(values(f(noise), "b"), want[k]), k


FORMS = {
    "tkeo": neighbourhood.tkeo,
    "tkeo modified": lambda d: neighbourhood.tkeo(d, "modified"),
    "mean": lambda d: neighbourhood.moving(d, 5),
    "median": lambda d: neighbourhood.moving(d, 5, "median"),
    "weights": lambda d: neighbourhood.convolve(d, [1.0, 2.0, 3.0]),
    "edge weights": lambda d: neighbourhood.convolve(d, [1.0, 2.0, 3.0, 4.0], align="edge"),
    "comb": lambda d: neighbourhood.comb(d, 100.0, 300.0, -0.5),
}


def test_energy_of_a_sine_is_constant(spark):
    w = 2 * math.pi * 10 / 1000
    got = values(neighbourhood.tkeo(frame(spark, a=2 * np.sin(w * np.arange(1000)))))
    assert np.allclose(got, 4 * math.sin(w) ** 2, atol=1e-9)


def test_exponential_by_blocks(spark, noise):
    x = values(noise)
    y = [x[0]]
    for v in x[1:]:
        y.append(0.3 * v + 0.7 * y[-1])
    for block in (3, 50, 4096):
        assert np.allclose(values(neighbourhood.exponential(noise, 0.3, block=block)), y)


def test_edge_aligned_weights(spark):
    got = values(neighbourhood.convolve(frame(spark, a=[1, 2, 3, 4]), [1.0, 2.0, 4.0], align="edge"))
    assert np.allclose(got, [(2 * 1 + 4 * 2) / 6, (1 + 4 + 12) / 7, (2 + 6 + 16) / 7, (3 + 8) / 3])


def test_constant_channels(spark):
    flat = frame(spark, a=[5.0] * 8)
    for m in ("zscore", "minmax", "robust", "mad"):
        assert np.allclose(values(pointwise.normalize(flat, m)), 0)
    assert np.allclose(values(pointwise.normalize_for_view(flat)), 0)


def test_runs_and_refractory(spark):
    x = [0, 1, 1, 0, 1, 1, 1, 0, 1]
    df = frame(spark, a=x)
    got = sorted((r["first"], r["last"]) for r in windows.runs(df, F.col("value") > 0.5).collect())
    assert got == [(1, 2), (4, 6), (8, 8)]
    e = spark.createDataFrame([("a", i) for i in (0, 3, 5, 6, 11, 30, 33, 36)], "channel string, i long")
    assert sorted(r.i for r in windows.refractory(e, 5).collect()) == [0, 5, 11, 30, 36]
    assert windows.refractory(e, 0).count() == 8
    ev = detect.contractions(df, "absolute", 0.5, 1, 0).orderBy("onset_idx").collect()
    assert [(r.onset_idx, r.offset_idx) for r in ev] == [(1, 3), (4, 7)]


def test_band_join_is_the_plain_join(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 500, 80), rng.integers(0, 500, 90)
    left = spark.createDataFrame([(int(x),) for x in a], "l_at long")
    right = spark.createDataFrame([(int(x),) for x in b], "r_at long")
    for lo, hi in ((-5, 6), (0, 1), (-30, -2), (3, 40)):
        got = windows.band_join(left, right, lo, hi)
        assert got.count() == sum(lo <= y - x < hi for x in a for y in b)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_filter_designs():
    assert np.allclose(filters.design("butter", "lowpass", 0.25, 1.0, 2)[0], [0.29289322, 0.58578644, 0.29289322, 1, 0, 0.17157288], atol=1e-7)
    for family in filters.FAMILIES:
        for kind, cut, at in (("lowpass", 100, (1, 300)), ("highpass", 100, (450, 5)), ("bandpass", (80, 200), (126, 5)), ("bandstop", (80, 200), (1, 126))):
            for order in (2, 3, 4, 5):
                sos = filters.design(family, kind, cut, 1000.0, order)
                assert max(np.abs(np.roots(s[3:])).max() for s in sos) < 1
                h = np.abs(filters.response(sos, np.array(at, float), 1000.0))
                assert h[0] > 0.85 and h[1] < h[0], (family, kind, order, h)


def test_filters_by_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000) + 5
    df = frame(spark, a=x)
    sos = filters.design("butter", "bandpass", (50.0, 200.0), 1000.0, 3)
    whole = values(filters.apply(df, sos, block=1 << 16))
    assert np.allclose(values(filters.apply(df, sos, block=1200)), whole, atol=1e-9)
    assert np.allclose(values(filters.apply(df, sos, zero_phase=False, block=1200)), filters.filter_rows(sos, x), atol=1e-9)
    t = np.arange(4000)
    tone = values(filters.apply(frame(spark, a=np.sin(2 * np.pi * 100 * t / 1000) + 3), sos))
    assert np.allclose(tone[500:-500], np.sin(2 * np.pi * 100 * t / 1000)[500:-500], atol=0.02)


def test_envelope_and_spectrum(spark):
    t = np.arange(1000)
    df = frame(spark, a=3 * np.sin(2 * np.pi * 10 * t / 1000))
    assert np.allclose(values(kernels.hilbert_envelope(df)), 3, atol=1e-6)
    s = spectral.spectrogram(df, 100, 50, 1000.0).where("channel = 'a'").toPandas()
    assert set(s.loc[s.groupby("frame")["power"].idxmax(), "freq"]) == {10.0}
    high = frame(spark, a=np.sin(2 * np.pi * 100 * t / 1000))
    idx = emg.spectral_indices(spectral.spectrogram(high, 100, 100, 1000.0)).toPandas()
    assert np.allclose(idx["mean_frequency"], 100, atol=0.01)
    w = spectral.welch(df, 200, 1000.0).toPandas()
    assert w.loc[w["density"].idxmax(), "freq"] == 10.0 and abs(w["density"].sum() * 5 - 4.5) < 0.2
    assert spectral.filterbank(8, 64, 1000.0).shape == (8, 33)
    b = spectral.cosine_basis(8, 8)
    assert np.allclose(b @ b.T, np.eye(8))


def test_entropy_against_all_pairs():
    x = np.random.default_rng(1).normal(size=60)
    tol = 0.5 * x.std()
    n = {m: sum(max(abs(x[i : i + m] - x[j : j + m])) <= tol for i in range(58) for j in range(i + 1, 58)) for m in (2, 3)}
    assert kernels.sample_entropy(x, 2, 0.5) == pytest.approx(-math.log(n[3] / n[2]))
    assert kernels.sample_entropy(np.arange(3.0)) == math.inf


def test_templates(spark):
    t = np.hanning(15) * np.sin(np.arange(15.0))
    x = np.zeros(200)
    for k in (40, 100, 150):
        x[k - 7 : k + 8] += t
    df = frame(spark, a=x + np.random.default_rng(0).normal(0, 0.001, 200))
    got = sorted(r["index"] for r in kernels.template_matches(df, list(t), 0.95, 10).collect())
    assert got == [40, 100, 150]
    y = kernels.subtract(x, np.array([40]), t)
    assert np.allclose(y[33:48], 0)
    d, path = kernels.dtw_path(np.array([0, 1, 2.0]), np.array([0, 1, 1, 2.0]))
    assert d == 0 and path[0] == (0, 0) and path[-1] == (2, 3)
    e = spark.createDataFrame([("a", 40)], "channel string, i long")
    assert np.allclose(values(kernels.subtract_templates(frame(spark, a=x), e, list(t)))[38:43], 0)
    assert np.allclose(kernels.subtract_warped(x, np.array([40]), t)[38:43], 0)


def test_changepoints(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(12, 1, 60), rng.normal(0, 1, 60)])
    p = kernels.changepoint_probability(x)
    assert p.shape == (180,) and ((p >= 0) & (p <= 1)).all()
    assert kernels.changepoints(frame(spark, a=x), 0.01, 0.2, 10).columns == ["channel", "onset_idx", "offset_idx", "probability", "duration"]


def test_whitening_and_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.5, 0.3]])
    wide = spark.createDataFrame(pd.DataFrame(x, columns=["c0", "c1", "c2"]).assign(i=range(400)))
    got = learn.whiten(wide, ["c0", "c1", "c2"]).toPandas()[["c0", "c1", "c2"]]
    assert np.allclose(np.cov(got.T, ddof=0), np.eye(3), atol=1e-6)
    vec = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)
    pcs = learn.components(vec, 2)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(pcs.variance, want)
    z = np.array(pcs.transform(vec).orderBy("id").toPandas()["components"].tolist())
    assert np.allclose(z.var(axis=0, ddof=1), want)


def test_density_clusters(spark):
    pts = [(0, 0), (0, 1), (1, 0), (1, 1), (10, 10), (10, 11), (11, 10), (2, 1), (50, 50)]
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(pts)], "id long, x array<double>")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    got = {r.id: r.cluster for r in learn.dbscan(df, 1.0, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 7: 0, 4: 4, 5: 4, 6: 4, 8: -1}


def test_one_long_cluster(spark):
    n = 2000
    ids = [int(k) for k in np.random.default_rng(5).permutation(n)]
    df = spark.createDataFrame([(i, [float(k), 0.0]) for k, i in enumerate(ids)], "id long, x array<double>")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert {r.cluster for r in learn.dbscan(df, 1.0, 3).collect()} == {0}


def test_bic_counts_full_covariances():
    from types import SimpleNamespace

    model = SimpleNamespace(summary=SimpleNamespace(logLikelihood=-3.0))
    assert math.isclose(learn.bayes_information(model, 50, 2, 3), 6 + 19 * math.log(50))  # 1 weight, 6 means, 12 covariances


def test_psth_edges(spark):
    s = spark.createDataFrame([(1, 90), (1, 100), (1, 110), (1, 119), (1, 120), (2, 500)], "unit_id int, sample long")
    e = spark.createDataFrame([(0, 100)], "event_id long, sample long")
    got = {(r.unit_id, r.bin): r.mean_count for r in spikes.psth(s, e, 10, 20, 10, 1).collect()}
    # 90 is the first edge (dropped), 100 is on an edge (lower bin), 119 in the last, 120 outside
    assert got == {(1, 0): 1.0, (1, 1): 1.0, (1, 2): 1.0, (2, 0): 0.0, (2, 1): 0.0, (2, 2): 0.0}


def test_metrics_of_short_trains(spark):
    s = spark.createDataFrame([(1, 10, 0), (2, 10, 1), (2, 30, 2)], "unit_id int, sample long, event_id long")
    u = {r.unit_id: r for r in spikes.unit_summary(s, 10.0).collect()}
    assert u[1].mean_isi == 0 and u[2].mean_isi == 2.0
    assert {r.unit_id: r.presence_ratio for r in spikes.presence_ratio(s, 30, 100).collect()} == {1: None, 2: None}
    v = {r.unit_id: r.ratio for r in spikes.isi_violations(s, 100, 25).collect()}
    assert v[1] is None and v[2] == pytest.approx((1 / (2 * 2 * 25)) / (2 / 100))
    with pytest.raises(ValueError):
        spikes.firing_rates(s, 0)


def test_waveform_alignment(spark):
    x = np.zeros(60)
    x[31] = -5
    w = extract.waveforms(frame(spark, a=x), spark.createDataFrame([(1, "a", 30)], "event_id long, channel string, i long"), 5, 5, "min", 3, 3)
    got = {r.offset: r.value for r in w.collect()}
    assert got[0] == -5 and len(got) == 11 and got[5] == 0.0
    with pytest.raises(ValueError):
        extract.to_samples("t", 1.0, "minutes")


def test_pipeline_surface(spark, noise):
    p = Pipeline().add(Op("abs", pointwise.rectify), "shape").add(Op("mean", lambda d: neighbourhood.moving(d, 3), 1, {"window": 3}), "smooth")
    p.add(Op("first", lambda d: d), "shape", 0)
    assert [o.name for o in p.ops()] == ["first", "abs", "mean"]
    assert p.remove("shape", 7) is None and p.remove("shape", 0).name == "first"
    with pytest.raises(KeyError):
        p.ops(["none"])
    with pytest.raises(ValueError):
        p.process(noise, 10.0, 5, 2)
    assert p.process(noise, 10.0, 1.0, 2.0).where("channel = 'a'").count() == 10
    node = ProcessingNode(noise, 10.0).add(Op("abs", pointwise.rectify), "shape")
    df, info = node.process(return_info=True)
    assert info[0]["name"] == "abs" and df.where("value < 0").count() == 0
    assert node.history[0][1].startswith("process") and node.describe()[0]["group"] == "shape"
    assert standard_pipeline([Op("x", lambda d: d)]).group("default")[0].name == "x"


def test_stream_files(spark, tmp_path):
    wide = spark.createDataFrame([(i, float(i), float(-i)) for i in range(100)], "i long, left double, right double")
    folder = str(tmp_path / "x.ant")
    datasets.write_stream(wide, folder, SignalMeta("x", 10.0))
    back, meta = datasets.read_stream(spark, folder)
    assert meta.fs == 10.0 and meta.number_of_samples == 100 and meta.duration == 10.0 and back.count() == 100
    got = datasets.traces(spark, folder, 10, 13, [1]).orderBy("i").collect()
    assert [(r.channel, r.i, r.value) for r in got] == [(1, 10, -10.0), (1, 11, -11.0), (1, 12, -12.0)]
    plan = datasets.traces(spark, folder, 10, 13, [1])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(i,10)" in plan and "struct<i:bigint,1:double>" in plan
    assert long_to_wide(wide_to_long(back, ["0", "1"]), [0, 1]).where("c0 = i AND c1 = -i").count() == 100
    datasets.write_epochs(spark.createDataFrame([(1, 2, 3)], "data int, onset int, offset int"), str(tmp_path / "e"))
    assert datasets.read_epochs(spark, str(tmp_path / "e")).dtypes[1] == ("onset", "double")


def test_sorting_folder(spark, tmp_path):
    s = spark.createDataFrame([(1, 5), (2, 3), (1, 9)], "unit_id int, sample long")
    u = spark.createDataFrame([(1, "good"), (2, "noise")], "unit_id int, `group` string")
    folder = datasets.write_sorting(str(tmp_path / "sorted"), s, u, 30000.0, np.ones((2, 4, 1)))
    got, units, params = datasets.read_sorting(spark, folder, exclude=("noise",))
    assert sorted(r["sample"] for r in got.collect()) == [5, 9] and units.count() == 1 and params["sample_rate"] == 30000.0
    assert datasets.read_params("a = 'x'\nb=3\n# c=1\nd = False") == {"a": "x", "b": 3, "d": False}


def test_streams(spark, tmp_path):
    from oscilla.streaming import online

    rng = np.random.default_rng(9)
    x = rng.normal(size=60)
    for k in range(3):  # three files, three micro-batches
        part = pd.DataFrame({"channel": "a", "i": range(20 * k, 20 * k + 20), "value": x[20 * k : 20 * k + 20]})
        spark.createDataFrame(part, "channel string, i long, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("channel string, i long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df in (("ema", online.exponential(stream(), 0.3)), ("cross", online.crossings(stream(), 0.5, 4))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = [r.value for r in spark.table("ema").orderBy("i").collect()]
    y = [x[0]]
    for v in x[1:]:
        y.append(0.3 * v + 0.7 * y[-1])
    assert np.allclose(got, y)
    keep, last, was = [], -100, False
    for i, v in enumerate(x):
        if v > 0.5 and not was and i - last >= 4:
            keep.append(i)
            last = i
        was = v > 0.5
    assert sorted(r.i for r in spark.table("cross").collect()) == keep
    rates = online.rates(spark.createDataFrame([(1, "2024-01-01 00:00:10"), (1, "2024-01-01 00:00:50")], "unit_id int, ts string").withColumn("ts", F.to_timestamp("ts")))
    assert rates.first()["count"] == 2


def test_views(spark, noise):
    assert view.area(noise, "min").where("channel = 'a'").agg(F.countDistinct("fill")).first()[0] == 1
    assert view.sample_rows(noise, 50).count() < noise.count()


def test_running_stretches_and_runs_by_blocks(spark, monkeypatch):
    """Blocks change nothing: plain loops over events of two channels, with and without events in every block."""
    import random

    from oscilla.functions import windows

    rng = random.Random(3)
    events = sorted({(c, rng.randrange(4000), rng.randrange(9)) for c in "ab" for _ in range(150)})
    events = list({(c, i): (c, i, v) for c, i, v in events}.values())
    df = spark.createDataFrame(events, "channel string, i long, v int")
    for block in (50, 1 << 16):
        got = {(r.channel, r.i): (r.before, r.after, r.upto) for r in windows.running(windows.running(windows.running(df, "i", F.col("v"), "before", block=block), "i", F.col("i"), "after", backwards=True, block=block), "i", F.col("v"), "upto", strict=False, block=block).collect()}
        for c, i, v in events:
            early, late = [x for d, j, x in events if d == c and j < i], [j for d, j, _ in events if d == c and j > i]
            assert got[c, i] == (max(early, default=None), min(late, default=None), max([*early, v]))
    for distance in (2, 15, 200):
        want_first, want_best = [], []
        for c in "ab":
            kept, best = [], []
            for _, i, v in sorted(e for e in events if e[0] == c):
                if not kept or i - kept[-1] >= distance:
                    kept.append(i)
                if not best or i - best[-1][0] >= distance:
                    best.append((i, v))
                elif v > best[-1][1]:
                    best[-1] = (i, v)
            want_first += [(c, i) for i in kept]
            want_best += [(c, *x) for x in best]
        for block, group in ((1 << 16, 1 << 10), (64, 2), (7, 1)):  # chains over many blocks, and over many tables of blocks
            monkeypatch.setattr(windows, "SUPER", group)
            assert sorted((r.channel, r.i) for r in windows.refractory(df, distance, block=block).collect()) == want_first
            assert sorted((r.channel, r.i, r.v) for r in windows.highest_within(df, distance, "v", block=block).collect()) == want_best


def test_scans_of_awkward_events(spark):
    """Ties at one place, nulls, negative places, other columns, empty tables."""
    rows = [("a", -9, 1, None), ("a", -9, 3, "z"), ("a", -9, 3, "y"), ("a", -7, None, "n"), ("a", -2, 2, "m"), ("a", None, 9, "x"), ("a", 4, None, "q"), ("b", 5, None, "p"), (None, 5, 1, "r")]
    df = spark.createDataFrame(rows, "channel string, i long, v int, note string")
    for block in (1, 1 << 16):
        assert {tuple(r) for r in windows.refractory(df, 6, block=block).collect()} == {rows[0], rows[4], rows[6], rows[7], rows[8]}
        assert {tuple(r) for r in windows.highest_within(df, 8, "v", block=block).collect()} == {rows[2], rows[6], rows[7], rows[8]} | {("a", 4, None, "q")}
    assert windows.refractory(df.where("false"), 5).count() == 0 and windows.refractory(df, 5).schema == df.schema
    assert windows.refractory(df, 1).count() == len(rows)


def test_crowded_stretch_of_a_whole_channel(spark):
    """Half a million events with every gap below the distance: one chain, no task that holds it."""
    df = spark.range(0, 1_500_000, 3).select(F.lit("a").alias("channel"), F.col("id").alias("i"), F.pmod(F.col("id") * 7919, F.lit(10_007)).alias("v"))
    got = windows.refractory(df, 10).agg(F.count("*"), F.min("i"), F.max("i"), F.countDistinct(F.pmod("i", F.lit(12)))).first()
    assert tuple(got) == (125_000, 0, 1_499_988, 1)
    value = lambda i: i * 7919 % 10_007
    best = []
    for i in range(0, 1_500_000, 3):
        if not best or i - best[-1] >= 10:
            best.append(i)
        elif value(i) > value(best[-1]):
            best[-1] = i
    assert sorted(r.i for r in windows.highest_within(df, 10, "v").select("i").collect()) == best


def test_quantiles_are_exact(spark, monkeypatch):
    import numpy as np

    from oscilla.functions import quantiles as q

    rng = np.random.default_rng(4)
    rows = [("a", float(v)) for v in np.round(rng.lognormal(size=6000) * 50, 1)] + [("b", float(v)) for v in rng.normal(size=7)] + [("c", 5.0)] * 3000 + [("d", None)] + [("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "channel string, value double")
    shares = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    for small in (2000, 100_000):
        monkeypatch.setattr(q, "SMALL", small)
        got = {r.channel: r for r in q.quantiles(df, F.col("value"), shares, ("channel",)).collect()}
        assert set(got) == {"a", "b", "c", "e"}
        for c, r in got.items():
            x = [v for k, v in rows if k == c]
            for k, s in enumerate(shares):
                assert abs(r[f"q{k}"] - np.quantile(x, s)) < 1e-9, (c, s, small)
    r = q.quantiles(df, F.col("value"), [0.5]).first()
    assert abs(r.q0 - np.quantile([v for _, v in rows if v is not None], 0.5)) < 1e-9


def test_events_of_one_long_channel(spark):
    """Five million samples of one channel: no step gathers or orders them in one task."""
    import time

    from oscilla.operators import detect

    x = spark.range(5_000_000).select(F.lit("c").alias("channel"), F.col("id").alias("i"), F.abs(F.sin(F.col("id") * 0.37) * F.sin(F.col("id") * 0.00011)).alias("value"))
    began = time.perf_counter()
    events = detect.contractions(x, "absolute", 0.9, refractory_samples=5)
    n = events.count()
    assert n > 50_000 and time.perf_counter() - began < 240


def test_changepoints_of_a_step(spark):
    import numpy as np

    from oscilla.operators import kernels

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 150), rng.normal(8, 1, 100), rng.normal(0, 1, 150)])
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "channel string, i long, value double")
    for longest in (None, 260):
        got = kernels.changepoints(df, 0.001, 0.5, 10, False, 1000.0, 5, longest).collect()
        assert [(r.onset_idx, r.offset_idx) for r in got] == [(150, 250)] and abs(got[0].duration - 0.1) < 1e-12 and got[0].probability > 0.5
    assert kernels.changepoints(df, 0.001, 0.5, 10, False, min_samples=5000).count() == 0
    whole = kernels.changepoint_probability(x, 0.01, True)
    assert np.allclose(kernels.changepoint_probability(x, 0.01, True, 10_000), whole) and np.isfinite(whole).all()


def test_overlapping_templates_are_subtracted_in_turn(spark):
    import numpy as np

    from oscilla.operators import kernels

    rng = np.random.default_rng(7)
    x = rng.normal(size=500)
    at = [3, 40, 42, 47, 120, 300, 303, 306, 309, 495]
    t = [1.0, 2.0, 4.0, 2.0, 1.0]
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)] + [("quiet", i, 1.0) for i in range(9)], "channel string, i long, value double")
    events = spark.createDataFrame([("c", i) for i in at], "channel string, i long")
    for reach in (0, 3):
        for block in (10, 1 << 16):
            got = {(r.channel, r.i): r.value for r in kernels.subtract_templates(df, events, t, reach=reach, block=block).collect()}
            want = kernels.subtract(x, np.array(at), np.array(t), reach)
            assert max(abs(got["c", i] - v) for i, v in enumerate(want)) < 1e-12 and all(got["quiet", i] == 1.0 for i in range(9))
    warped = {r.i: r.value for r in kernels.subtract_templates(df.where("channel = 'c'"), events, t, "warped", band=2).collect()}
    apart = [3, 120, 495]
    want = kernels.subtract_warped(x, np.array(apart), np.array(t), 2)
    assert all(abs(warped[i] - want[i]) < 1e-12 for k in apart for i in range(k - 2, k + 3) if i < 500)


def test_choice_of_eps_and_mixture(spark):
    import numpy as np

    from oscilla.operators import learn

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.1, (40, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i * 7 % 120, list(map(float, v))) for i, v in enumerate(x)], "id long, x array<double>")
    scores = learn.density_scores(df, [0.001, 0.5, 30.0], 5)
    assert [r.clusters for r in scores.orderBy("eps").collect()] == [0, 3, 1]
    assert learn.choose_eps(scores) == 0.5 and learn.choose_eps(scores, "cluster_count") == 0.5 and learn.choose_eps(scores, "noise_ratio") in (0.5, 30.0)
    model, every = learn.choose_mixture(df, [1, 3, 6])
    assert min(every, key=every.get) == len(model.mean) >= 3
    assert learn.vector_covariance(df.where("false"))[2] == 0


def test_sorting_folder_with_templates_and_features(spark, tmp_path):
    from oscilla.sources import datasets

    rng = np.random.default_rng(11)
    rows = [(int(u), int(t), float(a), [float(a), 1.0, 2.0]) for u, t, a in zip(rng.integers(0, 3, 500), rng.integers(0, 10_000, 500), rng.normal(size=500), strict=True)]
    s = spark.createDataFrame(rows, "unit_id int, sample long, amplitude double, components array<double>")
    u = spark.createDataFrame([(k, "good") for k in range(3)], "unit_id int, group string")
    t = rng.normal(size=(3, 5, 2))
    folder = datasets.write_sorting(str(tmp_path / "sorted"), s, u, 30000.0, t)
    times, clusters, amplitudes, features = (np.load(f"{folder}/{n}.npy") for n in ("spike_times", "spike_clusters", "amplitudes", "pc_features"))
    assert sorted(zip(clusters.tolist(), times.tolist(), amplitudes.tolist(), strict=True)) == sorted((r[0], r[1], r[2]) for r in rows)
    assert (np.diff(times) >= 0).all() and features.shape == (500, 3) and np.allclose(features[:, 0], amplitudes, atol=1e-6)
    back = {(r.template, r.offset, r.channel): r.value for r in datasets.read_templates(spark, folder).collect()}
    assert len(back) == 30 and all(abs(back[k, j, c] - t[k, j, c]) < 1e-6 for k in range(3) for j in range(5) for c in range(2))
    spikes, _, params = datasets.read_sorting(spark, folder)
    assert spikes.count() == 500 and params["sample_rate"] == 30000.0
    empty = datasets.write_sorting(str(tmp_path / "none"), s.where("false"), u, 1.0)
    assert len(np.load(f"{empty}/spike_times.npy")) == 0


def test_harmonics_are_removed(spark):
    from oscilla.operators import harmonics

    rng = np.random.default_rng(12)
    for x in (rng.normal(size=64), rng.normal(size=1024)):
        assert np.allclose(harmonics.unpack(harmonics.packets(x, 4)), x)
    t = np.arange(4000) / 1000
    slow = np.sin(2 * np.pi * 3 * t) + 0.05 * rng.normal(size=4000)
    line = 0.8 * np.sin(2 * np.pi * 50 * t + 0.3) + 0.4 * np.sin(2 * np.pi * 150 * t) + 0.2 * np.sin(2 * np.pi * 250 * t + 1)
    df = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(slow + line)], "channel string, i long, value double")
    got = np.array([r.value for r in harmonics.remove_harmonics(df, 1000.0, 50.0, 4).orderBy("i").collect()])
    power = lambda y, f: abs(np.exp(-2j * np.pi * f * t) @ y) / len(t)
    for f in (50, 150, 250):
        assert power(got, f) < 0.1 * power(slow + line, f)
    assert abs(power(got, 3) - power(slow, 3)) < 0.05 * power(slow, 3)


def test_warping_against_all_paths():
    """Least warping cost by trying every monotone path of short sequences."""
    from functools import cache

    rng = np.random.default_rng(13)
    for _ in range(30):
        a, b, band = rng.normal(size=5), rng.normal(size=5), int(rng.integers(0, 5))

        @cache
        def cost(i, j):
            if i < 0 or j < 0 or abs(i - j) > band:  # noqa: B023
                return np.inf
            own = (a[i] - b[j]) ** 2  # noqa: B023
            return own if i == j == 0 else own + min(cost(i - 1, j), cost(i, j - 1), cost(i - 1, j - 1))

        d, path = kernels.dtw_path(a, b, band)
        assert abs(d - cost(4, 4)) < 1e-12
        assert abs(sum((a[i] - b[j]) ** 2 for i, j in path) - d) < 1e-12 and path[0] == (0, 0) and path[-1] == (4, 4)
