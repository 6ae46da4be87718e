"""Queries against their SQL, and operators against plain versions, on inputs where size or copies decide."""

import duckdb
import pandas as pd

import __spark_entry__ as entry
from tests.test_oracles import plain


def against_sql(spark, where, name, **tables):
    """Both results of a query over tables given as pandas frames."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.to_parquet(f"{where}/{table}.parquet", coerce_timestamps="us")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{where}/{table}.parquet'")
    df = entry.queries()[name](spark, str(where))
    cols = sorted(df.columns)
    return plain(df.select(*cols).collect()), plain(con.sql(entry.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_clusters_end_after_as_many_steps_as_their_sql(spark, tmp_path):
    """Rows on a line with all starts at one end: centres still move after forty steps."""
    line = pd.DataFrame({"vec_id": range(3000), "label": 0})
    line["embedding"] = [[float(k * k % 977) * 1e-4 + k * 1e-2] + [0.0] * 63 for k in line["vec_id"]]
    for name in ("kmeans_labels", "sorted_waveforms"):
        got, want = against_sql(spark, tmp_path, name, embeddings=line)
        assert got == want


def crowd(copies=40, seed=5):
    """Events of few users within hours, with copies of equal times: many pairs for each row."""
    import numpy as np

    r = np.random.default_rng(seed)
    at = np.concatenate([r.integers(0, 4 * 3_600_000_000, 60), np.arange(30) * 600_000_000, np.arange(8) * 1_800_000_000])
    rows = pd.DataFrame({"at": np.tile(at, copies)})
    rows["event_id"], rows["user_id"] = range(len(rows)), r.integers(0, 5, len(rows))
    rows["event_type"], rows["value"] = np.where(r.random(len(rows)) < 0.3, "purchase", "view"), 1.0
    rows["ts"] = pd.to_datetime(rows.pop("at") + 1_704_067_200_000_000, unit="us")
    return rows


def pairs_made(df):
    """The most rows that a join of the executed plan gives."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        if "AdaptiveSparkPlan" in p.nodeName() or "QueryStage" in p.nodeName():
            left.append(p.plan() if "QueryStage" in p.nodeName() else p.executedPlan())
            continue
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        left += [p.children().apply(k) for k in range(p.children().size())]
    return most


def test_histograms_make_no_pairs(spark, tmp_path):
    rows = crowd()
    for name in ("psth", "psth_smoothed", "view_psth", "view_raster_psth"):
        got, want = against_sql(spark, tmp_path, name, events=rows)
        assert got == want and len(got) == 30
        assert pairs_made(entry.queries()[name](spark, str(tmp_path))) <= 14 * len(rows)  # seven edges a spike; 1.2 million pairs


def test_raster_keeps_rel_of_equal_times_once(spark, tmp_path, monkeypatch):
    """Copies of equal times, one time with more rows than an array holds, rows without a unit or a time, times before zero; several shares of a bucket."""
    import numpy as np

    from oscilla.operators import spikes

    monkeypatch.setattr(spikes, "AT_ONCE", 16, raising=False)
    monkeypatch.setattr(spikes, "RASTER_PAIRS", 1 << 15, raising=False)
    rows = crowd(20)
    rows["ts"] = rows["ts"] - pd.Timedelta(hours=2)
    rows.loc[rows.index % 50 == 7, "ts"] = rows["ts"].iloc[0]
    rows["user_id"] = rows["user_id"].astype("Int64").mask(rows.index % 31 == 0)
    rows["ts"] = rows["ts"].mask(rows.index % 97 == 5)
    got, want = against_sql(spark, tmp_path, "raster", events=rows)
    assert got == want and len(got) > 200_000 and any("" in r for r in got)
    df = entry.queries()["raster"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 4
    assert 4 * pairs_made(df) < len(got)
    df.write.parquet(str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.6 * len(got)
    same = against_sql(spark, tmp_path, "raster", events=rows.assign(ts=rows["ts"].iloc[0]).iloc[:400])
    assert same[0] == same[1] and len(same[0]) == 400 * np.count_nonzero(rows["event_type"].iloc[:400] == "purchase")
    assert spikes.raster(spark.createDataFrame([], "unit_id long, sample long"), spark.createDataFrame([(1, 5)], "event_id long, sample long"), 3, 3).collect() == []


def test_density_in_blocks_is_as_by_plain_pairs(spark, monkeypatch):
    """Groups of copies, distances of just eps, border points and noise; blocks of a few rows."""
    import numpy as np

    from oscilla.operators import learn

    monkeypatch.setattr(learn._block_pairs, "__defaults__", (None, 16))
    monkeypatch.setattr(learn, "HELD", 64)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(0, 12, (90, 2)) * 0.1, np.tile([[5.0, 5.0]], (40, 1)), [[5.0, 6.0], [9.0, 9.0]], r.normal(3, 0.3, (30, 2)) + 1e6])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.1
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, x array<double>")
    assert {(p.a, p.b) for p in learn.neighbours(df, 0.1).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    core = near.sum(axis=1) >= 4
    assert {p.id for p in learn.core_points(df, 0.1, 4).collect()} == set(np.flatnonzero(core).tolist())
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        low = np.where(near & core[None, :] & core[:, None], label[None, :], len(x)).min(axis=1)
        if np.array_equal(low, label):
            break
        label = low
    border = np.where(near & core[None, :], label[None, :], len(x)).min(axis=1)
    want = [int(v) if v < len(x) else -1 for v in np.where(core, label, border)]
    got = learn.dbscan(df, 0.1, 4)
    assert [p.cluster for p in got.orderBy("id").collect()] == want


def test_scores_make_distances_once_for_all_eps(spark, monkeypatch):
    """Distances of just one eps, far from zero and near it; blocks of a few rows; the border points alone are met for each eps."""
    import numpy as np

    from oscilla.operators import learn

    calls, plain_pairs = [], learn._block_pairs
    monkeypatch.setattr(learn, "_block_pairs", lambda a, b, eps, schema, run, extra=None: calls.append(eps) or plain_pairs(a, b, eps, schema, run, extra, 32))
    monkeypatch.setattr(learn, "HELD", 256)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    r = np.random.default_rng(6)
    x = np.concatenate([r.integers(0, 30, (60, 2)) * 0.25, [[50.0, 50.0]] * 9, r.normal(3, 0.6, (40, 2))])
    eps_values, d = [0.5, 0.25, 0.75], np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    df = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(x)], "id long, x array<double>")
    got = learn.density_scores(df, eps_values, 5).collect()
    assert len(calls) <= 2 + len(eps_values)
    for row, eps in zip(got, eps_values, strict=True):
        near = d <= eps
        core = near.sum(axis=1) >= 5
        label = np.where(core, np.arange(len(x)), len(x))
        for _ in x:
            label = np.where(core, np.where(near & core[None, :], label[None, :], len(x)).min(axis=1), len(x))
        assert (row.eps, row.clusters) == (eps, len(set(label[core].tolist())))
        assert abs(row.noise_ratio - (~(near & core[None, :]).any(axis=1)).mean()) < 1e-12


def test_correlograms_send_no_pairs(spark, tmp_path, monkeypatch):
    """Copies of equal times and several groups of units; pairs are counted where their units meet, and no join makes them."""
    from oscilla.operators import spikes

    monkeypatch.setattr(spikes, "TASK_PAIRS", 1 << 18) if hasattr(spikes, "TASK_PAIRS") else None
    monkeypatch.setattr(spikes, "HELD", 1 << 10, raising=False)
    rows = crowd(12)
    for name in ("correlograms", "view_correlogram", "tiling_coefficient", "jitter_corrected"):
        got, want = against_sql(spark, tmp_path, name, events=rows)
        assert got == want and len(got) >= 10
        assert pairs_made(entry.queries()[name](spark, str(tmp_path))) <= len(rows)


def rows_of(df, kind):
    """The most rows that a node of this kind gives in the executed plan."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        if "AdaptiveSparkPlan" in p.nodeName() or "QueryStage" in p.nodeName():
            left.append(p.plan() if "QueryStage" in p.nodeName() else p.executedPlan())
            continue
        if kind in p.nodeName() and p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        left += [p.children().apply(k) for k in range(p.children().size())]
    return most


def test_correlograms_send_packed_spikes(spark, tmp_path, monkeypatch):
    """Many groups of few units, units of more pairs than a part, rows without a unit or a time: spikes reach the groups packed, and parts of a unit are put together."""
    from oscilla.operators import spikes

    for name, value in (("TASK_PAIRS", 1 << 8), ("HELD", 1 << 9), ("PACKED", 1 << 7)):
        monkeypatch.setattr(spikes, name, value, raising=False)
    rows = crowd(4)
    rows["user_id"] = (rows["user_id"] * 7 + rows.index % 3).astype("Int64").mask(rows.index % 31 == 0)
    rows.loc[rows.index % 5 == 0, "user_id"] = 3
    rows["ts"] = rows["ts"].mask(rows.index % 97 == 5)
    for name in ("correlograms", "view_correlogram", "tiling_coefficient", "jitter_corrected"):
        got, want = against_sql(spark, tmp_path, name, events=rows)
        assert got == want and len(got) >= 40
        df = entry.queries()[name](spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4  # a task for every two groups
        assert 0 < rows_of(df, "Generate") < len(rows) // 2


def test_decimals_are_those_of_round(spark):
    from oscilla.queries import decimals

    values = [None, 0.0, 0.25, 1 / 3, 2 / 3, 1e10, 1e300, -1 / 3, float("nan"), float("inf"), *(k / 77 for k in range(500))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for n in (6, 9):
        assert repr(df.select(decimals("x", n)).collect()) == repr(df.selectExpr(f"round(x, {n}) AS x").collect())


def test_runs_of_entropy_meet_their_own_windows(spark):
    """Hundreds of runs in one channel: a run meets its windows and the three before, not all of the channel."""
    import numpy as np

    from oscilla.operators import kernels

    x = np.random.default_rng(2).integers(0, 3, 12_000).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"channel": "a", "i": range(len(x)), "value": x}))
    e = kernels.entropy_onsets(df, 20, 10, 1000.0)
    assert pairs_made(e) <= 2 * len(x)
    assert len(e.collect()) > 50
    rows = np.lib.stride_tricks.sliding_window_view(x, 50)[:300].copy()
    rows[3], rows[5, ::2], rows[6] = 1.0, 0.0, np.arange(50)
    for m in (1, 2, 3):
        assert np.allclose(kernels.sample_entropies(rows, m), [kernels.sample_entropy(v, m) for v in rows])


def test_warping_of_many_windows_at_once(spark):
    import time

    import numpy as np

    from oscilla.operators import kernels

    x = np.round(np.random.default_rng(4).normal(size=12_000), 1)
    t, at = np.array([1.0, 2.0, 4.0, 2.0, 1.0]), np.arange(0, 12_000, 3)
    begin = time.perf_counter()
    plain = x.copy()
    for k in at:
        if 2 <= k < len(x) - 2:
            w = kernels.warp(t, x[k - 2 : k + 3], 2)
            plain[k - 2 : k + 3] -= x[k - 2 : k + 3] @ w / (w @ w) * w
    middle = time.perf_counter()
    got = kernels.subtract_warped(x, at, t, 2)
    assert 5 * (time.perf_counter() - middle) < middle - begin
    assert np.allclose(got, plain)
