"""Registered queries over the driver's tables, and their SQL oracles beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscilla import model
from oscilla.operators import detect, neighbourhood, pointwise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

SIG = "sig AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, value FROM events)"
WIDE = """wide AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) - 1 AS i,
  l_quantity AS c0, l_extendedprice AS c1, l_discount AS c2, l_tax AS c3 FROM lineitem)"""
SPIKES = "spikes AS (SELECT user_id AS unit_id, epoch_us(ts) - 1704067200000000 AS sample, value, event_type, event_id FROM events)"
STIM = "stim AS (SELECT event_id, epoch_us(ts) - 1704067200000000 AS sample FROM events WHERE event_type = 'purchase')"
HOUR = 3_600_000_000
DAY = 24 * HOUR


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def decimals(name: str, digits: int):
    """A rounded column, halves up as in SQL: by whole numbers for usual values, which takes far less time a row than Spark's decimals."""
    x, scale = F.col(name), 10.0**digits
    return F.when((x >= 0) & (x < 1e15 / scale), F.floor(x * scale + 0.5) / scale).otherwise(F.round(name, digits)).alias(name)


def r6(*cols: str):
    """Columns rounded to six places, without negative zeros."""
    return [(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in cols]


def off6(*cols: str):
    """As :func:`r6`, a little off first: means of two-decimal values often end in a 5 at the seventh place, where the order of a sum would decide."""
    return [(F.round(F.col(c) + 1e-9, 6) + F.lit(0.0)).alias(c) for c in cols]


def q6(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


def signal(spark: SparkSession, d: str) -> DataFrame:
    return model.event_signal(spark, d)


def out(df: DataFrame, *values: str) -> DataFrame:
    return df.select("channel", "i", *r6(*(values or ("value",))))


# ---- sources and slices ---------------------------------------------------------------------


@register("trace_slice", f"WITH {SIG} SELECT channel, i, value, i / 100.0 AS t FROM sig WHERE i >= 50 AND i < 250 AND channel IN ('click', 'view')")
def trace_slice(spark, d):
    df = signal(spark, d).where("i >= 50 AND i < 250 AND channel IN ('click', 'view')")
    return df.select("channel", "i", "value", (F.col("i") / 100.0).alias("t"))


@register("channel_duration", f"WITH {SIG} SELECT channel, count(*)::BIGINT AS n_samples, count(*) / 100.0 AS duration FROM sig GROUP BY channel")
def channel_duration(spark, d):
    return signal(spark, d).groupBy("channel").agg(F.count("*").alias("n_samples"), (F.count("*") / 100.0).alias("duration"))


@register("pipeline_slice", f"WITH {SIG} SELECT channel, i, round(greatest(0.0, value - 20) * greatest(0.0, value - 20), 6) + 0.0 AS value FROM sig WHERE i >= 100 AND i < 500")
def pipeline_slice(spark, d):
    from oscilla.plans.pipeline import Op, Pipeline

    p = Pipeline().add(Op("shift", lambda x: x.withColumn("value", F.col("value") - 20)), "clean").add(Op("half", lambda x: pointwise.rectify(x, "half")), "shape").add(Op("square", lambda x: pointwise.rectify(x, "square")), "shape")
    return out(p.process(signal(spark, d), fs=100.0, start=1.0, end=5.0))


# ---- pointwise ------------------------------------------------------------------------------


@register(
    "rectify",
    f"WITH {SIG}, m AS (SELECT channel, i, value - 50 AS x FROM sig) SELECT channel, i, method, round(CASE method WHEN 'abs' THEN abs(x) WHEN 'square' THEN x * x ELSE greatest(0.0, x) END, 6) + 0.0 AS value FROM m, (VALUES ('abs'), ('square'), ('half')) v(method)",
)
def rectify(spark, d):
    x = signal(spark, d).withColumn("value", F.col("value") - 50)
    every = [pointwise.rectify(x, m).withColumn("method", F.lit(m)) for m in ("abs", "square", "half")]
    return every[0].unionByName(every[1]).unionByName(every[2]).select("channel", "i", "method", *r6("value"))


@register("zscore_global", f"WITH {SIG}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM sig) SELECT channel, i, round((value - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) + 0.0 AS value FROM sig, s")
def zscore_global(spark, d):
    return out(pointwise.normalize(signal(spark, d), "zscore"))


@register("minmax_by_channel", f"WITH {SIG}, s AS (SELECT channel, min(value) AS a, max(value) AS b FROM sig GROUP BY channel) SELECT channel, i, round((value - a) / CASE WHEN a = b THEN 1 ELSE b - a END, 6) + 0.0 AS value FROM sig JOIN s USING (channel)")
def minmax_by_channel(spark, d):
    return out(pointwise.normalize(signal(spark, d), "minmax", ("channel",)))


@register("robust_scale", f"WITH {SIG}, s AS (SELECT channel, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM sig GROUP BY channel) SELECT channel, i, round((value - m) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) + 0.0 AS value FROM sig JOIN s USING (channel)")
def robust_scale(spark, d):
    return out(pointwise.normalize(signal(spark, d), "robust", ("channel",)))


@register(
    "mad_scale",
    f"WITH {SIG}, m AS (SELECT channel, median(value) AS m FROM sig GROUP BY channel), s AS (SELECT channel, m, median(abs(value - m)) * 1.4826 AS mad FROM sig JOIN m USING (channel) GROUP BY channel, m) SELECT channel, i, round((value - m) / CASE WHEN mad = 0 THEN 1 ELSE mad END, 6) + 0.0 AS value FROM sig JOIN s USING (channel)",
)
def mad_scale(spark, d):
    return out(pointwise.normalize(signal(spark, d), "mad", ("channel",)))


@register("view_scale", f"WITH {SIG}, s AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS sd FROM sig GROUP BY channel) SELECT channel, i, round(CASE WHEN sd = 0 THEN 0 ELSE (value - m) / sd END, 6) + 0.0 AS value FROM sig JOIN s USING (channel)")
def view_scale(spark, d):
    return out(pointwise.normalize_for_view(signal(spark, d)))


def _wide_sql(ref: dict[str, str]) -> str:
    return f"WITH {WIDE} SELECT i, " + ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in ref.items()) + " FROM wide"


_MEAN, _MEDIAN = "(c0 + c1 + c2 + c3) / 4", "list_aggregate([c0, c1, c2, c3], 'median')"
COLS = ["c0", "c1", "c2", "c3"]


@register("common_average", _wide_sql({c: f"{c} - {_MEAN}" for c in COLS}))
def common_average(spark, d):
    return pointwise.common_reference(model.item_signal(spark, d), COLS, "average").select("i", *r6(*COLS))


@register("common_median", _wide_sql({c: f"{c} - {_MEDIAN}" for c in COLS}))
def common_median(spark, d):
    return pointwise.common_reference(model.item_signal(spark, d), COLS, "median").select("i", *r6(*COLS))


@register("grouped_reference", _wide_sql({"c0": "c0 - (c0 + c2) / 2", "c1": "0.0::DOUBLE", "c2": "c2 - (c0 + c2) / 2", "c3": "0.0::DOUBLE"}))
def grouped_reference(spark, d):
    return pointwise.common_reference(model.item_signal(spark, d), COLS, "average", groups=[["c0", "c2"]]).select("i", *r6(*COLS))


@register("single_reference", _wide_sql({c: f"{c} - c3" for c in COLS}))
def single_reference(spark, d):
    return pointwise.common_reference(model.item_signal(spark, d), COLS, "average", reference=["c3"]).select("i", *r6(*COLS))


@register("reference_series", f"WITH {WIDE} SELECT i, round({_MEDIAN}, 6) + 0.0 AS value FROM wide")
def reference_series(spark, d):
    return pointwise.reference_series(model.item_signal(spark, d), COLS).select("i", *r6("value"))


@register("long_common_average", f"WITH {SIG}, m AS (SELECT i, avg(value) AS m FROM sig GROUP BY i) SELECT channel, i, round(value - m, 6) + 0.0 AS value FROM sig JOIN m USING (i)")
def long_common_average(spark, d):
    return out(pointwise.common_reference_long(signal(spark, d)))


@register(
    "noise_level",
    f"WITH {SIG}, m AS (SELECT channel, median(value) AS m, stddev_pop(value) AS sd FROM sig GROUP BY channel) SELECT channel, round(median(abs(value - m)) / 0.67449, 6) AS noise, round(any_value(sd), 6) AS std_noise FROM sig JOIN m USING (channel) GROUP BY channel",
)
def noise_level(spark, d):
    s = signal(spark, d)
    both = pointwise.noise_level(s).join(pointwise.noise_level(s, "std").withColumnRenamed("noise", "std_noise"), "channel")
    return both.select("channel", *r6("noise", "std_noise"))


# ---- neighbourhoods -------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY channel ORDER BY i)"


@register(
    "tkeo_classic",
    f"""WITH {SIG}, t AS (SELECT channel, i, value * value - lag(value) OVER w * lead(value) OVER w AS e FROM sig {_W})
SELECT channel, i, round(coalesce(e, lead(e) OVER w, lag(e) OVER w), 6) + 0.0 AS value FROM t {_W}""",
)
def tkeo_classic(spark, d):
    return out(neighbourhood.tkeo(signal(spark, d)))


@register(
    "tkeo_modified",
    f"""WITH {SIG}, t AS (SELECT channel, i, value * lead(value) OVER w - lag(value) OVER w * lead(value, 2) OVER w AS e FROM sig {_W})
SELECT channel, i, round(coalesce(e, lead(e) OVER w, lag(e) OVER w, lag(e, 2) OVER w), 6) + 0.0 AS value FROM t {_W}""",
)
def tkeo_modified(spark, d):
    return out(neighbourhood.tkeo(signal(spark, d), "modified"))


@register("moving_average", f"WITH {SIG} SELECT channel, i, round(avg(value) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) + 0.0 AS value FROM sig")
def moving_average(spark, d):
    return out(neighbourhood.moving(signal(spark, d), 11))


@register("moving_rms_causal", f"WITH {SIG} SELECT channel, i, round(sqrt(avg(value * value) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), 6) + 0.0 AS value FROM sig")
def moving_rms_causal(spark, d):
    return out(neighbourhood.moving(signal(spark, d), 20, "rms", center=False))


@register("moving_average_zero_padded", f"WITH {SIG} SELECT channel, i, round(sum(value) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15, 6) + 0.0 AS value FROM sig")
def moving_average_zero_padded(spark, d):
    return out(neighbourhood.moving(signal(spark, d), 15, edge="zero"))


@register("moving_rms_zero_padded", f"WITH {SIG} SELECT channel, i, round(sqrt(sum(value * value) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15), 6) + 0.0 AS value FROM sig")
def moving_rms_zero_padded(spark, d):
    return out(neighbourhood.moving(signal(spark, d), 15, "rms", edge="zero"))


@register(
    "median_filter",
    f"""WITH {SIG}, t AS (SELECT channel, i, list_sort(list(value) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) AS s FROM sig)
SELECT channel, i, round(s[len(s) // 2 + 1], 6) + 0.0 AS value FROM t""",
)
def median_filter(spark, d):
    return out(neighbourhood.moving(signal(spark, d), 7, "median"))


def _weighted_sql(weights: list[float]) -> str:
    n = len(weights)
    lo = n // 2
    lags = [(w, f"lag(value, {lo - k}) OVER w" if k < lo else "value" if k == lo else f"lead(value, {k - lo}) OVER w") for k, w in enumerate(weights)]
    top = " + ".join(f"coalesce({w!r} * {x}, 0)" for w, x in lags)
    low = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE {w!r} END" for w, x in lags)
    return f"WITH {SIG} SELECT channel, i, round(({top}) / ({low}), 6) + 0.0 AS value FROM sig {_W}"


@register("weighted_average", _weighted_sql([1.0, 2.0, 3.0, 4.0, 5.0]))
def weighted_average(spark, d):
    return out(neighbourhood.convolve(signal(spark, d), [1.0, 2.0, 3.0, 4.0, 5.0]))


@register("sinc_filter", _weighted_sql(neighbourhood.sinc_window(10.0, 9, "hamming", 100.0)))
def sinc_filter(spark, d):
    return out(neighbourhood.sinc_filter(signal(spark, d), 10.0, 100.0, 9))


@register(
    "savitzky_golay",
    f"""WITH {SIG}, n AS (SELECT channel, count(*) AS n FROM sig GROUP BY channel), w(place, k, w) AS (VALUES (0, 0, 31), (0, 1, 9), (0, 2, -3), (0, 3, -5), (0, 4, 3), (1, 0, 9), (1, 1, 13), (1, 2, 12), (1, 3, 6), (1, 4, -5),
  (2, 0, -3), (2, 1, 12), (2, 2, 17), (2, 3, 12), (2, 4, -3), (3, 0, -5), (3, 1, 6), (3, 2, 12), (3, 3, 13), (3, 4, 9), (4, 0, 3), (4, 1, -5), (4, 2, -3), (4, 3, 9), (4, 4, 31)),
p AS (SELECT channel, i, least(greatest(i - 2, 0), n - 5) AS first FROM sig JOIN n USING (channel))
SELECT p.channel, p.i, round(sum(w * value) / 35 + 1e-9, 6) + 0.0 AS value FROM p JOIN w ON w.place = p.i - first JOIN sig s ON s.channel = p.channel AND s.i = first + k GROUP BY ALL""",
)
def savitzky_golay(spark, d):
    return neighbourhood.savitzky_golay(signal(spark, d), 5, 2).select("channel", "i", *off6("value"))


@register(
    "peak_follower",
    f"""WITH RECURSIVE {SIG}, y AS (SELECT channel, i, (1 - exp(-1 / 2)) * abs(value) AS y FROM sig WHERE i = 0
UNION ALL SELECT s.channel, s.i, y + (CASE WHEN abs(value) > y THEN 1 - exp(-1 / 2) ELSE 1 - exp(-1 / 50) END) * (abs(value) - y) FROM y JOIN sig s ON s.channel = y.channel AND s.i = y.i + 1)
SELECT channel, i, round(y, 6) + 0.0 AS value FROM y""",
)
def peak_follower(spark, d):
    return out(neighbourhood.peak_follower(signal(spark, d), 0.002, 0.05, 1000.0))


@register(
    "long_sinc_filter",
    f"""WITH {SIG}, p AS (SELECT a.channel, a.i, b.value, b.i - a.i AS j FROM sig a JOIN sig b ON b.channel = a.channel AND b.i BETWEEN a.i - 500 AND a.i + 500),
w AS (SELECT *, (CASE WHEN j = 0 THEN 0.02 ELSE sin(0.02 * pi() * j) / (pi() * j) END) * (0.54 - 0.46 * cos(2 * pi() * (j + 500) / 1000)) AS w FROM p)
SELECT channel, i, round(sum(value * w) / sum(w), 6) + 0.0 AS value FROM w GROUP BY ALL""",
)
def long_sinc_filter(spark, d):
    return out(neighbourhood.sinc_filter(signal(spark, d), 10.0, 1000.0, 1001))


@register("comb_notch", f"WITH {SIG} SELECT channel, i, round(value - 0.9 * coalesce(lag(value, 20) OVER w, 0), 6) + 0.0 AS value FROM sig {_W}")
def comb_notch(spark, d):
    return out(neighbourhood.comb_notch(signal(spark, d), 50.0, 1000.0, 0.9))


@register(
    "exponential_average",
    f"""WITH RECURSIVE {SIG}, e AS (
  SELECT channel, i, value AS y FROM sig WHERE i = 0
  UNION ALL SELECT s.channel, s.i, 0.1 * s.value + 0.9 * e.y FROM e JOIN sig s ON s.channel = e.channel AND s.i = e.i + 1)
SELECT channel, i, round(y, 6) + 0.0 AS value FROM e""",
)
def exponential_average(spark, d):
    return out(neighbourhood.exponential(signal(spark, d), 0.1, block=512))


# ---- detection ------------------------------------------------------------------------------

_THR = """m AS (SELECT channel, median(value) AS m, avg(value) AS a, stddev_pop(value) AS sd, sqrt(avg(value * value)) AS rms FROM sig GROUP BY channel),
thr AS (SELECT channel, m, a, sd, rms, median(abs(value - m)) / 0.67449 AS mad FROM sig JOIN m USING (channel) GROUP BY channel, m, a, sd, rms)"""


@register("detection_thresholds", f"WITH {SIG}, {_THR} SELECT channel, mode, round(lower, 6) + 0.0 AS lower, round(upper, 6) + 0.0 AS upper FROM (SELECT channel, 'std' AS mode, a - 2 * sd AS lower, a + 2 * sd AS upper FROM thr UNION ALL SELECT channel, 'mad', m - 2 * mad, m + 2 * mad FROM thr UNION ALL SELECT channel, 'rms', -2 * rms, 2 * rms FROM thr)")
def detection_thresholds(spark, d):
    s = signal(spark, d)
    every = [detect.thresholds(s, 2.0, m).withColumn("mode", F.lit(m)) for m in ("std", "mad", "rms")]
    return every[0].unionByName(every[1]).unionByName(every[2]).select("channel", "mode", *r6("lower", "upper"))


_GREEDY = """keep(channel, i) AS (
  SELECT channel, min(i) FROM cand GROUP BY channel
  UNION ALL SELECT k.channel, (SELECT min(c.i) FROM cand c WHERE c.channel = k.channel AND c.i >= k.i + {d}) FROM keep k
  WHERE EXISTS (SELECT 1 FROM cand c WHERE c.channel = k.channel AND c.i >= k.i + {d}))"""


@register(
    "peak_detection",
    f"""WITH RECURSIVE {SIG}, {_THR}, near AS (SELECT channel, i, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM sig {_W}),
cand AS (SELECT near.channel, i, value FROM near JOIN thr USING (channel) WHERE value > near.a AND value > b AND value > thr.m + 2 * mad),
{_GREEDY.format(d=15)}
SELECT cand.channel, cand.i AS index, cand.value AS amplitude, cand.i / 100.0 AS time_sec FROM keep JOIN cand USING (channel, i)""",
)
def peak_detection(spark, d):
    s = signal(spark, d)
    return detect.peaks(s, detect.thresholds(s, 2.0, "mad"), 15, "positive", fs=100.0).select("channel", "index", "amplitude", "time_sec")


_RUNS = """f AS (SELECT channel, i, value, value > limit_ AS on_, coalesce(lag(value > limit_) OVER w, false) AS was, n FROM lim WINDOW w AS (PARTITION BY channel ORDER BY i)),
ons AS (SELECT channel, i FROM f WHERE on_ AND NOT was),
offs AS (SELECT channel, i FROM f WHERE NOT on_ AND was UNION SELECT channel, n - 1 FROM f WHERE i = n - 1 AND on_)"""
_SCAN = """{k}(channel, i) AS (
  SELECT channel, min(i) FROM {src} GROUP BY channel
  UNION ALL SELECT k.channel, (SELECT min(c.i) FROM {src} c WHERE c.channel = k.channel AND c.i >= k.i + {d}) FROM {k} k
  WHERE EXISTS (SELECT 1 FROM {src} c WHERE c.channel = k.channel AND c.i >= k.i + {d}))"""


@register(
    "contraction_onsets",
    f"""WITH RECURSIVE {SIG}, st AS (SELECT channel, avg(value) + 0.5 * stddev_pop(value) AS limit_, count(*) AS n FROM sig GROUP BY channel),
lim AS (SELECT sig.*, limit_, n FROM sig JOIN st USING (channel)), {_RUNS}, {_SCAN.format(k="kon", src="ons", d=10)}, {_SCAN.format(k="koff", src="offs", d=10)},
ev AS (SELECT o.channel, o.i AS onset_idx, (SELECT min(x.i) FROM koff x WHERE x.channel = o.channel AND x.i > o.i) AS offset_idx FROM kon o)
SELECT ev.channel, onset_idx, offset_idx, max(value) AS amplitude, (offset_idx - onset_idx) / 100.0 AS duration
FROM ev JOIN sig ON sig.channel = ev.channel AND i >= onset_idx AND i < offset_idx WHERE offset_idx - onset_idx >= 2 GROUP BY ALL""",
)
def contraction_onsets(spark, d):
    return detect.contractions(signal(spark, d), "std", 0.5, 2, 10, 100.0).select("channel", "onset_idx", "offset_idx", "amplitude", "duration")


@register(
    "energy_onsets",
    f"""WITH {SIG}, t AS (SELECT channel, i, value * value - lag(value) OVER w * lead(value) OVER w AS e FROM sig {_W}),
u AS (SELECT channel, i, abs(coalesce(e, lead(e) OVER w, lag(e) OVER w)) AS e FROM t {_W}),
v AS (SELECT channel, i, sqrt(avg(e * e) OVER (PARTITION BY channel ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) AS value FROM u),
st AS (SELECT channel, avg(value) + 1.5 * stddev_pop(value) AS limit_, count(*) AS n FROM v GROUP BY channel),
lim AS (SELECT v.*, limit_, n FROM v JOIN st USING (channel)), {_RUNS},
ev AS (SELECT o.channel, o.i AS onset_idx, (SELECT min(x.i) FROM offs x WHERE x.channel = o.channel AND x.i > o.i) AS offset_idx FROM ons o)
SELECT ev.channel, onset_idx, offset_idx, round(max(value), 6) + 0.0 AS amplitude, (offset_idx - onset_idx) / 100.0 AS duration
FROM ev JOIN v ON v.channel = ev.channel AND i >= onset_idx AND i < offset_idx WHERE offset_idx - onset_idx >= 3 GROUP BY ALL""",
)
def energy_onsets(spark, d):
    """Energy, rectification, moving rms, threshold, runs: a whole detection chain in one plan."""
    s = neighbourhood.moving(pointwise.rectify(neighbourhood.tkeo(signal(spark, d))), 11, "rms")
    return detect.contractions(s, "std", 1.5, 3, 0, 100.0).select("channel", "onset_idx", "offset_idx", *r6("amplitude"), "duration")


@register(
    "confirmed_onsets",
    f"""WITH RECURSIVE {SIG}, lim AS (SELECT sig.*, 60.0 AS limit_, max(i) OVER (PARTITION BY channel) + 1 AS n FROM sig), {_RUNS},
ev AS (SELECT o.channel, o.i AS onset_idx, (SELECT min(x.i) FROM offs x WHERE x.channel = o.channel AND x.i > o.i) AS offset_idx FROM ons o),
ins AS (SELECT ev.*, i, value FROM ev JOIN sig ON sig.channel = ev.channel AND i >= onset_idx AND i < offset_idx WHERE offset_idx > onset_idx),
hot AS (SELECT *, i - row_number() OVER (PARTITION BY channel, onset_idx ORDER BY i) AS g FROM ins WHERE value > 80),
ok AS (SELECT channel, onset_idx FROM (SELECT channel, onset_idx, g, count(*) AS c FROM hot GROUP BY ALL) GROUP BY ALL HAVING max(c) >= 2)
SELECT channel, onset_idx, offset_idx, max(value) AS amplitude FROM ins JOIN ok USING (channel, onset_idx) GROUP BY ALL""",
)
def confirmed_onsets(spark, d):
    return detect.confirmed_contractions(signal(spark, d), 60.0, 80.0, 2).select("channel", "onset_idx", "offset_idx", "amplitude")


@register(
    "threshold_crossings",
    f"""WITH RECURSIVE {SIG}, f AS (SELECT channel, i, value > 90 AS on_, coalesce(lag(value > 90) OVER w, false) AS was FROM sig {_W}),
cand AS (SELECT channel, i FROM f WHERE on_ AND NOT was), {_GREEDY.format(d=12)} SELECT channel AS unit_id, i AS sample FROM keep""",
)
def threshold_crossings(spark, d):
    return detect.crossings(signal(spark, d), 90.0, "pos", 12)
