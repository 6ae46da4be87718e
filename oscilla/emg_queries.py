"""Queries on segments, fatigue, spectra and prepared views."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla.event_queries import _SPAN, spans
from oscilla.operators import emg, spectral, view
from oscilla.queries import SIG, q6, r6, register, signal

_SEG = f"""WITH {SIG}, seg AS (SELECT channel, i // 100 AS segment, i % 100 AS k, value - 50 AS value FROM sig),
nb AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM seg WINDOW w AS (PARTITION BY channel, segment ORDER BY k))"""


def segments(spark, d):
    return emg.cut(signal(spark, d).withColumn("value", F.col("value") - 50), 100)


def rounded(df, *keep, places=6):
    return df.select(*keep, *((F.round(c, places) + F.lit(0.0)).alias(c) for c in df.columns if c not in keep))


_STEP = "abs(value - a)"


@register(
    "time_features",
    f"""{_SEG}, f AS (SELECT channel, segment, avg(abs(value)) AS mav, sqrt(avg(value * value)) AS rms, var_pop(value) AS variance, sum(value * value) AS ssi, sum(abs(value)) AS iemg, coalesce(sum({_STEP}), 0) AS waveform_length,
count(CASE WHEN ((value > 0 AND a < 0) OR (value < 0 AND a > 0)) AND {_STEP} > 1e-4 THEN 1 END) / count(*) AS zc_rate,
count(CASE WHEN ((value > a AND value > b) OR (value < a AND value < b)) AND ({_STEP} > 1e-4 OR abs(value - b) > 1e-4) THEN 1 END) / count(*) AS ssc_rate FROM nb GROUP BY ALL)
SELECT channel, segment, {q6("mav", "rms")}, round(variance, 3) AS variance, round(ssi, 3) AS ssi, round(iemg, 3) AS iemg, round(waveform_length, 3) AS waveform_length, {q6("zc_rate", "ssc_rate")} FROM f""",
)
def time_features(spark, d):
    t = emg.time_features(segments(spark, d))
    return t.select("channel", "segment", *r6("mav", "rms"), *(F.round(c, 3).alias(c) for c in ("variance", "ssi", "iemg", "waveform_length")), *r6("zc_rate", "ssc_rate"))


@register(
    "histogram_features",
    f"""{_SEG}, st AS (SELECT channel, segment, min(value) AS lo, max(value) AS hi, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd, median(value) AS median FROM seg GROUP BY ALL),
z AS (SELECT seg.*, lo, hi, n, (value - m) / CASE WHEN sd = 0 THEN NULL ELSE sd END AS z FROM seg JOIN st USING (channel, segment)),
sh AS (SELECT channel, segment, coalesce(avg(z * z * z), 0) AS skewness, coalesce(avg(z * z * z * z) - 3, 0) AS kurtosis FROM z GROUP BY ALL),
p AS (SELECT channel, segment, CASE WHEN hi = lo THEN 0 ELSE least(floor((value - lo) / ((hi - lo) / 20)), 19) END AS b, count(*) / any_value(n) AS p FROM z GROUP BY ALL),
e AS (SELECT channel, segment, -sum(p * log2(p)) AS entropy FROM p GROUP BY ALL)
SELECT channel, segment, {q6("median", "skewness", "kurtosis", "entropy")} FROM st JOIN sh USING (channel, segment) JOIN e USING (channel, segment)""",
)
def histogram_features(spark, d):
    return rounded(emg.histogram_features(segments(spark, d)), "channel", "segment")


@register(
    "time_indices",
    f"""{_SEG}, st AS (SELECT channel, segment, max(abs(value)) AS peak, avg(abs(value)) AS mav, count(*) AS n FROM seg GROUP BY ALL), r AS (SELECT nb.*, peak, mav AS m, n, 1e-4 * peak AS t, CASE WHEN k < 0.25 * n OR k > 0.75 * n THEN 0.5 ELSE 1.0 END::DOUBLE AS w FROM nb JOIN st USING (channel, segment)),
f AS (SELECT channel, segment, avg(abs(value)) AS mav, sqrt(avg(value * value)) AS rms, sum(abs(value)) AS iemg, sum(w * abs(value)) / sum(w) AS mmav, sum({_STEP}) AS waveform_length,
count(CASE WHEN ((value > a AND value > b) OR (value < a AND value < b)) AND ({_STEP} >= t OR abs(value - b) >= t) THEN 1 END) / greatest(max(n) - 2, 1) AS ssc,
count(CASE WHEN ((value > 0 AND a < 0) OR (value < 0 AND a > 0)) AND {_STEP} >= t THEN 1 END) / greatest(max(n) - 1, 1) AS zc, avg({_STEP}) AS mean_step,
count(CASE WHEN {_STEP} > 0.1 * peak THEN 1 END) / greatest(max(n) - 1, 1) AS wilson, count(CASE WHEN abs(value) > 0.5 * m THEN 1 END) / max(n) AS myopulse FROM r GROUP BY ALL)
SELECT channel, segment, {q6("mav", "rms")}, round(iemg, 3) + 0.0 AS iemg, {q6("mmav")}, round(waveform_length, 3) + 0.0 AS waveform_length, {q6("ssc", "zc", "mean_step", "wilson", "myopulse")} FROM f""",
)
def time_indices(spark, d):
    t = emg.time_indices(segments(spark, d))
    return t.select("channel", "segment", *r6("mav", "rms"), (F.round("iemg", 3) + 0.0).alias("iemg"), *r6("mmav"), (F.round("waveform_length", 3) + 0.0).alias("waveform_length"), *r6("ssc", "zc", "mean_step", "wilson", "myopulse"))


@register(
    "fatigue_ratios",
    f"""{_SEG}, g AS (SELECT channel, segment, avg(abs(value)) AS m, sqrt(avg(value * value)) AS r, max(abs(value)) AS p, stddev_pop(abs(value)) AS s, count(CASE WHEN value * a < 0 THEN 1 END) AS z, count(*) AS n FROM nb GROUP BY ALL),
f AS (SELECT channel, segment, CASE WHEN n > 3 AND m > 0 THEN z / (n - 1) / m ELSE 0 END AS zc_mav, CASE WHEN n > 3 AND m > 0 THEN r / m ELSE 0 END AS rms_mav, CASE WHEN n > 3 AND m > 0 THEN p / m ELSE 0 END AS peak_mav,
CASE WHEN n > 3 THEN 1 - z / (n - 1) ELSE 0 END AS one_less_zc, CASE WHEN n > 3 AND m > 0 THEN s / m ELSE 0 END AS variation FROM g) SELECT channel, segment, {q6("zc_mav", "rms_mav", "peak_mav", "one_less_zc", "variation")} FROM f""",
)
def fatigue_ratios(spark, d):
    return rounded(emg.fatigue_ratios(segments(spark, d)), "channel", "segment")


@register(
    "amplitude_trend",
    f"""{_SEG}, m AS (SELECT channel, segment, avg(abs(value)) AS v FROM seg GROUP BY ALL), a AS (SELECT channel, segment, avg(v) OVER f AS v, count(*) OVER f AS c FROM m WINDOW f AS (PARTITION BY channel ORDER BY segment ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
j AS (SELECT channel, v, row_number() OVER (PARTITION BY channel ORDER BY segment) - 1 AS j FROM a WHERE c = 5), x AS (SELECT channel, v, j / greatest(max(j) OVER (PARTITION BY channel), 1) AS x FROM j)
SELECT channel, round(CASE WHEN avg(v) <> 0 THEN regr_slope(v, x) / avg(v) END, 6) + 0.0 AS trend FROM x GROUP BY channel""",
)
def amplitude_trend(spark, d):
    return rounded(emg.trend(emg.time_features(segments(spark, d)), "mav", 5), "channel")


@register(
    "robust_slope",
    f"{_SEG}, m AS (SELECT channel, segment, avg(abs(value)) AS v FROM seg GROUP BY ALL) SELECT a.channel, round(median((b.v - a.v) / (b.segment - a.segment)), 6) + 0.0 AS slope FROM m a JOIN m b ON a.channel = b.channel AND b.segment > a.segment GROUP BY a.channel",
)
def robust_slope(spark, d):
    return rounded(emg.robust_slope(emg.time_features(segments(spark, d)), "mav"), "channel")


@register(
    "activation_timing",
    f"""WITH {SIG}, {_SPAN}, x AS (SELECT channel, (offset_idx - onset_idx) / 100.0 AS d, (onset_idx - lag(onset_idx) OVER (PARTITION BY channel ORDER BY onset_idx)) / 100.0 AS g FROM sp)
SELECT channel, count(*) AS n_events, round(avg(d), 6) AS mean_duration, round(stddev_pop(d), 6) AS std_duration, min(d) AS min_duration, max(d) AS max_duration, round(avg(g), 6) AS mean_interval, round(stddev_pop(g), 6) AS std_interval, min(g) AS min_interval, max(g) AS max_interval FROM x GROUP BY channel""",
)
def activation_timing(spark, d):
    return rounded(emg.activation_timing(spans(spark, d), 100.0), "channel", "n_events")


@register(
    "burst_metrics",
    f"""WITH {SIG}, {_SPAN} SELECT event_id, sp.channel, round(avg(abs(value)), 6) AS mean_amplitude, round(max(abs(value)), 6) AS peak_amplitude, round(sum(abs(value)) / 100, 6) AS area, round(sqrt(avg(value * value)), 6) AS rms
FROM sp JOIN sig s ON s.channel = sp.channel AND i >= onset_idx AND i < offset_idx GROUP BY ALL""",
)
def burst_metrics(spark, d):
    return rounded(emg.burst_metrics(signal(spark, d), spans(spark, d), 100.0), "event_id", "channel")


@register(
    "rate_coding",
    f"""WITH {SIG}, {_SPAN}, st AS (SELECT channel, min(onset_idx) AS a, (max(onset_idx) - min(onset_idx)) // 110 AS n FROM sp GROUP BY channel), c AS (SELECT sp.channel, (onset_idx - a) // 110 AS bin, count(*) AS c FROM sp JOIN st USING (channel) GROUP BY ALL),
f AS (SELECT channel, unnest(range(n)) AS bin FROM st) SELECT f.channel, f.bin::INTEGER AS bin, coalesce(c, 0) AS count FROM f LEFT JOIN c ON c.channel = f.channel AND c.bin = f.bin""",
)
def rate_coding(spark, d):
    return emg.rate_coding(spans(spark, d), 110)


@register(
    "coactivation",
    f"""WITH {SIG}, {_SPAN}, s AS (SELECT DISTINCT channel, unnest(range(onset_idx, offset_idx)) AS i FROM sp WHERE channel IN ('click', 'view')), c AS (SELECT i, count(*) AS c FROM s GROUP BY i)
SELECT count(CASE WHEN c = 2 THEN 1 END) AS intersection, count(*) AS union_size, count(CASE WHEN c = 2 THEN 1 END) / count(*) AS coactivation FROM c""",
)
def coactivation(spark, d):
    s = spans(spark, d)
    return emg.coactivation(s.where("channel = 'click'"), s.where("channel = 'view'"))


# ---- spectra --------------------------------------------------------------------------------

_DFT = f"""WITH {SIG}, fr AS (SELECT channel, i // 64 AS frame, i % 64 AS j, value FROM sig), full_ AS (SELECT channel, frame FROM fr GROUP BY ALL HAVING count(*) = 64),
sp AS (SELECT channel, frame, k, k * 1000.0 / 64 AS freq, power(sum(value * h * cos(2 * pi() * j * k / 64)), 2) + power(sum(value * h * sin(2 * pi() * j * k / 64)), 2) AS power
FROM (SELECT fr.*, 0.5 - 0.5 * cos(2 * pi() * j / 64) AS h FROM fr SEMI JOIN full_ USING (channel, frame)) x, range(33) r(k) GROUP BY ALL)"""


@register("spectrogram", f"{_DFT} SELECT channel, frame, k::INTEGER AS k, freq, round(power, 2) + 0.0 AS power FROM sp")
def spectrogram(spark, d):
    s = spectral.spectrogram(signal(spark, d), 64, 64, 1000.0, "hann")
    return s.select("channel", "frame", "k", "freq", (F.round("power", 2) + 0.0).alias("power"))


@register(
    "spectral_indices",
    f"""{_DFT}, c AS (SELECT *, sum(power) OVER w AS c, sum(power) OVER (PARTITION BY channel, frame) AS t, sum(freq * power) OVER (PARTITION BY channel, frame) / sum(power) OVER (PARTITION BY channel, frame) AS mu, lag(freq) OVER w AS pf FROM sp WINDOW w AS (PARTITION BY channel, frame ORDER BY k)),
e AS (SELECT *, lag(c) OVER (PARTITION BY channel, frame ORDER BY k) AS pc FROM c)
SELECT channel, frame, round(max(mu), 3) + 0.0 AS mean_frequency, round(min(CASE WHEN c >= t / 2 AND coalesce(pc, 0) < t / 2 THEN CASE WHEN pf IS NULL THEN freq ELSE pf + (t / 2 - pc) / (c - pc) * (freq - pf) END END), 3) + 0.0 AS median_frequency,
round(sum((freq - mu) * (freq - mu) * power) / max(t), 1) + 0.0 AS variance, round(sum(CASE WHEN freq BETWEEN 20 AND 45 THEN power ELSE 0 END) / sum(CASE WHEN freq BETWEEN 80 AND 150 THEN power ELSE 0 END), 3) + 0.0 AS band_ratio,
round(-sum(CASE WHEN power > 0 THEN power / t * ln(power / t) ELSE 0 END) / ln(count(*)), 6) + 0.0 AS entropy FROM e GROUP BY channel, frame""",
)
def spectral_indices(spark, d):
    s = emg.spectral_indices(spectral.spectrogram(signal(spark, d), 64, 64, 1000.0, "hann"))
    return s.select("channel", "frame", *((F.round(c, 3) + 0.0).alias(c) for c in ("mean_frequency", "median_frequency")), (F.round("variance", 1) + 0.0).alias("variance"), (F.round("band_ratio", 3) + 0.0).alias("band_ratio"), *r6("entropy"))


# ---- prepared views -------------------------------------------------------------------------


@register("view_downsample", f"WITH {SIG}, w AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n, row_number() OVER (PARTITION BY channel ORDER BY i) - 1 AS r FROM sig WHERE i BETWEEN 100 AND 1500) SELECT channel, i, value FROM w WHERE r % greatest(n // 200, 1) = 0")
def view_downsample(spark, d):
    return view.downsample(signal(spark, d), 100, 1500, 200)


@register("view_stack", f"WITH {SIG}, m AS (SELECT max(abs(value)) AS m FROM sig), c AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS rank FROM (SELECT DISTINCT channel FROM sig)) SELECT channel, i, round(value / m * 0.4 * 2.0 + rank * 2.0, 6) + 0.0 AS value FROM sig JOIN c USING (channel), m")
def view_stack(spark, d):
    return view.stacked(signal(spark, d), 2.0).select("channel", "i", *r6("value"))


@register("view_min_max", f"WITH {SIG} SELECT channel, i // 50 AS bucket, min(value) AS low, max(value) AS high, min_by(i, value) AS low_at, max_by(i, value) AS high_at FROM sig GROUP BY ALL")
def view_min_max(spark, d):
    return view.min_max(signal(spark, d), 50)


@register("view_waveform", f"""WITH {SIG}, x AS (SELECT channel, i % 40 AS "offset", value FROM sig) SELECT channel, "offset", round(avg(value), 6) AS mean, round(stddev_pop(value) / sqrt(count(*)), 6) AS sem FROM x GROUP BY ALL""")
def view_waveform(spark, d):
    w = view.mean_and_error(signal(spark, d).select("channel", (F.col("i") % 40).alias("offset"), "value"), ("channel", "offset"))
    return w.select("channel", "offset", *r6("mean", "sem"))


@register(
    "fatigue_summary",
    f"""{_DFT}, c AS (SELECT *, sum(power) OVER w AS c, sum(power) OVER (PARTITION BY channel, frame) AS t, lag(freq) OVER w AS pf FROM sp WINDOW w AS (PARTITION BY channel, frame ORDER BY k)), e AS (SELECT *, lag(c) OVER (PARTITION BY channel, frame ORDER BY k) AS pc FROM c),
m AS (SELECT channel, frame, min(CASE WHEN c >= t / 2 AND coalesce(pc, 0) < t / 2 THEN CASE WHEN pf IS NULL THEN freq ELSE pf + (t / 2 - pc) / (c - pc) * (freq - pf) END END) AS v FROM e GROUP BY ALL),
j AS (SELECT channel, v, row_number() OVER (PARTITION BY channel ORDER BY frame) - 1 AS j, count(*) OVER (PARTITION BY channel) AS n FROM m),
g AS (SELECT channel, CASE WHEN count(*) > 1 THEN regr_slope(v, j) END AS slope, avg(CASE WHEN j < 10 THEN v END) AS a, avg(CASE WHEN j >= n - 10 THEN v END) AS b FROM j GROUP BY channel)
SELECT channel, round(slope, 4) + 0.0 AS slope, round(slope / nullif(a, 0) * 100, 4) + 0.0 AS percent_change, round((a - b) / nullif(a, 0) * 100, 4) + 0.0 AS fatigue_index FROM g""",
)
def fatigue_summary(spark, d):
    s = emg.fatigue_summary(emg.spectral_indices(spectral.spectrogram(signal(spark, d), 64, 64, 1000.0)))
    return s.select("channel", *((F.round(c, 4) + 0.0).alias(c) for c in ("slope", "percent_change", "fatigue_index")))


@register(
    "welch_density",
    f"""WITH {SIG}, n AS (SELECT channel, count(*) AS n FROM sig GROUP BY channel), fr AS (SELECT sig.channel, i // 64 - o AS frame, i - (i // 64 - o) * 64 AS j, value FROM sig, (VALUES (0), (1)) r(o) WHERE i // 64 - o >= 0), ok AS (SELECT channel, frame, avg(value) AS m FROM fr GROUP BY ALL HAVING count(*) = 128),
x AS (SELECT fr.channel, frame, j, (value - m) * (0.5 - 0.5 * cos(2 * pi() * j / 128)) AS y FROM fr JOIN ok USING (channel, frame)),
p AS (SELECT channel, frame, k, power(sum(y * cos(2 * pi() * j * k / 128)), 2) + power(sum(y * sin(2 * pi() * j * k / 128)), 2) AS p FROM x, range(65) r(k) GROUP BY ALL)
SELECT channel, k::INTEGER AS k, k * 1000.0 / 128 AS freq, round(avg(p * CASE WHEN k IN (0, 64) THEN 1 ELSE 2 END) / (1000.0 * (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * j / 128), 2)) FROM range(128) w(j))), 5) + 0.0 AS density FROM p GROUP BY channel, k""",
)
def welch_density(spark, d):
    return spectral.welch(signal(spark, d), 128, 1000.0).select("channel", "k", "freq", (F.round("density", 5) + 0.0).alias("density"))
