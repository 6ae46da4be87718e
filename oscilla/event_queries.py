"""Queries on epochs, spike trains and unit metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from oscilla import model
from oscilla.functions.windows import over_neighbours
from oscilla.operators import extract, spikes
from oscilla.queries import DAY, HOUR, SIG, SPIKES, STIM, decimals, off6, q6, r6, register, signal

MIN = 60_000_000
SEC = 1_000_000
_E = f"WITH {SIG}"


def train(spark, d):
    return model.event_spikes(spark, d)


def onsets(spark, d):
    """Local maxima beyond mean and one standard deviation of their channel: crowded, unevenly spaced events."""
    x = signal(spark, d)
    near = over_neighbours(x, 1, 1, lambda r, w: r.withColumn("_a", F.lag("value").over(w)).withColumn("_b", F.lead("value").over(w)))
    limit = x.groupBy("channel").agg((F.avg("value") + F.stddev_pop("value")).alias("_t"))
    s = near.join(limit, "channel").where("value > _a AND value > _b AND value > _t")
    return s.select(F.col("i").alias("event_id"), "channel", "i")


_PEAKS = """pk AS (SELECT channel, i, value > lag(value) OVER w AND value > lead(value) OVER w AND value > avg(value) OVER c + stddev_pop(value) OVER c AS top FROM sig WINDOW w AS (PARTITION BY channel ORDER BY i), c AS (PARTITION BY channel))"""
_ON = f"{_PEAKS}, ev AS (SELECT i AS event_id, channel, i FROM pk WHERE top)"
_N = "n AS (SELECT channel, max(i) + 1 AS n FROM sig GROUP BY channel)"
_EP = f"""{SIG}, {_ON}, {_N},
ep AS (SELECT ev.event_id, ev.channel, s.i - ev.i AS offset_, s.value FROM ev JOIN n USING (channel) JOIN sig s ON s.channel = ev.channel AND s.i BETWEEN ev.i - 5 AND ev.i + 10 WHERE ev.i >= 5 AND ev.i + 10 < n)"""


@register("fixed_epochs", f"WITH {_EP} SELECT event_id, channel, offset_::INTEGER AS \"offset\", value FROM ep")
def fixed_epochs(spark, d):
    return extract.epochs(signal(spark, d), onsets(spark, d), 5, 10)


@register(
    "epochs_without_outliers",
    f"""WITH {_EP}, st AS (SELECT event_id, channel, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM ep GROUP BY ALL)
SELECT ep.event_id, ep.channel, offset_::INTEGER AS "offset", value FROM ep JOIN st USING (event_id, channel) WHERE greatest(hi - m, m - lo) <= 2.5 * s""",
)
def epochs_without_outliers(spark, d):
    return extract.epochs(signal(spark, d), onsets(spark, d), 5, 10, reject=2.5)


_SPAN = f"{_PEAKS}, sp AS (SELECT i AS event_id, channel, i AS onset_idx, i + 3 + i % 17 AS offset_idx FROM pk WHERE top)"


def spans(spark, d):
    return onsets(spark, d).select("event_id", "channel", F.col("i").alias("onset_idx"), (F.col("i") + 3 + F.col("i") % 17).alias("offset_idx"))


_VAR = f"""WITH {SIG}, {_SPAN}, {_N}, va AS (SELECT event_id, sp.channel, s.i - onset_idx AS offset_, value, onset_idx, least(offset_idx, n) AS stop FROM sp JOIN n USING (channel)
  JOIN sig s ON s.channel = sp.channel AND s.i >= onset_idx AND s.i < least(offset_idx, n))"""


@register("variable_epochs", f"{_VAR} SELECT event_id, channel, offset_ AS \"offset\", value FROM va WHERE stop - onset_idx BETWEEN 5 AND 15")
def variable_epochs(spark, d):
    return extract.variable_epochs(signal(spark, d), spans(spark, d), 5, 15)


@register(
    "aligned_waveforms",
    f"""WITH {_EP}, sh AS (SELECT event_id, channel, arg_min(offset_, (value, offset_)) AS sh FROM ep WHERE abs(offset_) <= 3 GROUP BY ALL),
fr AS (SELECT event_id, channel, sh, unnest(range(-5, 11)) AS o FROM sh)
SELECT fr.event_id, fr.channel, o::INTEGER AS "offset", coalesce(value, 0.0) AS value FROM fr LEFT JOIN ep ON ep.event_id = fr.event_id AND ep.channel = fr.channel AND ep.offset_ = o + sh""",
)
def aligned_waveforms(spark, d):
    w = extract.waveforms(signal(spark, d), onsets(spark, d), 5, 10, "min", 3, 5)
    return w.select("event_id", "channel", F.col("offset").cast("int").alias("offset"), "value")


@register("template_mean", f"WITH {_EP} SELECT channel, offset_::INTEGER AS \"offset\", round(avg(value) + 1e-9, 6) + 0.0 AS value FROM ep GROUP BY ALL")
def template_mean(spark, d):
    return extract.template(extract.epochs(signal(spark, d), onsets(spark, d), 5, 10)).select("channel", "offset", *off6("value"))


@register(
    "template_distribution",
    f"""WITH {_EP} SELECT channel, offset_::INTEGER AS "offset", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 4) AS var, round(median(value), 6) AS median,
min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75 FROM ep GROUP BY ALL""",
)
def template_distribution(spark, d):
    t = extract.template_distribution(extract.epochs(signal(spark, d), onsets(spark, d), 5, 10))
    return t.select("channel", "offset", *r6("mean", "std"), F.round("var", 4).alias("var"), *r6("median"), "min", "max", *r6("q25", "q75"))


@register(
    "triggered_average",
    f"""WITH {SIG}, {_N}, s AS (SELECT i % 3 AS unit_id, channel, i FROM sig WHERE value > 60),
ep AS (SELECT unit_id, s.channel, g.i - s.i AS o, g.value FROM s JOIN n USING (channel) JOIN sig g ON g.channel = s.channel AND g.i BETWEEN s.i - 4 AND s.i + 5 WHERE s.i >= 4 AND s.i + 5 < n)
SELECT unit_id, channel, o::INTEGER AS "offset", round(avg(value) + 1e-9, 6) + 0.0 AS average, round(var_samp(value), 4) + 0.0 AS variance FROM ep GROUP BY ALL""",
)
def triggered_average(spark, d):
    s = signal(spark, d)
    st = extract.triggered_average(s, s.where("value > 60").select((F.col("i") % 3).alias("unit_id"), "channel", "i"), 4, 6)
    return st.select("unit_id", "channel", "offset", *off6("average"), (F.round("variance", 4) + 0.0).alias("variance"))


@register(
    "burst_amplitude",
    f"""{_VAR}, w AS (SELECT event_id, channel, sqrt(avg(value * value) OVER f) AS r, count(*) OVER f AS k FROM va WHERE stop - onset_idx >= 4 WINDOW f AS (PARTITION BY event_id, channel ORDER BY offset_ ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT event_id, channel, round(max(r), 6) + 0.0 AS amplitude FROM w WHERE k = 4 GROUP BY ALL""",
)
def burst_amplitude(spark, d):
    return extract.burst_amplitude(signal(spark, d), spans(spark, d), 4).select("event_id", "channel", *r6("amplitude"))


@register(
    "signal_to_rest",
    f"""{_VAR}, a AS (SELECT event_id, channel, sqrt(avg(value * value)) AS r FROM va GROUP BY ALL),
q AS (SELECT event_id, sp.channel, sqrt(avg(value * value)) AS r FROM sp JOIN sig s ON s.channel = sp.channel AND s.i >= greatest(onset_idx - 10, 0) AND s.i < onset_idx WHERE onset_idx > 0 GROUP BY ALL)
SELECT event_id, channel, round(20 * log10(a.r / q.r), 6) + 0.0 AS snr_db FROM a JOIN q USING (event_id, channel)""",
)
def signal_to_rest(spark, d):
    return extract.signal_to_rest(signal(spark, d), spans(spark, d), 10).select("event_id", "channel", *r6("snr_db"))


@register("spike_amplitudes", f"WITH {_EP} SELECT event_id, channel, min(value) AS amplitude FROM ep WHERE offset_ BETWEEN -5 AND 5 GROUP BY ALL UNION ALL SELECT ev.event_id, ev.channel, min(s.value) FROM ev JOIN n USING (channel) JOIN sig s ON s.channel = ev.channel AND s.i BETWEEN ev.i - 5 AND ev.i + 5 WHERE ev.i >= 5 AND ev.i + 5 < n AND ev.i + 10 >= n GROUP BY ALL")
def spike_amplitudes(spark, d):
    return extract.spike_amplitudes(signal(spark, d), onsets(spark, d), 11)


@register("noise_outside_spikes", f"WITH {SIG}, {_ON} SELECT channel, round(stddev_pop(value), 6) AS noise FROM sig s WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.channel = s.channel AND s.i BETWEEN ev.i - 3 AND ev.i + 3) GROUP BY channel")
def noise_outside_spikes(spark, d):
    return extract.noise_outside(signal(spark, d), onsets(spark, d), 7).select("channel", *r6("noise"))


@register(
    "template_similarity",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM e GROUP BY ALL)
SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) + 0.0 AS similarity FROM m a JOIN m b USING (k) GROUP BY ALL""",
)
def template_similarity(spark, d):
    e = model.read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    m = e.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("x"))
    return extract.cosine_similarity(v).select("a", "b", *r6("similarity"))


# ---- spike trains ---------------------------------------------------------------------------

_RAS = f"WITH {SPIKES}, {STIM}, ras AS (SELECT unit_id, e.event_id, s.sample - e.sample AS rel FROM stim e JOIN spikes s ON s.sample >= e.sample - {30 * MIN} AND s.sample < e.sample + {30 * MIN})"


@register("raster", f"{_RAS} SELECT * FROM ras")
def raster(spark, d):
    return spikes.raster(train(spark, d), model.purchases(spark, d), 30 * MIN, 30 * MIN)


_PSTH = f"""{_RAS}, c AS (SELECT unit_id, ceil((rel + {30 * MIN}) / {10 * MIN}.0)::INTEGER - 1 AS bin, count(*) AS c FROM ras GROUP BY ALL), u AS (SELECT DISTINCT unit_id FROM spikes), g AS (SELECT unit_id, unnest(range(6))::INTEGER AS bin FROM u),
p AS (SELECT g.unit_id, g.bin, coalesce(c, 0) / (SELECT count(*) FROM stim) AS mean_count FROM g LEFT JOIN c ON c.unit_id = g.unit_id AND c.bin = g.bin),
r AS (SELECT unit_id, bin, mean_count, mean_count / 600.0 AS rate FROM p)"""


@register("psth", f"{_PSTH}, b AS (SELECT unit_id, avg(rate) AS b FROM r WHERE bin BETWEEN 0 AND 1 GROUP BY unit_id) SELECT unit_id, bin, round(mean_count, 9) AS mean_count, round(rate, 12) AS rate, round(CASE WHEN b > 0 THEN (rate - b) / b ELSE rate END, 6) + 0.0 AS normalized FROM r JOIN b USING (unit_id)")
def psth(spark, d):
    p = spikes.psth(train(spark, d), model.purchases(spark, d), 30 * MIN, 30 * MIN, 10 * MIN, SEC, (0, 1))
    return p.select("unit_id", "bin", F.round("mean_count", 9).alias("mean_count"), F.round("rate", 12).alias("rate"), *r6("normalized"))


def _kernel_sql(sigma: float, n: int, edge: str) -> str:
    k = spikes.gaussian_kernel(sigma)
    r = len(k) // 2
    fold = f"CASE WHEN s < 0 THEN -s - 1 WHEN s >= {n} THEN {2 * n - 1} - s ELSE s END" if edge == "mirror" else "s"
    rows = ", ".join(f"({j - r}, {w!r}::DOUBLE)" for j, w in enumerate(k))
    return f"kern AS (SELECT t, {fold} AS bin, w FROM (SELECT t, t + o AS s, w FROM range({n}) x(t), (VALUES {rows}) v(o, w)))"


@register("psth_smoothed", f"{_PSTH}, {_kernel_sql(1.0, 6, 'mirror')} SELECT unit_id, t::INTEGER AS bin, round(sum(mean_count * w), 9) + 0.0 AS smoothed FROM r JOIN kern USING (bin) GROUP BY ALL")
def psth_smoothed(spark, d):
    p = spikes.psth(train(spark, d), model.purchases(spark, d), 30 * MIN, 30 * MIN, 10 * MIN, SEC)
    return spikes.smooth_bins(p, "mean_count", 1.0, 6).select("unit_id", "bin", (F.round("smoothed", 9) + 0.0).alias("smoothed"))


@register(
    "spike_density",
    f"""WITH {SPIKES}, u AS (SELECT DISTINCT unit_id FROM spikes), c AS (SELECT unit_id, sample // {DAY} AS bin, count(*) AS c FROM spikes GROUP BY ALL), g AS (SELECT unit_id, unnest(range(31)) AS bin FROM u),
f AS (SELECT g.unit_id, g.bin, coalesce(c, 0) AS c FROM g LEFT JOIN c ON c.unit_id = g.unit_id AND c.bin = g.bin), {_kernel_sql(1.5, 31, 'zero')}
SELECT unit_id, t::INTEGER AS bin, round(sum(c * w) * {24 / 24} * 1.0, 6) + 0.0 AS rate FROM f JOIN kern USING (bin) GROUP BY ALL""",
)
def spike_density(spark, d):
    return spikes.density(train(spark, d), DAY, 31, 1.5, DAY).select("unit_id", "bin", *r6("rate"))


@register(
    "correlograms",
    f"""WITH {SPIKES}, n AS (SELECT unit_id, count(*) AS n FROM spikes GROUP BY unit_id),
c AS (SELECT a.unit_id AS unit1, b.unit_id AS unit2, ((b.sample - a.sample + {10 * MIN}) // {MIN})::INTEGER AS bin, count(*) AS count FROM spikes a JOIN spikes b ON b.sample >= a.sample - {10 * MIN} AND b.sample < a.sample + {10 * MIN} WHERE a.unit_id <= b.unit_id GROUP BY ALL)
SELECT unit1, unit2, bin, count, round(count / (n * 60.0), 9) AS value FROM c JOIN n ON n.unit_id = unit1""",
)
def correlograms(spark, d):
    c = spikes.correlograms(train(spark, d), MIN, 20 * MIN, SEC)
    return c.select("unit1", "unit2", "bin", "count", decimals("value", 9))


@register(
    "autocorrelogram_probability",
    f"""WITH {SPIKES}, c AS (SELECT a.unit_id AS unit_id, ((b.sample - a.sample + {6 * HOUR}) // {HOUR})::INTEGER AS bin, count(*) AS count FROM spikes a JOIN spikes b ON b.unit_id = a.unit_id AND b.sample >= a.sample - {6 * HOUR} AND b.sample < a.sample + {6 * HOUR} GROUP BY ALL)
SELECT unit_id, bin, count, round(count / sum(count) OVER (PARTITION BY unit_id), 9) AS value FROM c""",
)
def autocorrelogram_probability(spark, d):
    c = spikes.correlograms(train(spark, d), HOUR, 12 * HOUR, SEC, "probability", crosses=False)
    return c.select(F.col("unit1").alias("unit_id"), "bin", "count", F.round("value", 9).alias("value"))


@register(
    "tiling_coefficient",
    f"""WITH {SPIKES}, n AS (SELECT unit_id, count(*) AS n FROM spikes GROUP BY unit_id),
h AS (SELECT a.unit_id AS u1, b.unit_id AS u2, count(DISTINCT a.event_id) AS h FROM spikes a JOIN spikes b ON b.sample BETWEEN a.sample - {5 * MIN} AND a.sample + {5 * MIN} WHERE a.unit_id <> b.unit_id GROUP BY ALL),
t AS (SELECT u1, u2, h / n AS t FROM h JOIN n ON n.unit_id = u1)
SELECT x.u1 AS unit1, x.u2 AS unit2, round((x.t + y.t - x.t * y.t) / greatest(1 - x.t * y.t, 1e-10), 9) AS coefficient FROM t x JOIN t y ON x.u1 = y.u2 AND x.u2 = y.u1 WHERE x.u1 < x.u2""",
)
def tiling_coefficient(spark, d):
    return spikes.tiling_coefficient(train(spark, d), 5 * MIN).select("unit1", "unit2", decimals("coefficient", 9))


@register("synchrony", f"WITH {SPIKES}, h AS (SELECT unit_id, sample // {HOUR} AS t FROM spikes), c AS (SELECT t, count(*) AS c FROM h GROUP BY t) SELECT unit_id, round(avg((c >= 2)::INTEGER), 9) AS sync_2, round(avg((c >= 4)::INTEGER), 9) AS sync_4, round(avg((c >= 8)::INTEGER), 9) AS sync_8 FROM h JOIN c USING (t) GROUP BY unit_id")
def synchrony(spark, d):
    s = spikes.synchrony(train(spark, d).withColumn("sample", F.floor(F.col("sample") / HOUR)))
    return s.select("unit_id", *(F.round(c, 9).alias(c) for c in ("sync_2", "sync_4", "sync_8")))


# ---- metrics and summaries ------------------------------------------------------------------


@register("firing_rates", f"WITH {SPIKES} SELECT unit_id, count(*) AS num_spikes, round(count(*) / 2592000.0, 12) AS firing_rate FROM spikes GROUP BY unit_id")
def firing_rates(spark, d):
    return spikes.firing_rates(train(spark, d), 2592000.0).select("unit_id", "num_spikes", F.round("firing_rate", 12).alias("firing_rate"))


@register(
    "presence_ratio",
    f"""WITH {SPIKES}, l AS (SELECT unit_id, floor(count(*) / {30 * DAY}.0 * {DAY} * 0.4) AS l FROM spikes GROUP BY unit_id), c AS (SELECT unit_id, least(sample // {DAY}, 29) AS b, count(*) AS c FROM spikes WHERE sample <= {30 * DAY} GROUP BY ALL)
SELECT l.unit_id, round(count(CASE WHEN c > l THEN 1 END) / 30.0, 9) AS presence_ratio FROM l LEFT JOIN c USING (unit_id) GROUP BY l.unit_id""",
)
def presence_ratio(spark, d):
    return spikes.presence_ratio(train(spark, d), 30 * DAY, DAY, 0.4).select("unit_id", F.round("presence_ratio", 9).alias("presence_ratio"))


@register(
    "isi_violations",
    f"""WITH {SPIKES}, x AS (SELECT unit_id, sample - lag(sample) OVER (PARTITION BY unit_id ORDER BY sample) AS isi FROM spikes), g AS (SELECT unit_id, count(*) AS n, count(CASE WHEN isi < {HOUR} THEN 1 END) AS violations FROM x GROUP BY unit_id)
SELECT unit_id, violations, round(CASE WHEN n > 1 THEN (violations / (2.0 * n * {HOUR})) / (n / {30 * DAY}.0) END, 9) AS ratio FROM g""",
)
def isi_violations(spark, d):
    return spikes.isi_violations(train(spark, d), 30 * DAY, HOUR).select("unit_id", "violations", F.round("ratio", 9).alias("ratio"))


@register(
    "refractory_contamination",
    f"""WITH {SPIKES}, v AS (SELECT a.unit_id, count(*) AS v FROM spikes a JOIN spikes b ON a.unit_id = b.unit_id AND b.sample > a.sample AND b.sample <= a.sample + {HOUR} GROUP BY a.unit_id), n AS (SELECT unit_id, count(*) AS n FROM spikes GROUP BY unit_id),
x AS (SELECT unit_id, coalesce(v, 0) AS v, 1 - coalesce(v, 0) * {30 * DAY}.0 / (n * n * {HOUR}.0) AS d FROM n LEFT JOIN v USING (unit_id)) SELECT unit_id, v AS violations, round(CASE WHEN d < 0 THEN 1 ELSE 1 - sqrt(greatest(d, 0)) END, 9) + 0.0 AS contamination FROM x""",
)
def refractory_contamination(spark, d):
    return spikes.refractory_contamination(train(spark, d), 30 * DAY, HOUR).select("unit_id", "violations", (F.round("contamination", 9) + 0.0).alias("contamination"))


@register(
    "drift",
    f"""WITH {SPIKES}, w AS (SELECT unit_id, median(value) AS m FROM spikes GROUP BY unit_id), e AS (SELECT unit_id, sample // {3 * DAY} AS k, median(value) AS p FROM spikes GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT unit_id, p - m AS x FROM e JOIN w USING (unit_id) WHERE k < 10), m2 AS (SELECT unit_id, median(x) AS m FROM s GROUP BY unit_id),
g AS (SELECT unit_id, count(*) AS v, max(x) - min(x) AS ptp, stddev_pop(x) AS sd, median(abs(x - m)) AS mad FROM s JOIN m2 USING (unit_id) GROUP BY unit_id)
SELECT w.unit_id, round(CASE WHEN v >= 5 THEN ptp END, 6) AS drift_ptp, round(CASE WHEN v >= 5 THEN sd END, 6) AS drift_std, round(CASE WHEN v >= 5 THEN mad END, 6) AS drift_mad FROM w LEFT JOIN g USING (unit_id)""",
)
def drift(spark, d):
    x = spikes.drift(train(spark, d), "value", 3 * DAY, 3, 10)
    return x.select("unit_id", *(F.round(c, 6).alias(c) for c in ("drift_ptp", "drift_std", "drift_mad")))


@register(
    "firing_range",
    f"""WITH {SPIKES}, u AS (SELECT DISTINCT unit_id FROM spikes), c AS (SELECT unit_id, sample // {DAY} AS b, count(*) AS c FROM spikes GROUP BY ALL), g AS (SELECT unit_id, unnest(range(30)) AS b FROM u),
f AS (SELECT g.unit_id, coalesce(c, 0) / 86400.0 AS r FROM g LEFT JOIN c ON c.unit_id = g.unit_id AND c.b = g.b) SELECT unit_id, round(quantile_cont(r, 0.95) - quantile_cont(r, 0.05), 12) AS firing_range FROM f GROUP BY unit_id""",
)
def firing_range(spark, d):
    return spikes.firing_range(train(spark, d), DAY, 30, SEC).select("unit_id", F.round("firing_range", 12).alias("firing_range"))


_US = f"""{SPIKES}, x AS (SELECT unit_id, (sample - lag(sample) OVER (PARTITION BY unit_id ORDER BY sample)) / 1e6 AS isi FROM spikes), t AS (SELECT max(sample) / 1e6 AS t FROM spikes),
g AS (SELECT unit_id, count(*) AS n_spikes, avg(isi) AS m, median(isi) AS md, stddev_pop(isi) AS sd, count(CASE WHEN isi < 3600 THEN 1 END) AS isi_violations, count(isi) AS k FROM x GROUP BY unit_id),
us AS (SELECT unit_id, n_spikes, n_spikes / t AS firing_rate, coalesce(m, 0) AS mean_isi, coalesce(md, 0) AS median_isi, coalesce(CASE WHEN m > 0 THEN sd / m END, 0) AS cv_isi, isi_violations, coalesce(CASE WHEN k > 0 THEN isi_violations / k * 100 END, 0) AS violation_pct FROM g, t),
un AS (SELECT *, CASE unit_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'mua' ELSE 'unsorted' END AS label FROM us)"""


def units(spark, d):
    u = spikes.unit_summary(train(spark, d), 1e6, 3600.0)
    return u.withColumn("label", F.when(F.col("unit_id") % 3 == 0, "good").when(F.col("unit_id") % 3 == 1, "mua").otherwise("unsorted"))


@register("unit_summary", f"WITH {_US} SELECT unit_id, n_spikes, round(firing_rate, 12) AS firing_rate, round(mean_isi, 4) AS mean_isi, round(median_isi, 7) AS median_isi, {q6('cv_isi')}, isi_violations, round(violation_pct, 6) AS violation_pct FROM us")
def unit_summary(spark, d):
    return units(spark, d).select("unit_id", "n_spikes", F.round("firing_rate", 12).alias("firing_rate"), F.round("mean_isi", 4).alias("mean_isi"), F.round("median_isi", 7).alias("median_isi"), *r6("cv_isi"), "isi_violations", F.round("violation_pct", 6).alias("violation_pct"))


@register(
    "quality_summary",
    f"WITH {_US} SELECT label, count(*) AS n_units, round(avg(firing_rate), 12) AS mean_rate, round(stddev_samp(firing_rate), 12) AS std_rate, round(min(firing_rate), 12) AS min_rate, round(max(firing_rate), 12) AS max_rate, round(avg(cv_isi), 6) AS mean_cv, sum(isi_violations)::BIGINT AS violations, sum(n_spikes)::BIGINT AS spikes FROM un GROUP BY label",
)
def quality_summary(spark, d):
    q = spikes.quality_summary(units(spark, d))
    return q.select("label", "n_units", *(F.round(c, 12).alias(c) for c in ("mean_rate", "std_rate", "min_rate", "max_rate")), F.round("mean_cv", 6).alias("mean_cv"), "violations", "spikes")


@register(
    "quality_summary_amplitudes",
    f"""WITH {_US}, a AS (SELECT unit_id, avg(value) AS amplitude, count(*) % 7 AS contamination FROM spikes GROUP BY unit_id)
SELECT label, count(*) AS n_units, round(avg(amplitude), 6) AS mean_amplitude, round(avg(contamination), 6) AS mean_contamination FROM un JOIN a USING (unit_id) GROUP BY label""",
)
def quality_summary_amplitudes(spark, d):
    """The summary of units that carry an amplitude and a contamination, as sorters write them."""
    a = train(spark, d).groupBy("unit_id").agg(F.avg("value").alias("amplitude"), (F.count("*") % 7).alias("contamination"))
    return spikes.quality_summary(units(spark, d).join(a, "unit_id")).select("label", "n_units", *r6("mean_amplitude", "mean_contamination"))


@register(
    "channel_summary",
    f"""WITH {_US}, tm AS (SELECT unit_id, event_type AS channel, avg(value) AS value FROM spikes GROUP BY ALL), pr AS (SELECT unit_id, arg_min(channel, (-abs(value), channel)) AS channel FROM tm GROUP BY unit_id)
SELECT channel, count(*) AS n_units, count(CASE WHEN label = 'good' THEN 1 END) AS n_good, count(CASE WHEN label = 'mua' THEN 1 END) AS n_mua, count(CASE WHEN label = 'unsorted' THEN 1 END) AS n_unsorted, round(avg(firing_rate), 12) AS mean_rate, sum(n_spikes)::BIGINT AS spikes FROM un LEFT JOIN pr USING (unit_id) GROUP BY channel""",
)
def channel_summary(spark, d):
    t = train(spark, d)
    c = spikes.channel_summary(t, units(spark, d), t.groupBy("unit_id", F.col("event_type").alias("channel")).agg(F.avg("value").alias("value")))
    return c.withColumn("mean_rate", F.round("mean_rate", 12))


@register("recording_summary", f"WITH {_US} SELECT 2592000.0::DOUBLE AS duration, count(*) AS n_units, sum(n_spikes)::BIGINT AS spikes, round(avg(firing_rate), 12) AS mean_rate, round(count(CASE WHEN label = 'good' THEN 1 END) / count(*) * 100, 6) AS pct_good FROM un")
def recording_summary(spark, d):
    r = spikes.recording_summary(units(spark, d), 2592000.0)
    return r.select("duration", "n_units", "spikes", F.round("mean_rate", 12).alias("mean_rate"), F.round("pct_good", 6).alias("pct_good"))


@register("unit_spike_train", f"WITH {SPIKES} SELECT unit_id, sample FROM spikes WHERE unit_id = 7 AND sample >= {2 * DAY} AND sample < {20 * DAY}")
def unit_spike_train(spark, d):
    return spikes.unit_train(train(spark, d), 7, 2 * DAY, 20 * DAY).select("unit_id", "sample")
